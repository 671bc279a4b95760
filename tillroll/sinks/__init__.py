"""Result tables: versions behind a view.

``refresh_table`` stands for the sequence CREATE SCHEMA / DROP or TRUNCATE /
CREATE TABLE / INSERT INTO ... SELECT. The new rows are written once, to a table
of their own, the version; the result's name is a view on the newest version, and
``CREATE OR REPLACE VIEW`` is the one step that commits. A reader sees the old
rows or the new ones, never none, and a query under way keeps reading the version
that it began with: the last ``keep`` old versions stay, earlier ones are dropped
after the commit. A failed write leaves view and versions as they were. (The
scripts had no transaction around their refresh.)

A plain table under the result's name, as earlier releases made it, becomes the
first version by a rename; only between that rename and the first view is there
nothing under the name.

Rows are inserted by position with ANSI store assignment
(``spark.sql.storeAssignmentPolicy=ANSI``, the default): decimals are
rounded to the declared scale, and over-long text or integer overflow
fail the write, as assignment casts do in PostgreSQL.

``snapshot`` stands for ``CREATE TEMP TABLE ... AS``: a reliable checkpoint
in ``spark.checkpoint.dir`` registered as a temp view, so later reads see
the rows as they were, without recomputing the lineage.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import ensure_checkpoint_dir

MODES = ("recreate", "truncate")
#: The view's property that names its version; the mark of versions that a view had.
VERSION, COMMITTED = "tillroll.version", "tillroll.committed"


def _plain(name: str) -> str:
    """``name`` without the session's own catalog."""
    return name.removeprefix("spark_catalog.") if name.count(".") == 2 else name


def _split(name: str) -> tuple[str, str]:
    """(prefix with its dot or empty, table) of a table name of one to three parts."""
    prefix, dot, table = name.rpartition(".")
    return prefix + dot, table


def _at(location: str | None) -> str:
    return f" LOCATION '{location}'" if location else ""


def create_table(spark: SparkSession, name: str, ddl_columns: str, if_not_exists: bool = True,
                 location: str | None = None) -> None:
    prefix, _ = _split(name)
    if prefix:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {prefix.rstrip('.')}")
    clause = "IF NOT EXISTS " if if_not_exists else ""
    spark.sql(f"CREATE TABLE {clause}{name} ({ddl_columns}) USING parquet{_at(location)}")


def _property(spark: SparkSession, table: str, key: str) -> str | None:
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return found.get(key)


def current_version(spark: SparkSession, name: str) -> str | None:
    """The table that holds the rows of ``name``: the view's version, or the plain
    table itself; None if there is nothing under the name."""
    name = _plain(name)
    if not spark.catalog.tableExists(name):
        return None
    return _property(spark, name, VERSION) or name


def _new_name(name: str, at: int | None = None) -> str:
    return f"{name}__v{time.time_ns() if at is None else at:020d}_{uuid.uuid4().hex[:8]}"


def _commit(spark: SparkSession, name: str, version: str) -> None:
    if current_version(spark, name) == name:  # a plain table: the first version
        first = _new_name(name, at=0)
        spark.sql(f"ALTER TABLE {name} RENAME TO {'.'.join(first.split('.')[-2:])}")
        spark.sql(f"ALTER TABLE {first} SET TBLPROPERTIES ('{COMMITTED}' = 'true')")
    spark.sql(f"ALTER TABLE {version} SET TBLPROPERTIES ('{COMMITTED}' = 'true')")
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{VERSION}' = '{version}') AS SELECT * FROM {version}")


def versions(spark: SparkSession, name: str) -> list[str]:
    """The committed versions of ``name``, oldest first."""
    prefix, table = _split(_plain(name))
    listed = spark.catalog.listTables(prefix.rstrip(".") or None, f"{table}__v*")
    names = sorted(prefix + t.name for t in listed if not t.isTemporary)
    return [n for n in names if _property(spark, n, COMMITTED)]


def drop_old_versions(spark: SparkSession, name: str, keep: int = 1) -> None:
    """Drops the committed versions but the current one and the ``keep`` before it.
    Versions that another refresh is still writing are not touched."""
    now = current_version(spark, name)
    old = [v for v in versions(spark, name) if v != now]
    for version in old[:max(0, len(old) - keep)]:
        spark.sql(f"DROP TABLE IF EXISTS {version}")


def drop_result(spark: SparkSession, name: str) -> None:
    """Drops ``name`` with all its versions (DROP TABLE IF EXISTS)."""
    name = _plain(name)
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP {'TABLE' if current_version(spark, name) == name else 'VIEW'} {name}")
    for version in versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {version}")


def refresh_table(spark: SparkSession, df: DataFrame, name: str, ddl_columns: str,
                  columns: Sequence[str] | None = None, mode: str = "recreate", keep: int = 1,
                  before_commit: Callable[[DataFrame], None] | None = None, location: str | None = None) -> None:
    """Replace the rows of table ``name`` with ``df``, inserted by position.

    mode='recreate': the table gets the declared definition (the first
    script). mode='truncate': an existing table keeps its definition, which the
    rows must then fit; it is created from ``ddl_columns`` only if absent (the
    second script). ``before_commit`` gets the written rows and stops the refresh
    by raising. ``location`` is a folder in which each version gets a folder of its
    own, whose files outlive the table. Runs Spark jobs when called.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    name = _plain(name)
    rows = df.select(*columns) if columns else df
    version = _new_name(name)
    place = f"{location}/{_split(version)[1]}" if location else None
    like = current_version(spark, name) if mode == "truncate" else None
    if like:
        spark.sql(f"CREATE TABLE {version} LIKE {like}{_at(place)}")
        spark.sql(f"ALTER TABLE {version} UNSET TBLPROPERTIES IF EXISTS ('{COMMITTED}')")
    else:
        create_table(spark, version, ddl_columns, if_not_exists=False, location=place)
    try:
        rows.write.insertInto(version, overwrite=True)
        if before_commit:
            before_commit(spark.table(version))
        _commit(spark, name, version)
    except Exception:
        if current_version(spark, name) != version:
            spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    drop_old_versions(spark, name, keep)


def snapshot(df: DataFrame, view_name: str) -> DataFrame:
    """Materialise ``df`` once (reliable checkpoint) and register it as a
    temp view; returns the materialised DataFrame."""
    ensure_checkpoint_dir(df.sparkSession)
    frozen = df.checkpoint(eager=True)
    frozen.createOrReplaceTempView(view_name)
    return frozen
