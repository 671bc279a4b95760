"""Null ordering as the original scripts assume it.

PostgreSQL sorts NULLs last ascending and first descending; Spark does the
opposite by default. Every ORDER BY and window ORDER BY in tillroll goes
through these two helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pg_asc(c) -> Column:
    return _col(c).asc_nulls_last()


def pg_desc(c) -> Column:
    return _col(c).desc_nulls_first()


def total_order(df, keys) -> list[Column]:
    """Sort columns: ``keys`` (names sort ascending, NULLs last; Columns keep
    their own direction), then every other column of ``df`` ascending as a
    tie-breaker.

    The tie-breakers make the order deterministic and let a range-partitioned
    sort split rows that share a hot leading key (a ticket with a third of all
    lines, or a billion groups with the same count) across many tasks, since
    Spark samples the whole composite key for the partition bounds.
    """
    from pyspark.sql import types as T

    named = {k for k in keys if isinstance(k, str)}
    out = [pg_asc(k) if isinstance(k, str) else k for k in keys]
    for f in df.schema.fields:
        if f.name not in named and isinstance(f.dataType, T.AtomicType):
            out.append(pg_asc(F.col(f"`{f.name}`")))
    return out
