"""Full refresh of the weekly customer lifetime table.

    1. conversions and orders are joined once and written (``lifetime.prepare``);
       the grain checks on conversions read that result instead of the facts,
       and the count of missing orders comes with its write,
    2. ``strict=True`` raises with the failing checks, before anything is built,
    3. build the table (``variant`` 'capped' or 'open') from frames bucketed by
       customer,
    4. write a new version and put it behind the table's name (``mode``
       'recreate' declares the table anew, 'truncate' keeps its definition),
    5. return the reconciliation (rows and final lifetime revenue per
       customer) read back from the written table.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.order import total_order
from tillroll.operators.grain import (
    first_week_mismatch_of_pairs,
    grain_violations,
)
from tillroll.operators.lifetime import (
    SINK_COLUMNS,
    SINK_DDL,
    Prepared,
    lifetime_rows,
    pair_orders,
    prepare,
    reconcile,
    sink_schema,
    stored_types,
)
from tillroll.operators.advance import STATE_DDL, advance, state_of
from tillroll.sinks import current_version, refresh_table
from tillroll.sources.calendar import week_tables


def pair_checks(paired: DataFrame) -> dict[str, DataFrame]:
    """The checks on conversions, from ``lifetime.pair_orders``."""
    return {
        "conversion_has_one_order": grain_violations(paired, "conversion_id", "order_number", 1, "unique_orders"),
        "conversion_order_exists": paired.where("NOT found").select("conversion_id", "order_number"),
        "first_order_in_first_conversion_week": first_week_mismatch_of_pairs(paired),
    }


def order_checks(orders: DataFrame, order_products: DataFrame | None = None) -> dict[str, DataFrame]:
    """The checks on orders alone."""
    checks = {}
    if "order_id" in orders.columns:
        checks["order_id_has_one_number"] = grain_violations(
            orders, "order_id", "order_number", 1, "unique_order_number_count")
    if order_products is not None:
        checks["order_has_one_product"] = grain_violations(
            order_products, "order_number", "fk_product", 1, "unique_products_count")
    return checks


def grain_checks(conversions: DataFrame, orders: DataFrame, dates: DataFrame,
                 order_products: DataFrame | None = None) -> dict[str, DataFrame]:
    """The assumption checks of the script, by name."""
    return pair_checks(pair_orders(conversions, orders, week_tables(dates)[1])) | order_checks(orders, order_products)


def failed_checks(checks: dict[str, DataFrame]) -> list[str]:
    """Names of checks that return at least one row (one small job each)."""
    return [name for name, df in checks.items() if not df.isEmpty()]


def check_report(checks: dict[str, DataFrame], sample: int = 5) -> dict[str, dict]:
    """Of every check that returns rows: their number and the first few of them.
    One job a check: the rows are counted on their way into the top few."""
    report = {}
    for name, df in checks.items():
        counted = Observation()
        seen = df.observe(counted, F.count(F.lit(1)).alias("rows"))
        rows = seen.orderBy(*total_order(seen, [])).limit(sample).collect()
        if rows:
            report[name] = {"rows": counted.get["rows"], "sample": [r.asDict() for r in rows]}
    return report


def gate_report(prepared: Prepared, orders: DataFrame, order_products: DataFrame | None = None,
                sample: int = 5) -> dict[str, dict]:
    """``check_report`` of a prepared build: no check on conversions reads a fact,
    and the one on missing orders runs only if the write counted some."""
    checks = pair_checks(prepared.paired)
    if not prepared.orphans:
        del checks["conversion_order_exists"]
    return check_report(checks | order_checks(orders, order_products), sample)


def advance_customer360(spark: SparkSession, customers: DataFrame, conversions: DataFrame, orders: DataFrame,
                        dates: DataFrame, table: str, as_of: str, location: str | None = None) -> DataFrame:
    """The capped table with its cap moved to ``as_of``, and the totals per customer.
    ``location``: see ``refresh_table``.

    Needs the state that the last call kept in ``{table}__state``; without one, or
    if it belongs to another version of the table (a refresh in between, a call that
    stopped half-way), the table is built whole.
    """
    schema = table.rpartition(".")[0]
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    states = f"{table}__state"
    work = f"{table.removeprefix('spark_catalog.')}__work_{uuid.uuid4().hex[:12]}"
    try:
        prepared = prepare(customers, conversions, orders, dates, store=work)
        now = current_version(spark, table)
        kept = spark.table(states) if now and current_version(spark, states) else None
        mark = kept.select("as_of", "version").first() if kept is not None else None
        if mark and mark.version == now and mark.as_of <= as_of:
            rows = advance(spark.table(table), kept, prepared, mark.as_of, as_of)
        else:
            rows = lifetime_rows(prepared, as_of, types=stored_types(spark.table(table).schema if now else sink_schema()))
        refresh_table(spark, rows, table, SINK_DDL, SINK_COLUMNS, mode="truncate", location=location)
        refresh_table(spark, state_of(prepared, as_of, current_version(spark, table)), states, STATE_DDL)
    finally:
        for part in ("dated", "weekly"):
            spark.sql(f"DROP TABLE IF EXISTS {work}_{part}")
    return reconcile(spark.table(table))


def refresh_customer360(spark: SparkSession, customers: DataFrame, conversions: DataFrame,
                        orders: DataFrame, dates: DataFrame,
                        table: str = "customer360.full_360_view", variant: str = "capped",
                        mode: str = "recreate", as_of=None, strict: bool = False,
                        order_products: DataFrame | None = None) -> DataFrame:
    """Runs the grain checks, refreshes the table, and returns the totals per
    customer read from the table. Failed checks are logged with their counts
    and sample rows; with ``strict`` they stop the refresh."""
    schema = table.rpartition(".")[0]
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    work = f"{table.removeprefix('spark_catalog.')}__work_{uuid.uuid4().hex[:12]}"
    try:
        prepared = prepare(customers, conversions, orders, dates, store=work)
        report = gate_report(prepared, orders, order_products)
        if report and strict:
            raise ValueError(f"grain checks failed: {report}")
        if report:
            logging.getLogger(__name__).warning("grain checks failed: %s", report)
        refresh_table(spark, lifetime_rows(prepared, as_of, variant), table, SINK_DDL, SINK_COLUMNS, mode=mode)
    finally:
        for part in ("dated", "weekly"):
            spark.sql(f"DROP TABLE IF EXISTS {work}_{part}")
    return reconcile(spark.table(table))
