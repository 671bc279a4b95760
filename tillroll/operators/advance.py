"""Moving the cap of the weekly lifetime table forward.

The capped table at week W40 is that of W39 plus a week for each conversion that
is still running, unless the past has changed. ``state_of`` keeps, for every
customer, an order-free digest of what the rows were made from (conversions with
their first orders, weekly orders up to the cap or the last week that the customer
has in the table) and, for every (customer, conversion), weeks and revenue.
``advance`` then

* compares the digests of the new inputs, over the same weeks, with the kept ones:
  a late or changed order, a new conversion or a new customer differs. Customers
  with a conversion of unknown week, whose intervals may overlap, always differ;
* keeps the dated rows of all other customers as they are stored: a scan that leaves
  out the changed customers, broadcast unless they are very many, without a shuffle
  or a cast of the stored figures;
* makes their new weeks only, counting and summing on from the kept totals;
* makes their rows without a week again, since those show the customer's total;
* builds the customers that differ anew, whole.

Digests and totals are one aggregate over conversions and weekly orders; the spine,
hundreds of rows a conversion, is made for new weeks and changed customers only.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.lifetime import (
    AMOUNTS,
    SINK_COLUMNS,
    Prepared,
    _customer_key,
    _ends,
    _spans,
    group_totals,
    lifetime_rows,
    stored_types,
)

# More changed customers than this (8 bytes each) are not broadcast.
CHANGED_BROADCAST_LIMIT = 1_000_000

STATE_DDL = """
    ck BIGINT,
    conversion_id BIGINT,
    weeks BIGINT,
    paid DECIMAL(38,2),
    parts BIGINT,
    digest DECIMAL(38,0),
    other DECIMAL(38,0),
    as_of VARCHAR(255),
    version VARCHAR(255)
"""


def history_digests(prepared: Prepared, as_of: str) -> DataFrame:
    """(ck, parts, digest, other) of each customer's conversions and of the weekly
    orders that the table at cap ``as_of`` shows or could have shown; equal for
    equal histories in any order."""
    base = prepared.dated.unionByName(prepared.undated)
    ends = _ends(prepared.weeks, as_of)
    last = (_spans(prepared.dated, ends, "capped").where("_has_weeks").groupBy(F.col("_ck").alias("_lk"))
            .agg(F.max("_hi").alias("_last")))
    weekly = (prepared.weekly.join(last, F.col("_ck") == F.col("_lk"), "left")
              .where(F.col("order_ord") <= F.greatest(F.lit(ends[0]), F.coalesce("_last", F.lit(0)))))
    # Which week a conversion's successor has is part of its rows.
    hashed = [df.select("_ck", F.xxhash64(*cols).alias("_h"), F.xxhash64(F.lit(7), *cols).alias("_g"))
              for df, cols in ((base, sorted(base.columns)), (weekly, ["_ck", "order_ord", *AMOUNTS]))]
    wide = lambda c, out: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)").alias(out)
    return (hashed[0].unionByName(hashed[1]).groupBy(F.col("_ck").alias("ck"))
            .agg(F.count("*").alias("parts"), wide("_h", "digest"), wide("_g", "other")))


def state_of(prepared: Prepared, as_of: str, version: str = "") -> DataFrame:
    """What ``advance`` needs of a table built from ``prepared`` with cap ``as_of``:
    a row for each customer (conversion_id and weeks NULL) with its digest, and for
    each (customer, conversion) with weeks its weeks and revenue. ``version`` names
    the table that the state belongs to."""
    digests = history_digests(prepared, as_of)
    totals = group_totals(prepared, as_of).select(F.col("_ck").alias("ck"), "conversion_id", F.col("_weeks").alias("weeks"), F.col("_paid").alias("paid"))
    rows = digests.unionByName(totals, allowMissingColumns=True)
    return rows.select("ck", "conversion_id", "weeks", F.col("paid").cast("decimal(38,2)").alias("paid"), "parts", "digest", "other",
                       F.lit(as_of).alias("as_of"), F.lit(version).alias("version"))


def changed_customers(state: DataFrame, prepared: Prepared, as_of: str) -> DataFrame:
    """(ck) of customers whose history is not the one kept at cap ``as_of``, those
    that came or went included, and of those with conversions of unknown week."""
    kept = state.where("parts IS NOT NULL").select("ck", "parts", "digest", "other")
    now = history_digests(prepared, as_of)
    signed = kept.withColumn("_sign", F.lit(1)).unionByName(now.withColumn("_sign", F.lit(-1)))
    sums = signed.groupBy("ck").agg(
        F.sum("_sign").alias("sides"), *[F.sum(F.col(c) * F.col("_sign")).alias(c) for c in ("parts", "digest", "other")])
    return sums.where("sides != 0 OR parts != 0 OR digest != 0 OR other != 0").select("ck").union(
        prepared.undated.where("conversion_id IS NOT NULL AND conversion_ord IS NULL").select("_ck")).distinct()


def advance(stored: DataFrame, state: DataFrame, prepared: Prepared, as_of: str, new_as_of: str) -> DataFrame:
    """The capped table at ``new_as_of`` from ``stored``, the one at ``as_of``, its
    ``state`` and new inputs: the rows of ``lifetime_rows(prepared, new_as_of)``.
    The new cap is not before the old one. Runs Spark jobs when called."""
    if new_as_of < as_of:
        raise ValueError(f"the cap cannot go back from {as_of} to {new_as_of}")
    changed = changed_customers(state, prepared, as_of).checkpoint(eager=True)
    # Of a checkpoint the planner knows no size; it would shuffle the whole stored table.
    if changed.limit(CHANGED_BROADCAST_LIMIT + 1).count() <= CHANGED_BROADCAST_LIMIT:
        changed = F.broadcast(changed)
    types = stored_types(stored.select(*SINK_COLUMNS).schema)
    mine = F.col("_ck") == F.col("ck")
    only = lambda df, how: df.join(changed, mine, how)
    parts = {how: replace(prepared, dated=only(prepared.dated, how), undated=only(prepared.undated, how), weekly=only(prepared.weekly, how))
             for how in ("left_semi", "left_anti")}
    anew = lifetime_rows(parts["left_semi"], new_as_of, types=types)
    carried = state.where("weeks IS NOT NULL").select(F.col("ck").alias("_ck"), "conversion_id", F.col("weeks").alias("_weeks"), F.col("paid").alias("_paid"))
    further = lifetime_rows(parts["left_anti"], new_as_of, since=as_of, carried=carried, types=types)
    past = stored.where("order_week IS NOT NULL").withColumn("_ck", _customer_key()).join(changed, mine, "left_anti")
    # Few rows in each partition of the made ones: one file for several.
    return past.select(*SINK_COLUMNS).unionByName(further.unionByName(anew).coalesce(prepared.partitions))
