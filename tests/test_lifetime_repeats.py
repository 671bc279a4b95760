"""The lifetime table on repeated keys, against SQL and by hand, and its plan."""

import re

import pytest

from test_lifetime import CAP, _day, _duck, _frames, _key, _rows
from tillroll.operators import lifetime

# conversion_id, fk_customer, date, order_number: one id in two intervals, one id
# on equal rows, ids of two keys of a customer, an unknown date key between known ones.
REPEATED = [(102, 1, "2021-02-15", 1003), (102, 1, "2021-03-02", 1003), (601, 6, "2021-02-22", 6001),
            (901, 10, "2021-02-16", 9003), (1101, 11, "2021-02-03", 1101), (1101, 11, "2021-02-03", 1101),
            (1201, 12, "2021-02-24", 1201)]


def _dirty_frames(spark):
    customers, conversions, orders, dates = _frames(spark)
    more = [(cid, fk, _key(day), _day(day), "T", "CH", num) for cid, fk, day, num in REPEATED]
    # Two more keys of customer 2 without a conversion, and two customers without an id.
    people = [(20, 2, "F2b", "L2b"), (21, 2, "F2c", "L2c"), (30, None, "N1", "N1"), (31, None, "N2", "N2")]
    unknown = [(1001, 1, 19000101, _day("2021-01-25"), "T", "CH", 1002), (102, 30, _key("2021-01-12"), _day("2021-01-12"), "T", "CH", 1)]
    return (customers.union(spark.createDataFrame(people, customers.schema)),
            conversions.union(spark.createDataFrame(more + unknown, conversions.schema)), orders, dates)


@pytest.mark.parametrize("variant", ["capped", "open"])
@pytest.mark.parametrize("stored", [False, True])
def test_repeated_keys_match_sql(spark, variant, stored):
    frames = _dirty_frames(spark)
    prepared = lifetime.prepare(*frames, store="repeats_work" if stored else None, partitions=3)
    got = lifetime.lifetime_rows(prepared, CAP, variant)
    s_rows = _rows(got.columns, [tuple(r) for r in got.collect()])
    d_cols, d_rows = _duck(frames, variant == "capped")
    # pandas has no integer null: ids of customers without one arrive as floats.
    plain = lambda rows: sorted((tuple(None if v != v else int(v) if isinstance(v, float) and v == int(v) else v for v in r) for r in rows), key=repr)
    assert plain(s_rows) == plain(_rows(d_cols, d_rows))
    if stored:
        for part in ("dated", "weekly"):
            spark.sql(f"DROP TABLE repeats_work_{part}")


def test_counters_by_hand(spark):
    out = lifetime.customer_weekly_lifetime(*_dirty_frames(spark), as_of=CAP).collect()
    # Three keys of customer 2, none with a conversion: counters 1, 2, 3.
    assert sorted(r.week_counter for r in out if r.customer_id == 2) == [1, 2, 3]
    # Conversion 102 of customer 1 in three intervals: numbered through, sums go on.
    rows = sorted((r for r in out if r.customer_id == 1 and r.conversion_id == 102 and r.order_week), key=lambda r: r.week_counter)
    # Its rows match several orders in all, so each week appears as often.
    copies = [r.week_counter for r in rows].count(1)
    assert copies > 1
    weeks = [rows[i:i + copies] for i in range(0, len(rows), copies)]
    assert [{r.week_counter for r in w} for w in weeks] == [{i + 1} for i in range(len(weeks))]
    assert [r.order_week for r in rows] == sorted(r.order_week for r in rows)
    assert len({r.conversion_number for r in rows}) == 3
    total = 0
    for w in weeks:
        total += sum(r.total_paid_in_week for r in w)
        assert {r.conversion_cumulative_revenue for r in w} == {total}


def test_spine_counters_match_the_table(spark):
    customers, conversions, orders, dates = _dirty_frames(spark)
    for variant in ("capped", "open"):
        base = lifetime.conversion_base(customers, conversions, dates)
        spine = lifetime.weekly_spine(base, dates, CAP, variant).select("customer_id", "conversion_number", "order_week", "week_counter")
        table = lifetime.customer_weekly_lifetime(customers, conversions, orders, dates, CAP, variant).select(*spine.columns).distinct()
        # Rows without a week may take their group's places in any order.
        assert spine.where("order_week IS NOT NULL").exceptAll(table).isEmpty()
        assert table.where("order_week IS NOT NULL").exceptAll(spine).isEmpty()
        places = lambda df: sorted((r.customer_id or -1, r.week_counter) for r in df.where("order_week IS NULL").collect())
        assert places(spine) == places(table)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_plan_moves_neither_side(spark):
    """Bucketed by customer: no exchange of conversions, spine or weekly orders,
    no hash join that cannot spill, one explode."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prepared = lifetime.prepare(*_frames(spark), store="plan_work", partitions=3)
        # The rows with weeks; those without are told apart by their constant week.
        plan = _plan(lifetime.lifetime_rows(prepared, CAP).where("order_week IS NOT NULL"))
        assert "ShuffledHashJoin" not in plan and "CartesianProduct" not in plan
        assert len(re.findall(r"Generate explode|Generate posexplode", plan)) == 1
        exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "_ck" in line]
        assert not exchanges, exchanges
        whole = _plan(lifetime.lifetime_rows(prepared, CAP))
        assert len(re.findall(r"Generate explode|Generate posexplode", whole)) == 1 and "ShuffledHashJoin" not in whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for part in ("dated", "weekly"):
            spark.sql(f"DROP TABLE IF EXISTS plan_work_{part}")


def test_large_date_tables_are_not_forced_to_broadcast(spark, monkeypatch):
    from tillroll.sources import calendar

    customers, conversions, orders, dates = _frames(spark)
    plain = spark.createDataFrame(dates.collect(), dates.schema)
    monkeypatch.setattr(calendar.within_limit, "__defaults__", (10,))
    assert "ResolvedHint" not in lifetime.weekly_orders(orders, plain, customers)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(calendar.within_limit, "__defaults__", (100,))
    assert "ResolvedHint" in lifetime.weekly_orders(orders, plain, customers)._jdf.queryExecution().analyzed().toString()


def test_weeks_are_made_last(spark):
    """Stretches of weeks are joined, sorted and summed; the weeks made from them are not."""
    lines = _plan(lifetime.customer_weekly_lifetime(*_frames(spark), as_of=CAP).where("order_week IS NOT NULL")).splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert not [line for line in above if re.search(r"Sort|Window|Exchange|Aggregate", line)], above


@pytest.mark.parametrize("variant", ["capped", "open"])
def test_random_facts_match_sql(spark, variant):
    """Weeks with several orders or none, ids that repeat, several keys, unknown dates."""
    import datetime as dt
    import random
    from decimal import Decimal

    rng = random.Random(11)
    customers, conversions, orders, dates = _frames(spark)
    day = lambda: dt.date(2021, 1, 1) + dt.timedelta(days=rng.randrange(90))
    key = lambda d: _key(d.isoformat()) if rng.random() > 0.05 else 19000101
    people = [(k, 100 + k // 2, "F", "L") for k in range(40)]
    conv = [(rng.randrange(60), rng.randrange(40), key(d), d, "T", "CH", n % 55) for n in range(90) for d in [day()]]
    made = [(n, n if n % 9 else n + 1, rng.randrange(40), key(day()), *[Decimal(n % 7 + 1)] * 3) for n in range(260)]
    frames = (spark.createDataFrame(people, customers.schema), spark.createDataFrame(conv, conversions.schema),
              spark.createDataFrame(made, orders.schema), dates)
    got = lifetime.customer_weekly_lifetime(*frames, as_of=CAP, variant=variant)
    same = [i for i, c in enumerate(lifetime.SINK_COLUMNS)]
    plain = lambda rows: sorted((tuple(None if v != v else int(v) if isinstance(v, float) and v == int(v) else v for v in (r[i] for i in same)) for r in rows), key=repr)
    cols, rows = _duck(frames, variant == "capped")
    assert plain(_rows(got.columns, [tuple(r) for r in got.collect()])) == plain(_rows(cols, rows))
