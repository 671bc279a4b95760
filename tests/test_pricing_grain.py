from conftest import D, d, sales
from tillroll.operators import grain, pricing
from tillroll.plans.price_history import price_history


def test_price_changes_history(spark):
    rows = [
        (1, "2021-01-10", "10:00:00", "A", 1, "1.00"),   # first month: a change
        (2, "2021-02-10", "10:00:00", "A", 1, "1.00"),   # no change
        (3, "2021-03-10", "10:00:00", "A", 1, "1.20"),   # change
        (4, "2021-06-10", "10:00:00", "A", 1, "1.00"),   # change back, months skipped
        (5, "2021-01-10", "10:00:00", "B", 1, None),     # first price NULL: not a change
        (6, "2021-02-10", "10:00:00", "B", 1, "2.00"),
    ]
    out = pricing.price_changes(sales(spark, rows)).orderBy("article", "year_month").collect()
    got = [(r.article, r.year_month, r.month_price, r.previous_price) for r in out]
    assert got == [("A", "2021-01", D("1.00"), None), ("A", "2021-03", D("1.20"), D("1.00")),
                   ("A", "2021-06", D("1.00"), D("1.20")), ("B", "2021-02", D("2.00"), None)]


def test_price_history_pipeline_fans_out_returning_price(spark):
    rows = [(1, "2021-01-10", "10:00:00", "A", 1, "1.00"),
            (2, "2021-03-10", "10:00:00", "A", 1, "1.20"),
            (3, "2021-06-10", "10:00:00", "A", 2, "1.00")]
    out = price_history(sales(spark, rows), n=5).collect()
    got = sorted((r.article, r.unit_price, r.price_revenue, r.year_month) for r in out)
    assert got == [("A", D("1.00"), D("3.00"), "2021-01"), ("A", D("1.00"), D("3.00"), "2021-06"),
                   ("A", D("1.20"), D("1.20"), "2021-03")]
    assert spark.table("price_table").count() == 3


def test_grain_violations_and_literal_form(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (2, 21), (None, 1), (None, 2), (3, None)],
                               "order_number long, fk_product long")
    got = {tuple(r) for r in grain.grain_violations(df, "order_number", "fk_product").collect()}
    assert got == {(None, 2), (2, 2)}
    assert grain.grain_violations(df, ["order_number", "fk_product"], "fk_product").count() == 0
    # max_distinct=0 lists every key with a non-NULL value
    assert grain.grain_violations(df, "order_number", "fk_product", 0).count() == 3


def test_orphan_rows_include_null_keys(spark):
    left = spark.createDataFrame([(1, 100), (2, 200), (3, None)], "conversion_id long, order_number long")
    right = spark.createDataFrame([(100,), (100,)], "order_number long")
    got = sorted(r.conversion_id for r in grain.orphan_rows(left, right, "order_number").collect())
    assert got == [2, 3]


def test_first_week_mismatch(spark):
    dates = spark.createDataFrame([(20210104, d("2021-01-04"), "2021-W01"), (20210111, d("2021-01-11"), "2021-W02")],
                                  "sk_date long, d date, year_week string")
    conv = spark.createDataFrame(
        [(1, 20210104, 10), (2, 20210104, 20), (3, 20210104, 99), (None, 20210104, 10)],
        "fk_customer long, fk_conversion_date long, order_number long")
    orders = spark.createDataFrame([(10, 20210104), (20, 20210111)], "order_number long, fk_order_date long")
    got = sorted((r.fk_customer or 0, r.first_conversion_week, r.first_order_week)
                 for r in grain.first_week_mismatch(conv, orders, dates).collect())
    # customer 2: order a week later; 3: order unknown; NULL customer never joins
    assert got == [(0, "2021-W01", None), (2, "2021-W01", "2021-W02"), (3, "2021-W01", None)]
