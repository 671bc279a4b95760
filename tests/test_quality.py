from pyspark.sql import functions as F

from conftest import sales
from tillroll.operators import quality

ROWS = [
    (1, "2021-01-01", "10:00:00", "A", 1, "1.00"),
    (1, "2021-01-01", "10:00:00", ".", 1, None),
    (2, "2021-01-02", "11:00:00", "B", 2, "2.00"),
    (3, None, None, None, None, None),
    (3, None, None, None, None, None),
] + [(4, "2021-01-03", "12:00:00", "C", -1, "0.00")] * 5


def test_null_profile(spark):
    r = quality.null_profile(sales(spark, ROWS), ["ticket_number", "sale_date", "article", "unit_price"]).first()
    assert r.asDict() == {"total_rows": 10, "missing_ticket_number": 0, "missing_sale_date": 2,
                          "missing_article": 2, "missing_unit_price": 3}


def test_rows_sharing_key(spark):
    out = quality.rows_sharing_key(sales(spark, ROWS), "ticket_number", F.col("unit_price").isNull())
    assert sorted((r.ticket_number, r.article) for r in out.collect()) == \
        [(1, "."), (1, "A"), (3, None), (3, None)]


def test_duplicate_groups_nulls_are_equal(spark):
    cols = ["ticket_number", "sale_date", "sale_time", "article", "quantity", "unit_price"]
    out = quality.duplicate_groups(sales(spark, ROWS), cols).collect()
    assert [(r.ticket_number, r.duplicate_count) for r in out] == [(4, 5), (3, 2)]


def test_drill_down_order_and_columns(spark):
    s = sales(spark, ROWS)
    neg = quality.drill_down(s, F.col("quantity") < 0)
    assert neg.count() == 5
    low = quality.drill_down(s, F.col("unit_price") <= 0, ["unit_price", "ticket_number"],
                             cols=["ticket_number", "unit_price"]).collect()
    assert {tuple(r) for r in low} == {(4, __import__("decimal").Decimal("0.00"))}
    rng = quality.drill_down(s, F.col("ticket_number").between(2, 3)).collect()
    assert [r.ticket_number for r in rng] == [2, 3, 3]


def test_datetime_mismatch_count(spark):
    df = sales(spark, [(1, "2021-01-01", "10:00:00", "A", 1, "1.00"),
                       (2, "2021-01-01", "11:00:00", "A", 1, "1.00"),
                       (3, "2021-01-01", None, "A", 1, "1.00")])
    df = df.withColumn("sale_datetime", F.when(F.col("ticket_number") == 2,
                                               F.to_timestamp_ntz(F.lit("2021-01-01 12:00:00")))
                       .otherwise(F.col("sale_datetime")))
    assert quality.datetime_mismatch_count(df).first().not_aligned == 1


def test_reports_run_on_a_materialized_bucketed_table(spark):
    from tillroll.sources import materialize

    t = materialize(sales(spark, ROWS), "mat_sales", bucket_by="ticket_number", buckets=4)
    assert t.count() == len(ROWS)
    assert quality.duplicate_groups(t, ["ticket_number", "article"]).count() == 2
