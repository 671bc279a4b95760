import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.functions import pg_asc
from tillroll.operators import group_row_number


def test_group_row_number_matches_window_with_hot_key(spark):
    rng = random.Random(3)
    rows = [(1, rng.randint(0, 10_000), i) for i in range(4000)]          # hot key: a third
    rows += [(rng.randint(2, 300), rng.randint(0, 10_000), 10_000 + i) for i in range(7000)]
    rows += [(None, rng.randint(0, 50), 20_000 + i) for i in range(500)]   # NULL group
    df = spark.createDataFrame(rows, "k int, v int, id int")
    got = group_row_number(df, ["k"], [pg_asc("v"), pg_asc("id")], "rn", partitions=6)
    want = df.withColumn("rn", F.row_number().over(
        Window.partitionBy("k").orderBy(pg_asc("v"), pg_asc("id"))))
    assert got.count() == len(rows)
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_group_row_number_with_ties_is_a_bijection(spark):
    df = spark.createDataFrame([(1, 0)] * 50 + [(2, 0)] * 3, "k int, v int")
    got = group_row_number(df, ["k"], ["v"], "rn", partitions=4)
    per = {}
    for r in got.collect():
        per.setdefault(r.k, []).append(r.rn)
    assert sorted(per[1]) == list(range(1, 51)) and sorted(per[2]) == [1, 2, 3]
