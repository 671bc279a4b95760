from decimal import Decimal

import pytest

from tillroll.sinks import refresh_table, snapshot

DDL = "id INT, name VARCHAR(255), amount DECIMAL(18,2)"


def test_refresh_recreate_rounds_and_reads_back(spark):
    df = spark.createDataFrame([(1, "a", Decimal("1.235"))], "x long, y string, z decimal(10,3)")
    refresh_table(spark, df, "t360.recreated", DDL, mode="recreate")
    r = spark.table("t360.recreated").first()
    assert (r.id, r.name, r.amount) == (1, "a", Decimal("1.24"))
    assert [f.name for f in spark.table("t360.recreated").schema.fields] == ["id", "name", "amount"]


def test_failed_refresh_keeps_old_table(spark):
    good = spark.createDataFrame([(1, "a", Decimal("1.00"))], "x long, y string, z decimal(10,2)")
    refresh_table(spark, good, "t360.kept", DDL, mode="truncate")
    too_long = spark.createDataFrame([(2, "x" * 256, Decimal("1.00"))], "x long, y string, z decimal(10,2)")
    with pytest.raises(Exception):
        refresh_table(spark, too_long, "t360.kept", DDL, mode="truncate")
    overflow = spark.createDataFrame([(2 ** 40, "b", Decimal("1.00"))], "x long, y string, z decimal(10,2)")
    with pytest.raises(Exception):
        refresh_table(spark, overflow, "t360.kept", DDL, mode="recreate")
    assert [tuple(r) for r in spark.table("t360.kept").collect()] == [(1, "a", Decimal("1.00"))]


def test_truncate_mode_replaces_rows(spark):
    one = spark.createDataFrame([(1, "a", Decimal("1.00"))], "x long, y string, z decimal(10,2)")
    two = spark.createDataFrame([(2, "b", Decimal("2.00")), (3, "c", None)], "x long, y string, z decimal(10,2)")
    refresh_table(spark, one, "t360.trunc", DDL, mode="truncate")
    refresh_table(spark, two, "t360.trunc", DDL, mode="truncate")
    assert sorted(r.id for r in spark.table("t360.trunc").collect()) == [2, 3]


def test_failed_commit_keeps_old_rows(spark, monkeypatch):
    from tillroll import sinks
    good = spark.createDataFrame([(1, "a", Decimal("1.00"))], "x long, y string, z decimal(10,2)")
    refresh_table(spark, good, "t360.swap", DDL)
    real = type(spark).sql

    def sql(self, text, *a, **k):
        if text.startswith("CREATE OR REPLACE VIEW"):
            raise RuntimeError("commit failed")
        return real(self, text, *a, **k)

    for mode in sinks.MODES:
        monkeypatch.setattr(type(spark), "sql", sql)
        with pytest.raises(RuntimeError):
            refresh_table(spark, good.union(good), "t360.swap", DDL, mode=mode)
        monkeypatch.undo()
        assert spark.table("t360.swap").count() == 1
    assert len([t.name for t in spark.catalog.listTables("t360") if "swap__v" in t.name]) == 1


@pytest.mark.parametrize("mode", ["recreate", "truncate"])
def test_reader_sees_old_or_new_rows_at_every_step(spark, monkeypatch, mode):
    one = spark.createDataFrame([(1, "a", Decimal("1.00"))], "x long, y string, z decimal(10,2)")
    two = spark.createDataFrame([(2, "b", Decimal("2.00")), (3, "c", None)], "x long, y string, z decimal(10,2)")
    name = f"t360.gapless_{mode}"
    refresh_table(spark, one, name, DDL)
    began = spark.table(name)  # a query that a reader has planned before the refresh
    real, seen = type(spark).sql, []

    def sql(self, text, *a, **k):
        seen.append(sorted(r.id for r in self.table(name).collect()))
        out = real(self, text, *a, **k)
        seen.append(sorted(r.id for r in self.table(name).collect()))
        return out

    monkeypatch.setattr(type(spark), "sql", sql)
    refresh_table(spark, two, name, DDL, mode=mode)
    monkeypatch.undo()
    assert set(map(tuple, seen)) == {(1,), (2, 3)}
    assert seen == sorted(seen)  # old first, then new
    assert [r.id for r in began.collect()] == [1]


def test_versions_are_kept_and_dropped(spark):
    from tillroll import sinks
    frame = lambda i: spark.createDataFrame([(i, "a", None)], "x long, y string, z decimal(10,2)")
    spark.sql("CREATE SCHEMA IF NOT EXISTS t360")
    spark.sql("CREATE TABLE t360.aged (id INT, name VARCHAR(3), amount DECIMAL(18,2)) USING parquet")
    spark.sql("INSERT INTO t360.aged VALUES (0, 'old', NULL)")  # a plain table of an earlier release
    for i in (1, 2, 3):
        refresh_table(spark, frame(i), "t360.aged", DDL, mode="truncate")
        assert [r.id for r in spark.table("t360.aged").collect()] == [i]
        left = sinks.versions(spark, "t360.aged")
        assert len(left) == 2 and left[-1] == sinks.current_version(spark, "t360.aged")
    with pytest.raises(Exception):  # the definition of the plain table is still kept
        refresh_table(spark, spark.createDataFrame([(1, "four", None)], "x long, y string, z decimal(10,2)"), "t360.aged", DDL, mode="truncate")
    # A version that another refresh is writing is not dropped.
    sinks.create_table(spark, "t360.aged__v00000000000000000001_other", DDL)
    sinks.drop_old_versions(spark, "t360.aged", keep=0)
    assert spark.catalog.tableExists("t360.aged__v00000000000000000001_other")
    sinks.drop_result(spark, "t360.aged")
    assert not spark.catalog.tableExists("t360.aged") and sinks.versions(spark, "t360.aged") == []


def test_rows_can_be_refused_before_the_commit(spark):
    good = spark.createDataFrame([(1, "a", None)], "x long, y string, z decimal(10,2)")
    refresh_table(spark, good, "t360.gate", DDL)

    def refuse(written):
        assert written.count() == 2
        raise ValueError("refused")

    with pytest.raises(ValueError):
        refresh_table(spark, good.union(good), "t360.gate", DDL, before_commit=refuse)
    assert spark.table("t360.gate").count() == 1


def test_truncate_keeps_a_narrower_definition(spark):
    refresh_table(spark, spark.createDataFrame([("abc",)], "x string"), "t360.narrow", "name VARCHAR(3)")
    with pytest.raises(Exception):
        refresh_table(spark, spark.createDataFrame([("abcdef",)], "x string"), "t360.narrow", "name VARCHAR(255)", mode="truncate")
    assert [r.name for r in spark.table("t360.narrow").collect()] == ["abc"]


def test_three_part_name(spark):
    refresh_table(spark, spark.createDataFrame([(1,)], "x int"), "spark_catalog.t360.three", "x INT")
    assert spark.table("spark_catalog.t360.three").count() == 1


def test_snapshot_is_frozen(spark):
    src = spark.createDataFrame([(1,)], "x int")
    snap = snapshot(src, "snap_view")
    assert spark.table("snap_view").count() == 1 and snap.count() == 1


def test_rows_at_a_location_outlive_the_table(spark, tmp_path):
    from tillroll.sinks import drop_result, refresh_table

    name = "located.result"
    for mode in ("recreate", "truncate"):
        refresh_table(spark, spark.range(5).toDF("n"), name, "n BIGINT", mode=mode, location=str(tmp_path))
    rows = spark.table(name)
    drop_result(spark, name)
    assert not spark.catalog.tableExists(name)
    assert sorted(r.n for r in rows.collect()) == [0, 1, 2, 3, 4]


def test_stored_rows_are_read_from_files_not_copied(spark):
    import os

    import pytest

    from tillroll.plans import registry

    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("test data not present")
    rows = registry.build()["refresh_stored_rows"](spark, base)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert rows.count() == registry.build()["lifetime_capped"](spark, base).count()
