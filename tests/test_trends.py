import datetime as dt

from pyspark.sql import functions as F

from postlens.operators import trends as T


def _snap(spark, rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), k, c) for d, k, c in rows],
                                 "snapshot_date date, key string, count bigint")


def test_forecast_signs_and_skips(spark):
    snap = _snap(spark, [("2026-01-01", "up", 1), ("2026-01-02", "up", 3), ("2026-01-03", "up", 5),
                         ("2026-01-01", "flat", 4), ("2026-01-02", "flat", 4),
                         ("2026-01-01", "once", 9)])
    fc = {r["key"]: r for r in T.forecast(T.series(snap), horizon_days=10).collect()}
    assert set(fc) == {"up", "flat"}
    assert fc["up"]["growth_rate"] == 2.0 and fc["up"]["confidence"] == 1.0
    assert fc["up"]["predicted_count"] == 25.0 and fc["up"]["current_count"] == 5
    assert fc["flat"]["growth_rate"] == 0.0 and fc["flat"]["confidence"] == 0.0
    classes = {r["key"]: r["growth_class"] for r in T.growth_classes(T.forecast(T.series(snap))).collect()}
    assert classes == {"up": "rising", "flat": "stable"}


def test_declining_floor_at_zero(spark):
    snap = _snap(spark, [("2026-01-01", "d", 10), ("2026-01-02", "d", 5)])
    r = T.forecast(T.series(snap), horizon_days=90).collect()[0]
    assert r["predicted_count"] == 0.0 and r["growth_rate"] == -5.0


def test_compare_periods(spark):
    snap = _snap(spark, [("2026-01-01", "a", 5), ("2026-01-01", "b", 5), ("2026-01-02", "a", 8), ("2026-01-02", "c", 1)])
    got = {(r["kind"], r["key"]): r for r in T.compare_periods(snap).collect()}
    assert got[("total", None)]["change"] == -1 and got[("total", None)]["change_percent"] == -10.0
    assert got[("key", "a")]["change"] == 3 and got[("key", "b")]["trend"] == "down"
    assert [r["key"] for r in T.new_keys(snap).collect()] == ["c"]


def test_empty_history(spark):
    snap = _snap(spark, [("2026-01-01", "a", 1)]).limit(0)
    assert T.forecast(T.series(snap)).count() == 0


def test_top_ten_is_what_a_snapshot_holds(spark):
    rows = [("2026-01-01", f"k{i:02d}", 100 - i) for i in range(12)] + [("2026-01-02", f"k{i:02d}", 100 - i) for i in range(9)]
    rows += [("2026-01-02", "k11", 200), ("2025-06-01", "old", 5)]
    snap = spark.createDataFrame(rows, "d string, key string, count long").selectExpr("cast(d as date) as snapshot_date", "key", "count")
    got = {r["key"]: (r["previous"], r["current"]) for r in T.compare_periods(snap).where("kind = 'key'").collect()}
    assert got == {"k11": (0, 200), "k09": (91, 0)}
    full = {r["key"]: (r["previous"], r["current"]) for r in T.compare_periods(snap, full_counts=True).where("kind = 'key'").collect()}
    assert full == {"k11": (89, 200), "k09": (91, 0), "k10": (90, 0)}
    assert "k10" not in {r["key"] for r in T.series(snap).collect()} and "k10" in {r["key"] for r in T.series(snap, full_counts=True).collect()}
    assert "old" in {r["key"] for r in T.series(snap).collect()} and "old" not in {r["key"] for r in T.series(snap, days=30).collect()}


def test_sketches_of_days_make_those_of_spans(spark):
    rows = spark.range(60_000).selectExpr("timestamp_seconds(id * 60) as ts", "cast(id * 7919 % 9001 as string) as user", "if(id % 3 = 0, null, id % 5) as kind")
    days = T.sketch_snapshot(rows, "ts", {"users": "user", "kinds": "kind"})
    got = {(r.span, r.list): r.estimate for r in T.distincts_over(days, F.month("snapshot_date")).collect()}
    for r in rows.groupBy(F.month("ts").alias("m")).agg(F.count_distinct("user").alias("users"), F.count_distinct("kind").alias("kinds")).collect():
        assert abs(got[r.m, "users"] - r.users) <= 0.049 * r.users and got[r.m, "kinds"] == r.kinds
    assert {r.estimate for r in T.distincts_over(days, F.lit(1)).where("list = 'kinds'").collect()} == {5}
