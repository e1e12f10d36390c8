"""Snapshots, period comparison, series and linear forecasts.

Everything works on a long snapshot table ``(snapshot_date, key, count)``.
Global orderings (last two snapshots, last 30) are computed on the distinct
snapshot dates only -- a few hundred rows -- never on the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.numeric import py_round


def daily_snapshots(df: DataFrame, ts_col: str, key_col: str) -> DataFrame:
    """I1 source: (snapshot_date, key, count) per calendar day."""
    return (df.groupBy(F.to_date(ts_col).alias("snapshot_date"), F.col(key_col).alias("key"))
            .agg(F.count(F.lit(1)).alias("count")))


def record_snapshot(snap: DataFrame, path: str) -> None:
    """Append snapshot rows, partitioned by date (re-running a day replaces it)."""
    (snap.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_date").parquet(path))


def _date_ranks(snap: DataFrame) -> DataFrame:
    dates = snap.select("snapshot_date").distinct()
    return dates.withColumn("date_rank", F.row_number().over(Window.orderBy(F.col("snapshot_date").desc())))


def run_snapshot(df: DataFrame, ts_col: str, lists: dict[str, str], n: int = 10) -> DataFrame:
    """One row per day: total rows, and per list its number of distinct keys and its top ``n`` (key, count).

    ``lists`` maps a list's name to its column (skills, companies, locations). Each
    list is counted with a partial aggregate; null keys are in the total alone.
    """
    day = F.to_date(ts_col).alias("snapshot_date")
    out = df.groupBy(day).agg(F.count(F.lit(1)).alias("total"))
    for name, c in lists.items():
        counts = df.where(F.col(c).isNotNull()).groupBy(day, F.col(c).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("count"))
        distinct = counts.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias(f"unique_{name}"))
        order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "key", "count")))
        top = top_lists(counts, n).groupBy("snapshot_date").agg(
            F.transform(order, lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"))).alias(f"top_{name}"))
        out = out.join(distinct, "snapshot_date", "left").join(top, "snapshot_date", "left") \
            .withColumn(f"unique_{name}", F.coalesce(f"unique_{name}", F.lit(0)))
    return out


def sketch_snapshot(df: DataFrame, ts_col: str, lists: dict[str, str], lg_k: int = 12) -> DataFrame:
    """I1, mergeable: (snapshot_date, list, sketch), a HyperLogLog sketch of each list's keys per day.

    A sketch of 2^lg_k buckets takes some KB, and the union of any days' sketches is the sketch of their rows together, so
    distinct counts over a span need no raw rows. Its standard error is about 1.04 / sqrt(2^lg_k) (1.6 % for 12). Exact
    daily counts stay in :func:`run_snapshot`.
    """
    day = F.to_date(ts_col).alias("snapshot_date")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("list"), F.col(c).cast("string").alias("key")) for name, c in lists.items()]))
    keys = df.select(day, each.alias("x")).select("snapshot_date", "x.list", "x.key").where("key is not null")
    return keys.groupBy("snapshot_date", "list").agg(F.hll_sketch_agg("key", lg_k).alias("sketch"))


def distincts_over(sketches: DataFrame, span: Column) -> DataFrame:
    """(span, list, estimate): distinct keys of each list over the days of each ``span`` (an expression of snapshot_date)."""
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(span.alias("span"), "list").agg(union.alias("estimate"))


def _latest_days(snap: DataFrame, days: int | None) -> DataFrame:
    """Snapshots of the last ``days`` days before the newest one (all when None)."""
    if days is None:
        return snap
    newest = snap.agg(F.max("snapshot_date").alias("_newest"))
    return snap.crossJoin(F.broadcast(newest)).where(F.datediff("_newest", "snapshot_date") < days).drop("_newest")


def compare_periods(snap: DataFrame, top: int = 10, full_counts: bool = False, days: int | None = None) -> DataFrame:
    """Last two snapshots: total change and %, per-key deltas (non-zero, by |delta|, top N).

    A snapshot records its top 10 keys, so a key outside that list counts as 0;
    ``full_counts=True`` compares all keys. Totals are always those of all rows.
    ``days`` leaves out snapshots that are older. Rows: ``kind`` = total | key. change % is 0 when the
    previous total is 0.
    """
    snap = _latest_days(snap, days)
    ranked = snap.join(F.broadcast(_date_ranks(snap).where(F.col("date_rank") <= 2)), "snapshot_date")
    listed = ranked if full_counts else top_lists(ranked, 10)
    cur = listed.where(F.col("date_rank") == 1).select("key", F.col("count").alias("current"))
    prev = listed.where(F.col("date_rank") == 2).select("key", F.col("count").alias("previous"))
    keys = (cur.join(prev, "key", "full_outer")
            .select("key", F.coalesce("current", F.lit(0)).alias("current"),
                    F.coalesce("previous", F.lit(0)).alias("previous"))
            .withColumn("change", F.col("current") - F.col("previous"))
            .where(F.col("change") != 0))
    order = [F.abs(F.col("change")).desc(), F.col("key")]
    keys = (keys.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .select(F.lit("key").alias("kind"), "key", "current", "previous", "change",
                    F.lit(None).cast("double").alias("change_percent"),
                    F.when(F.col("change") > 0, "up").otherwise("down").alias("trend"), "rank"))
    totals = ranked.groupBy("date_rank").agg(F.sum("count").alias("t"))
    tot = totals.agg(F.max(F.when(F.col("date_rank") == 1, F.col("t"))).alias("current"),
                     F.max(F.when(F.col("date_rank") == 2, F.col("t"))).alias("previous"))
    tot = tot.select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("key"),
                     F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("previous", F.lit(0)).alias("previous"))
    tot = tot.withColumn("change", F.col("current") - F.col("previous")).select(
        "kind", "key", "current", "previous", "change",
        F.when(F.col("previous") > 0, py_round(F.col("change") / F.col("previous") * 100, 1)).otherwise(0.0)
        .alias("change_percent"),
        F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat").alias("trend"),
        F.lit(None).cast("int").alias("rank"))
    return tot.unionByName(keys)


def top_lists(snap: DataFrame, n: int = 10) -> DataFrame:
    """Each snapshot's top-N keys (count desc, key asc)."""
    w = Window.partitionBy("snapshot_date").orderBy(F.col("count").desc(), F.col("key"))
    return snap.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def new_keys(snap: DataFrame, n: int = 10, limit: int = 10) -> DataFrame:
    """Keys in the latest top-N list and not in the previous one, by name, at most ``limit``."""
    tops = top_lists(snap.join(F.broadcast(_date_ranks(snap).where(F.col("date_rank") <= 2)), "snapshot_date"), n)
    cur = tops.where(F.col("date_rank") == 1).select("key")
    prev = tops.where(F.col("date_rank") == 2).select("key")
    return cur.join(prev, "key", "left_anti").orderBy("key").limit(limit)


def series(snap: DataFrame, last: int = 30, full_counts: bool = False, days: int | None = None) -> DataFrame:
    """I4: (key, snapshot_date, count) over the last N snapshot dates (within ``days``), from each one's top 10 (or all keys)."""
    snap = _latest_days(snap, days)
    recent = snap.join(F.broadcast(_date_ranks(snap).where(F.col("date_rank") <= last)), "snapshot_date")
    return (recent if full_counts else top_lists(recent, 10)).select("key", "snapshot_date", "count")


def forecast(series_df: DataFrame, horizon_days: int = 90) -> DataFrame:
    """Least-squares line per key; x = days since the key's first date.

    Keys with fewer than 2 points or one distinct date are skipped. Predicted
    count is floored at 0 (1 decimal), slope 4 decimals, R^2 clamped to [0, 1]
    (3 decimals) and 0 for a constant series.
    """
    first = series_df.groupBy("key").agg(F.min("snapshot_date").alias("_d0"))
    s = series_df.join(first, "key").withColumn("x", F.datediff("snapshot_date", "_d0").cast("double")) \
        .withColumn("y", F.col("count").cast("double"))
    g = s.groupBy("key").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.var_pop("y").alias("vy"),
        F.max("x").alias("x_last"), F.max_by("y", "x").alias("y_last"),
        F.count(F.lit(1)).alias("points"), F.count_distinct("x").alias("nx"))
    g = g.where((F.col("points") >= 2) & (F.col("nx") >= 2))
    pred = F.greatest(F.lit(0.0), F.col("slope") * (F.col("x_last") + horizon_days) + F.col("intercept"))
    r2 = F.when(F.col("vy") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2")))).otherwise(0.0)
    return g.select(
        "key", F.col("y_last").cast("bigint").alias("current_count"),
        py_round(pred, 1).alias("predicted_count"), py_round(F.col("slope"), 4).alias("growth_rate"),
        py_round(r2, 3).alias("confidence"), F.col("points").alias("data_points"))


def growth_classes(fc: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Rising (> +t), declining (< -t), else stable -- on the rounded slope."""
    g = F.col("growth_rate")
    return fc.select("key", "growth_rate",
                     F.when(g > threshold, "rising").when(g < -threshold, "declining").otherwise("stable")
                     .alias("growth_class"))


def first_last_change(series_df: DataFrame) -> DataFrame:
    """First and last count per key (by date) and their difference; needs 2+ points."""
    g = series_df.groupBy("key").agg(F.min_by("count", "snapshot_date").alias("first"),
                                     F.max_by("count", "snapshot_date").alias("last"),
                                     F.count(F.lit(1)).alias("points"))
    return g.where(F.col("points") >= 2).select("key", "first", "last", (F.col("last") - F.col("first")).alias("change"))
