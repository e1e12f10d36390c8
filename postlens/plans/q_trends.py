"""Registered queries: snapshots, comparisons, series, forecasts (I1-I7) on ``events``.

A day's event counts per user play the role of a snapshot's skill counts (30 days
in the driver's table, many more than 10 users a day), so that top-10 lists matter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import trends as T
from postlens.operators.search import latest_partition
from postlens.plans.registry import query
from postlens.session import stored
from postlens.sources import fixtures

_SNAP = ("snap AS (SELECT CAST(ts AS DATE) AS snapshot_date, CAST(user_id AS VARCHAR) AS key, count(*) AS count FROM events "
         "GROUP BY 1, 2), dates AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) AS date_rank "
         "FROM (SELECT DISTINCT snapshot_date FROM snap)), tops AS (SELECT snapshot_date, key, count FROM (SELECT *, row_number() OVER "
         "(PARTITION BY snapshot_date ORDER BY count DESC, key) AS r FROM snap) WHERE r <= 10)")


def _snap(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string"))
    return T.daily_snapshots(ev, "ts", "user")


@query("daily_snapshots", "I1", oracle="WITH " + _SNAP + " SELECT snapshot_date, key, count FROM snap")
def q_daily_snapshots(spark, sf_dir):
    return _snap(spark, sf_dir)


_LISTS = {"users": "user_id", "types": "event_type"}


@query("run_snapshot", "I1", oracle="WITH d AS (SELECT CAST(ts AS DATE) AS snapshot_date, count(*) AS total FROM events GROUP BY 1)" + "".join(
    f", {n}0 AS (SELECT CAST(ts AS DATE) AS snapshot_date, CAST({c} AS VARCHAR) AS key, count(*) AS count FROM events WHERE {c} IS NOT NULL GROUP BY 1, 2), "
    f"{n}1 AS (SELECT snapshot_date, count(*) AS u FROM {n}0 GROUP BY 1), "
    f"{n}2 AS (SELECT snapshot_date, string_agg(key || ':' || count, ',' ORDER BY count DESC, key) AS t FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY snapshot_date ORDER BY count DESC, key) AS r FROM {n}0) WHERE r <= 10 GROUP BY 1)" for n, c in _LISTS.items()) + (
    " SELECT d.snapshot_date, d.total, users1.u AS unique_users, users2.t AS top_users, types1.u AS unique_types, types2.t AS top_types FROM d "
    "LEFT JOIN users1 USING (snapshot_date) LEFT JOIN users2 USING (snapshot_date) LEFT JOIN types1 USING (snapshot_date) "
    "LEFT JOIN types2 USING (snapshot_date)"))
def q_run_snapshot(spark, sf_dir):
    out = T.run_snapshot(fixtures.table(spark, sf_dir, "events"), "ts", _LISTS)
    for n in _LISTS:
        out = out.withColumn(f"top_{n}", F.array_join(F.transform(f"top_{n}", lambda x: F.concat_ws(":", x["key"], x["count"])), ","))
    return out


@query("latest_snapshot", "H6", oracle="WITH " + _SNAP + " SELECT key, count FROM snap WHERE snapshot_date = (SELECT max(snapshot_date) FROM snap)")
def q_latest_snapshot(spark, sf_dir):
    return latest_partition(_snap(spark, sf_dir)).select("key", "count")


# The estimate is compared with the exact count: three standard errors of a sketch with 2^12 buckets are 4.9 %.
@query("sketched_distincts", "I1", oracle=(
    "SELECT date_trunc('week', ts)::DATE AS span, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1"))
def q_sketched_distincts(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    week = F.to_date(F.date_trunc("week", F.col("snapshot_date"))).alias("span")
    estimate = T.distincts_over(stored(T.sketch_snapshot(ev, "ts", {"users": "user_id"}), "sketches"), week)
    exact = ev.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("span")).agg(F.count_distinct("user_id").alias("exact"))
    return exact.join(estimate, "span").select("span", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.049 * F.col("exact")).alias("close"))


@query("compare_periods", "I2", oracle="WITH " + _SNAP + (
    ", r AS (SELECT s.*, d.date_rank FROM snap s JOIN dates d USING (snapshot_date) WHERE d.date_rank <= 2), "
    "rt AS (SELECT s.*, d.date_rank FROM tops s JOIN dates d USING (snapshot_date) WHERE d.date_rank <= 2), "
    "k AS (SELECT coalesce(c.key, p.key) AS key, coalesce(c.count, 0) AS current, coalesce(p.count, 0) AS previous "
    "FROM (SELECT * FROM rt WHERE date_rank = 1) c FULL OUTER JOIN (SELECT * FROM rt WHERE date_rank = 2) p ON c.key = p.key), "
    "kk AS (SELECT *, current - previous AS change FROM k WHERE current - previous <> 0 ORDER BY abs(current - previous) DESC, key LIMIT 10), "
    "t AS (SELECT coalesce(sum(count) FILTER (WHERE date_rank = 1), 0) AS current, "
    "coalesce(sum(count) FILTER (WHERE date_rank = 2), 0) AS previous FROM r) "
    "SELECT 'total' AS kind, NULL::VARCHAR AS key, current, previous, current - previous AS change, "
    "CASE WHEN previous > 0 THEN round((current - previous) / previous * 100 * 10) / 10 ELSE 0.0 END AS change_percent, "
    "CASE WHEN current > previous THEN 'up' WHEN current < previous THEN 'down' ELSE 'flat' END AS trend, NULL::INTEGER AS rank FROM t "
    "UNION ALL SELECT 'key', key, current, previous, change, NULL::DOUBLE, CASE WHEN change > 0 THEN 'up' ELSE 'down' END, "
    "CAST(row_number() OVER (ORDER BY abs(change) DESC, key) AS INTEGER) FROM kk"))
def q_compare_periods(spark, sf_dir):
    return T.compare_periods(_snap(spark, sf_dir))


@query("new_top_users", "I3", oracle=(
    "WITH snap AS (SELECT CAST(ts AS DATE) AS snapshot_date, CAST(user_id AS VARCHAR) AS key, count(*) AS count FROM events GROUP BY 1, 2), "
    "dates AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date DESC) AS date_rank FROM (SELECT DISTINCT snapshot_date FROM snap)), "
    "tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY count DESC, key) AS r FROM snap) WHERE r <= 10) "
    "SELECT key FROM tops JOIN dates USING (snapshot_date) WHERE date_rank = 1 AND key NOT IN "
    "(SELECT key FROM tops JOIN dates USING (snapshot_date) WHERE date_rank = 2) ORDER BY key LIMIT 10"))
def q_new_top_users(spark, sf_dir):
    return T.new_keys(_snap(spark, sf_dir))


_SERIES = _SNAP + ", ser AS (SELECT key, snapshot_date, count FROM tops JOIN dates USING (snapshot_date) WHERE date_rank <= 30)"


@query("skill_series", "I4", oracle="WITH " + _SERIES + " SELECT * FROM ser")
def q_skill_series(spark, sf_dir):
    return T.series(_snap(spark, sf_dir))


_FC = _SERIES + (
    ", xs AS (SELECT key, CAST(date_diff('day', min(snapshot_date) OVER (PARTITION BY key), snapshot_date) AS DOUBLE) AS x, "
    "CAST(count AS DOUBLE) AS y FROM ser), "
    "g AS (SELECT key, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, var_pop(y) AS vy, "
    "max(x) AS x_last, arg_max(y, x) AS y_last, count(*) AS points, count(DISTINCT x) AS nx FROM xs GROUP BY key), "
    "fc AS (SELECT key, CAST(y_last AS BIGINT) AS current_count, "
    "round(greatest(0.0, slope * (x_last + 90) + intercept) * 10) / 10 AS predicted_count, "
    "round(slope * 10000) / 10000 AS growth_rate, "
    "round(CASE WHEN vy > 0 THEN greatest(0.0, least(1.0, r2)) ELSE 0.0 END * 1000) / 1000 AS confidence, "
    "points AS data_points FROM g WHERE points >= 2 AND nx >= 2)")


@query("skill_forecast", "I5", oracle="WITH " + _FC + " SELECT * FROM fc")
def q_skill_forecast(spark, sf_dir):
    return T.forecast(T.series(_snap(spark, sf_dir)))


@query("growth_classes", "I6", oracle="WITH " + _FC + (
    " SELECT key, growth_rate, CASE WHEN growth_rate > 0.1 THEN 'rising' WHEN growth_rate < -0.1 THEN 'declining' "
    "ELSE 'stable' END AS growth_class FROM fc"))
def q_growth_classes(spark, sf_dir):
    return T.growth_classes(T.forecast(T.series(_snap(spark, sf_dir))))


@query("first_last_change", "I7", oracle="WITH " + _SERIES + (
    " SELECT key, arg_min(count, snapshot_date) AS first, arg_max(count, snapshot_date) AS last, "
    "arg_max(count, snapshot_date) - arg_min(count, snapshot_date) AS change FROM ser GROUP BY key HAVING count(*) >= 2"))
def q_first_last_change(spark, sf_dir):
    return T.first_last_change(T.series(_snap(spark, sf_dir)))


@query("event_windows_daily", "K3 (batch twin)", oracle=(
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, "
    "event_type AS key, count(*) AS count FROM events GROUP BY 1, 2, 3"))
def q_event_windows_daily(spark, sf_dir):
    from postlens.streaming.jobs import windowed_counts

    out = windowed_counts(fixtures.table(spark, sf_dir, "events"), "ts", "event_type", "daily")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "key", "count")


@query("event_windows_sliding", "K3 (batch twin)", oracle=(
    "WITH b AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS d, event_type FROM events), "
    "w AS (SELECT d - INTERVAL (k) DAY AS window_start, event_type FROM b, range(7) AS r(k)) "
    "SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type AS key, count(*) AS count FROM w GROUP BY 1, 2, 3"))
def q_event_windows_sliding(spark, sf_dir):
    from postlens.streaming.jobs import windowed_counts

    out = windowed_counts(fixtures.table(spark, sf_dir, "events"), "ts", "event_type", "sliding",
                          size="7 days", slide="1 day")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "key", "count")
