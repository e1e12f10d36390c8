"""Structured Streaming jobs (K1-K3).

The reference re-runs its whole pipeline on a timer; here the same operators
run incrementally:

* K1 - file-source ingest with a watermark and ``dropDuplicatesWithinWatermark``
  on ``job_id`` (state bounded by the watermark), upserted into the warehouse once per
  micro-batch;
* K2 - alert matching on each new posting: a per-row projection over a literal list, or a
  stateless join with the users' alert table, which is read anew at every trigger;
* K3 - daily, sliding and session counts per key with a watermark; the batch
  twin (``windowed_counts``) is the same expression over a static frame.

Checkpoints go to the folder the caller names (shared storage on a cluster).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.alerts import Alert, join_alert_table, match_alerts
from postlens.sources.warehouse import Warehouse


def event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (local-time-zone) values; parquet may hold TIMESTAMP_NTZ."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def dedup_stream(stream: DataFrame, key: Sequence[str], ts_col: str, delay: str = "1 day") -> DataFrame:
    """K1: drop repeats of ``key`` that arrive within the watermark delay."""
    return event_time(stream, ts_col).withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(list(key))


def alert_stream(stream: DataFrame, alerts: Sequence[Alert], keep: Sequence[str] | None = None) -> DataFrame:
    """K2: (alert, posting, reasons) rows for every new matching posting."""
    return match_alerts(stream, alerts, keep)


def alert_table_stream(stream: DataFrame, alerts: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """K2 with a static table: a stateless stream-static join, for any sink in append mode. The table is as it was when the query began."""
    return join_alert_table(stream, alerts, keep)


def run_alerts(stream: DataFrame, load: Callable[[SparkSession], DataFrame], sink_path: str, checkpoint: str, keep: Sequence[str] | None = None):
    """K2 with a table that users change: ``load`` reads it anew for every micro-batch, so an alert fires on postings that land after it.

    Each micro-batch is one folder of the sink, ``batch_id=<n>``; a replayed one replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = join_alert_table(batch, load(batch.sparkSession), keep)
        found.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")

    return _run_batches(stream, write, checkpoint)


def run_upserts(stream: DataFrame, warehouse: Warehouse, checkpoint: str, name: str = "ingest"):
    """K1 into the warehouse (A12): every micro-batch is upserted once, also when it is replayed after a failure."""
    return _run_batches(stream, warehouse.sink(name), checkpoint)


def _run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(df: DataFrame, ts_col: str, key_col: str, kind: str = "daily", delay: str | None = None,
                    size: str = "1 day", slide: str | None = None, gap: str = "30 minutes") -> DataFrame:
    """K3: counts per key per time window (``daily`` tumbling, ``sliding`` or ``session``).

    With ``delay`` the watermark bounds the state (streaming); the same call
    on a static frame is the batch result the stream must reproduce.
    """
    # Batch: windows over TIMESTAMP_NTZ are wall-clock aligned and independent of
    # the session time zone. Streams need TIMESTAMP for the watermark.
    x = df
    if delay:
        x = event_time(df, ts_col).withWatermark(ts_col, delay)
    if kind == "daily":
        w = F.window(ts_col, size)
    elif kind == "sliding":
        w = F.window(ts_col, size, slide or "1 day")
    elif kind == "session":
        w = F.session_window(ts_col, gap)
    else:
        raise ValueError(kind)
    g = x.groupBy(w.alias("w"), F.col(key_col).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "count")


def run_available(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet",
                  query_name: str | None = None):
    """Process everything available now, then stop (scheduled incremental runs)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if query_name:
        w = w.queryName(query_name)
    if fmt == "memory":
        q = w.format("memory").start()
    else:
        q = w.format(fmt).option("path", sink_path).start()
    q.awaitTermination()
    return q
