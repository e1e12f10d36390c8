"""The postings warehouse (A12, A13, K1): rows are hashed by key into partitions, and an upsert rewrites those alone that its keys touch.

``<path>/rows/part=<n>``  the rows, one per key
``<path>/staged``         the partitions that a commit is about to replace, written whole first
``<path>/log``            a row when a commit is staged, and one when it is done

Replacing partitions is repeated after a failure until the commit is logged as done, always from the staged copy.
So a commit takes effect once, however often it is asked for. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from postlens.sources.io import latest_file, list_files, part_col, read_postings, upsert

LOG = "commit string, step string, at timestamp, parts int, columns string"


class Warehouse:
    """Rows under ``path``, one per ``key``; of rows that share it the last by ``order_by`` stays, a newer commit's on ties."""

    def __init__(self, path: str, key: str = "job_id", order_by: Sequence[str] = ("scraped_at",), parts: int = 64, default_source: str = "linkedin"):
        self.path, self.key, self.order_by, self.parts, self.default_source = path.rstrip("/"), key, list(order_by), parts, default_source

    def _log(self, spark: SparkSession) -> list:
        try:
            log = spark.read.schema(LOG).parquet(f"{self.path}/log")
            return log.groupBy("commit").agg(F.min("at").alias("at"), F.max(F.when(F.col("step") == "done", 1).otherwise(0)).alias("done"),
                                             F.first("parts").alias("parts"), F.first("columns").alias("columns")).orderBy("at").collect()  # a row per commit
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _note(self, spark: SparkSession, commit: str, step: str, columns: StructType) -> None:
        row = spark.range(1).select(F.lit(commit).alias("commit"), F.lit(step).alias("step"), F.current_timestamp().alias("at"),
                                    F.lit(self.parts).alias("parts"), F.lit(columns.json()).alias("columns"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _rows(self, spark: SparkSession, columns: StructType, folder: str = "rows") -> DataFrame:
        return spark.read.schema(StructType([*columns.fields]).add("part", IntegerType())).parquet(f"{self.path}/{folder}")

    def _replace(self, spark: SparkSession, commit: str, columns: StructType) -> None:
        """Put the staged partitions in the place of the old ones; may be repeated."""
        staged = self._rows(spark, columns, "staged")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/rows")
        self._note(spark, commit, "done", columns)

    def _state(self, spark: SparkSession) -> tuple[set[str], StructType | None]:
        """Commits that are done, and the columns; a commit that a failure left staged is finished first."""
        log = self._log(spark)
        if not log:
            return set(), None
        self.parts, columns = log[0]["parts"], StructType.fromJson(json.loads(log[-1]["columns"]))
        if not log[-1]["done"]:
            self._replace(spark, log[-1]["commit"], columns)
        return {r["commit"] for r in log}, columns

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All rows; None before the first commit."""
        _, columns = self._state(spark)
        return None if columns is None else self._rows(spark, columns).drop("part")

    def _keyed(self, df: DataFrame) -> DataFrame:
        """Rows without a key get one from their company, title and a hash of all that they hold."""
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("company", "title") if c in df.columns]
        own = F.concat_ws("_", *named, F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c != self.key]).cast("string"))
        return df.withColumn(self.key, F.coalesce(F.col(self.key), own))

    def upsert(self, new: DataFrame, commit: str) -> bool:
        """Insert or replace ``new`` once under the name ``commit``; False if that was done before."""
        spark = new.sparkSession
        done, columns = self._state(spark)
        if commit in done:
            return False
        if columns is not None:
            old_types = {f.name: f.dataType for f in columns.fields}
            other = [f.name for f in new.schema.fields if f.name in old_types and old_types[f.name] != f.dataType]
            if other:
                raise ValueError(f"columns of another type than the warehouse's: {other}")
        new = self._keyed(new)
        if columns is None:
            merged = upsert(new.limit(0), new, self.key, self.order_by, self.default_source, self.parts)
        else:
            touched = [r[0] for r in new.select(part_col(self.key, self.parts).alias("part")).distinct().collect()]  # as many as there are partitions at most
            old = self._rows(spark, columns).where(F.col("part").isin(touched)).drop("part")
            merged = upsert(old, new, self.key, self.order_by, self.default_source, self.parts)
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/staged")
        columns = StructType([f for f in merged.schema.fields if f.name != "part"])
        self._note(spark, commit, "staged", columns)
        self._replace(spark, commit, columns)
        return True

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: upserts each micro-batch of the query ``name`` once, also when it is replayed."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, f"{name}/{batch_id}")

        return write


def import_into(spark: SparkSession, folder: str, warehouse: Warehouse, glob: str | Sequence[str] = "jobs_*.json", fmt: str | None = None) -> bool:
    """Upsert the latest landed file (A2 + A3), once; False if it was imported before."""
    path = latest_file(spark, folder, glob)
    if path is None:
        raise FileNotFoundError(f"no file in {folder} matches {glob}")
    file = list_files(spark, folder, path.rsplit("/", 1)[-1]).where(F.col("path") == path).first()
    return warehouse.upsert(read_postings(spark, path, fmt), f"{path}@{file['modified']}")
