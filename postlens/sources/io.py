"""Readers, writers and ingest steps for postings files.

Files are read by Spark (schema given, no inference); "latest file" and
"data status" list files by metadata and read the one that they need.
Writes go to shared storage as part files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    StringType,
    StructField,
    StructType,
)

from postlens.operators.clean import keep_first, keep_last
from postlens.sources.json_array import json_records

# Postings schema (union over the producers); lists are arrays in JSON files and
# comma strings in CSV files.
POSTING_FIELDS = [
    ("job_id", StringType()), ("title", StringType()), ("company", StringType()), ("location", StringType()),
    ("city", StringType()), ("state", StringType()), ("company_type", StringType()), ("company_size", StringType()),
    ("description", StringType()), ("salary_min", DoubleType()), ("salary_max", DoubleType()),
    ("salary_avg", DoubleType()), ("salary", StringType()), ("job_type", StringType()),
    ("experience_level", StringType()), ("post_date", StringType()), ("url", StringType()), ("source", StringType()),
    ("scraped_date", StringType()), ("is_realtime", BooleanType()),
]


def postings_schema(list_type: bool) -> StructType:
    lists = [StructField(c, ArrayType(StringType()) if list_type else StringType()) for c in ("skills", "tags")]
    return StructType([StructField(n, t) for n, t in POSTING_FIELDS] + lists)


LIST_FIELDS = ("skills", "tags")


def _list_from_text(c: str) -> F.Column:
    """A list field read as text: a JSON list, or a comma list."""
    text = F.col(c)
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.when(text.isNotNull(), F.coalesce(parsed, F.split(text, ","))).alias(c)


def read_postings(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A1 + A3: read CSV / JSON / parquet postings by suffix, with a given schema and no inference pass.

    A JSON file holds an array of records or an object with a ``jobs`` array, whatever else stands beside
    it; list fields may be lists or comma strings. A large file is read by many tasks (:mod:`postlens.sources.json_array`).
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        return (spark.read.schema(schema or postings_schema(False))
                .options(header=True, multiLine=True, escape='"', mode="PERMISSIVE").csv(path))
    if fmt == "json":
        target = schema or postings_schema(True)
        lists = [f.name for f in target.fields if isinstance(f.dataType, ArrayType)]
        raw = StructType([StructField(f.name, StringType() if f.name in lists else f.dataType) for f in target.fields])
        rows = json_records(spark, path).select(F.from_json("text", raw).alias("j")).select("j.*")
        return rows.select(*[_list_from_text(f.name) if f.name in lists else F.col(f.name) for f in target.fields])
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {fmt}")


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, modified, length) of the files that match ``glob``: their metadata alone, no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def latest_file(spark: SparkSession, folder: str, globs: str | Sequence[str]) -> str | None:
    """A2: path of the most recently modified file of the first pattern that matches any (ties: the last name)."""
    for glob in [globs] if isinstance(globs, str) else globs:
        newest = list_files(spark, folder, glob).orderBy(F.col("modified").desc(), F.col("path").desc()).first()
        if newest is not None:
            return newest["path"]
    return None


def read_latest(spark: SparkSession, folder: str, glob: str | Sequence[str] = "jobs_*.csv", fmt: str | None = None,
                schema: StructType | None = None) -> DataFrame:
    """A2: rows of the most recently modified file; ``glob`` may list patterns in order of preference."""
    path = latest_file(spark, folder, glob)
    if path is None:
        raise FileNotFoundError(f"no file in {folder} matches {glob}")
    return read_postings(spark, path, fmt, schema)


def data_status(spark: SparkSession, folder: str, as_of: str, glob: str = "jobs_*", fmt: str | None = None,
                stale_hours: float = 24.0) -> DataFrame:
    """File count, latest file, its row count, age in hours, stale flag (``as_of`` given).

    Files are listed by metadata; only the latest is counted (0 if it is empty). Without any file the
    count is 0, the file null and the data stale.
    """
    files = list_files(spark, folder, glob)
    s = files.agg(F.count(F.lit(1)).alias("local_file_count"), F.max(F.struct("modified", "path")).alias("m"))
    path = latest_file(spark, folder, glob)
    n = F.lit(0).cast("long") if path is None else F.lit(read_postings(spark, path, fmt).count()).cast("long")
    age = (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("m.modified")) / 3600.0
    return s.select("local_file_count", F.col("m.path").alias("latest_file"), n.alias("job_count"), age.alias("data_age_hours"),
                    F.coalesce(age > stale_hours, F.lit(True)).alias("is_stale"))


def content_job_id(title: str = "title", company: str = "company", location: str = "location",
                   day: str | None = None):
    """First 12 hex characters of md5("title_company_location_yyyyMMdd"); null prints as None."""
    def part(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    d = F.date_format(F.col(day), "yyyyMMdd") if day else F.date_format(F.current_date(), "yyyyMMdd")
    return F.substring(F.md5(F.concat_ws("_", part(title), part(company), part(location), d)), 1, 12)


def collect_sources(frames: Sequence[DataFrame], order_by: Sequence[str]) -> DataFrame:
    """Union sources with different columns; first row per job_id.

    Frames are listed by priority; ``_src`` records it and leads the order.
    """
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    allrows = tagged[0]
    for t in tagged[1:]:
        allrows = allrows.unionByName(t, allowMissingColumns=True)
    return keep_first(allrows, ["job_id"], ["_src", *order_by]).drop("_src")


def upsert(old: DataFrame, new: DataFrame, key: str = "job_id", order_by: Sequence[str] = ("scraped_at",),
           default_source: str = "linkedin", parts: int | None = None) -> DataFrame:
    """Insert or replace by key, last write wins (new before old on ties).

    Missing keys get a derived id; a missing source gets the default. With ``parts`` the rows also get their ``part``
    (a hash of the key) and are dealt by it and a slice of its keys before they are compared: one shuffle for both the
    comparison and a write partitioned by ``part``, in tasks that need not hold a whole part.
    """
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    if "source" in both.columns:
        both = both.withColumn("source", F.coalesce("source", F.lit(default_source)))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("company", "title") if c in both.columns]
    derived = F.concat_ws("_", *named, F.xxhash64(*[F.col(c) for c in both.columns]).cast("string"))
    both = both.withColumn(key, F.coalesce(F.col(key), derived))
    order = list(dict.fromkeys([*order_by, "_gen"]))
    if parts is None:
        return keep_last(both, [key], order).drop("_gen")
    both = both.withColumns({"part": part_col(key, parts), "_slice": F.pmod(F.crc32(F.col(key).cast("string")), F.lit(PART_SLICES)).cast("int")})
    return keep_last(both.repartition("part", "_slice"), ["part", "_slice", key], order).drop("_gen", "_slice")


PART_SLICES = 8  # tasks that the rows of a part can be dealt to; a write leaves a file per slice at most


def part_col(key: str, parts: int) -> F.Column:
    """The warehouse partition of a key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def job_skill_bridge(df: DataFrame, skills_col: str = "skills_normalized") -> DataFrame:
    """Distinct (job_id, skill) pairs."""
    return df.select("job_id", F.explode(skills_col).alias("skill")).distinct()


def save_postings(df: DataFrame, path: str, fmt: str = "parquet", snapshot_col: str | None = None,
                  backup_as_of: str | None = None) -> None:
    """Save postings; CSV joins list columns with ',', JSON keeps lists.

    With ``backup_as_of`` (a timestamp) a dated copy goes to ``<path>_yyyyMMdd_HHmmss`` too.
    """
    if backup_as_of is not None:
        stamp = backup_as_of.replace("-", "").replace(":", "").replace(" ", "_").replace("T", "_")[:15]
        save_postings(df, f"{path.rstrip('/')}_{stamp}", fmt, snapshot_col)
    out = df
    if fmt == "csv":
        for f in df.schema.fields:
            if isinstance(f.dataType, ArrayType):
                out = out.withColumn(f.name, F.array_join(f.name, ","))
        out.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        out.write.mode("overwrite").json(path)
    else:
        w = out.write.mode("overwrite")
        if snapshot_col:
            w = w.partitionBy(snapshot_col)
        w.parquet(path)


def save_with_report(df: DataFrame, path: str, snapshot_col: str | None = None) -> DataFrame:
    """A9 + B10: save cleaned postings as parquet and return their quality report (:func:`data_quality_report`) without cleaning again.

    Counts and means are observed while the rows are written; the distinct counts read the written columns.
    """
    seen = Observation("quality")
    watched = df.observe(seen, F.count(F.lit(1)).alias("total_records"), F.avg("skill_count").alias("avg_skills_per_job"),
                         F.count_if(F.col("skill_count") == 0).alias("jobs_with_no_skills"))
    save_postings(watched, path, snapshot_col=snapshot_col)
    own, back = seen.get, df.sparkSession.read.schema(df.schema).parquet(path)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, ArrayType)]
    distinct = back.agg(F.count_distinct("title_standardized").alias("unique_titles"), F.count_distinct("company").alias("unique_companies"),
                        F.count_distinct("city_standardized").alias("unique_cities"))
    rows = back.select(*plain).distinct().agg(F.count(F.lit(1)).alias("_distinct"))
    total = F.lit(own["total_records"]).cast("bigint")
    return distinct.crossJoin(rows).select(
        total.alias("total_records"), "unique_titles", "unique_companies", "unique_cities",
        F.lit(own["avg_skills_per_job"]).cast("double").alias("avg_skills_per_job"),
        F.lit(own["jobs_with_no_skills"]).cast("bigint").alias("jobs_with_no_skills"), (total - F.col("_distinct")).alias("duplicate_count"))


def export_all(df: DataFrame, path: str, ts_col: str, exported_at: str, fmt: str = "json") -> None:
    """A10: every posting newest first, and a manifest (exported_at, total_jobs) beside the part files."""
    ordered = df.orderBy(F.col(ts_col).desc_nulls_last())
    save_postings(ordered, f"{path.rstrip('/')}/jobs", fmt)
    df.agg(F.count(F.lit(1)).alias("total_jobs")).withColumn("exported_at", F.lit(exported_at)) \
        .coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/manifest")


def import_latest(spark: SparkSession, folder: str, warehouse: DataFrame | None, glob: str | Sequence[str] = "jobs_*.json",
                  fmt: str | None = None, order_by: Sequence[str] = ("scraped_date",)) -> DataFrame:
    """Read the latest landed file (A2 + A3) and upsert it into the warehouse frame."""
    landed = read_latest(spark, folder, glob, fmt)
    if warehouse is None:
        return keep_last(landed.withColumn("_gen", F.lit(1)), ["job_id"], [*order_by, "_gen"]).drop("_gen")
    return upsert(warehouse, landed, "job_id", order_by)
