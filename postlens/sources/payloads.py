"""Flatten landed API payloads into postings (A4, A5).

The network client is out of scope; these read the JSON the client landed
and turn it into postings with Spark expressions; a large file is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.operators.extract import extract_skills_col
from postlens.sources.json_array import json_records


def flatten_list_payload(spark: SparkSession, path: str, limit: int = 100, as_of: str | None = None) -> DataFrame:
    """A4: a JSON array of objects of which the first is metadata; take objects 1..limit.

    Skills are the boundary-mode matches in the description, plus those in
    each tag; the description is cut to 500 characters.
    """
    nth = F.row_number().over(Window.partitionBy("file").orderBy("block", "seq"))
    items = json_records(spark, path).withColumn("nth", nth).where(F.col("nth") <= limit + 1).where("nth > 1")
    rec = F.from_json("text", "id string, position string, company string, location string, description string, "
                              "tags array<string>, salary_min double, salary_max double, date string, url string")
    j = items.select(rec.alias("r")).select("r.*")
    desc = F.coalesce("description", F.lit(""))
    # Description and each tag are separate texts; joined by a newline (a non-word
    # character) the boundary matches are exactly the union of the per-text ones.
    texts = F.concat_ws("\n", desc, F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\n"))
    skills = extract_skills_col(texts, "boundary", aliases=True, variants=False)
    day = F.lit(as_of) if as_of else F.date_format(F.current_date(), "yyyy-MM-dd")
    return j.select(
        F.concat(F.lit("rok_"), F.coalesce(F.col("id"), F.substring(F.md5(F.concat_ws(
            "_", F.coalesce("position", F.lit("")), F.coalesce("company", F.lit("")), F.lit("Remote"),
            F.regexp_replace(day, "-", ""))), 1, 12))).alias("job_id"),
        F.coalesce("position", F.lit("Unknown")).alias("title"),
        F.coalesce("company", F.lit("Unknown")).alias("company"),
        F.coalesce("location", F.lit("Remote")).alias("location"),
        F.lit("Remote").alias("city"), F.lit("Global").alias("state"),
        F.substring(desc, 1, 500).alias("description"), skills.alias("skills"), "tags",
        "salary_min", "salary_max", F.coalesce("date", day).alias("post_date"),
        F.coalesce("url", F.lit("")).alias("url"), F.lit("RemoteOK").alias("source"))


def flatten_results_payload(spark: SparkSession, path: str, city_key: str, as_of: str | None = None) -> DataFrame:
    """A5: ``{"results": [...]}`` with nested company / location names, city from the dimension."""
    dim = {k: (c, s) for k, c, s in V.CITY_DIM}
    city, state = dim.get(city_key, (city_key.title(), ""))
    schema = ("id string, title string, company struct<display_name: string>, location struct<display_name: string>, "
              "description string, salary_min double, salary_max double, created string, redirect_url string")
    items = json_records(spark, path, "results").select(F.from_json("text", schema).alias("r")).select("r.*")
    desc = F.coalesce(F.col("description"), F.lit(""))
    day = F.lit(as_of) if as_of else F.date_format(F.current_date(), "yyyy-MM-dd")

    def nested(c, field):
        return F.col(f"{c}.{field}")

    return items.select(
        F.concat(F.lit("adzuna_"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("job_id"),
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce(nested("company", "display_name"), F.lit("Unknown")).alias("company"),
        F.coalesce(nested("location", "display_name"), F.lit(city)).alias("location"),
        F.lit(city).alias("city"), F.lit(state).alias("state"),
        F.substring(desc, 1, 500).alias("description"),
        extract_skills_col(desc, "boundary", aliases=True, variants=False).alias("skills"),
        F.col("salary_min").cast("double").alias("salary_min"), F.col("salary_max").cast("double").alias("salary_max"),
        F.coalesce(F.col("created").cast("string"), day).alias("post_date"),
        F.coalesce(F.col("redirect_url"), F.lit("")).alias("url"), F.lit("Adzuna India").alias("source"),
        F.lit(True).alias("is_realtime"))
