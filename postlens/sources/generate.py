"""Distributed synthetic postings.

Rows come from ``spark.range(n)``; every random choice is a hash of the seed and the
row id, so neither the number of partitions nor a rerun changes the output.
Tables are parameters; the defaults are built from the vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.text import literal_array


def _uniform(seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the row id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _weighted(u: Column, items: Sequence[tuple[str, float]]) -> Column:
    total = float(sum(w for _, w in items))
    acc, expr = 0.0, None
    for value, w in items:
        acc += w / total
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(items[-1][0]))


def generate_postings(spark: SparkSession, n: int, seed: int = 42, as_of: str = "2026-01-01", days: int = 30,
                      titles: Sequence[tuple[str, float]] | None = None,
                      cities: Sequence[tuple[str, float]] | None = None,
                      companies: Sequence[str] | None = None,
                      required: dict[str, Sequence[str]] | None = None,
                      optional: Sequence[str] | None = None,
                      partitions: int | None = None) -> DataFrame:
    """Weighted title and city, uniform company, required + 1-4 optional skills,
    post date within the ``days`` before ``as_of``."""
    titles = titles or [(r.title(), 1.0) for r, _, _ in V.SALARY_BASE]
    cities = cities or [(c, 1.0) for _, c, _ in V.CITY_DIM]
    companies = list(companies or [f"Company {i:03d}" for i in range(100)])
    optional = list(optional or V.VOCAB.tech_skills)
    required = required or {}
    base = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(0, n)
    opt = literal_array(optional)
    ranked = F.transform(opt, lambda s: F.struct(F.xxhash64(F.col("id"), F.lit(seed), s).alias("k"), s.alias("s")))
    k_opt = (F.floor(_uniform(seed + 3) * 4) + 1).cast("int")
    req_map = F.create_map(*[x for t, skills in required.items() for x in (F.lit(t), literal_array(list(skills)))]) \
        if required else None
    title = _weighted(_uniform(seed), titles)
    df = base.select(
        "id",
        title.alias("title"),
        _weighted(_uniform(seed + 1), cities).alias("city"),
        F.element_at(literal_array(companies), (F.floor(_uniform(seed + 2) * len(companies)) + 1).cast("int"))
        .alias("company"),
        F.transform(F.slice(F.array_sort(ranked), 1, k_opt), lambda x: x["s"]).alias("_opt"),
        F.date_sub(F.to_date(F.lit(as_of)), (F.floor(_uniform(seed + 4) * days)).cast("int")).alias("post_date"),
    )
    req = F.coalesce(F.element_at(req_map, F.col("title")), F.array().cast("array<string>")) if req_map is not None \
        else F.array().cast("array<string>")
    return df.select(
        F.concat(F.lit("gen_"), F.col("id").cast("string")).alias("job_id"), "title", "company",
        F.concat_ws(", ", "city", F.lit("India")).alias("location"), "city",
        F.array_distinct(F.concat(req, F.col("_opt"))).alias("skills"),
        F.date_format("post_date", "yyyy-MM-dd").alias("post_date"), F.lit("sample").alias("source"))
