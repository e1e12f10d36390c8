"""Flagship query: top skills per city over cleaned postings.

source -> normalisation -> dedup -> explode -> aggregate -> per-group top-k.
Shuffles: one for the dedup (partial aggregation first), one for the
(city, skill) counts (city sizes come out of the same aggregate); the top-k
and the join to city sizes run on aggregated frames of cities x skills rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators import demand as D


def skill_demand_by_city(cleaned: DataFrame, k: int = 5, city_col: str = "city_standardized",
                         skills_col: str = "skills_normalized") -> DataFrame:
    """Top-k skills per city with each skill's share of the city's postings.

    One aggregate gives both numbers: every posting contributes its skills
    plus one null marker, so the (city, null) count is the city's posting
    count. The cleaned postings are scanned once.
    """
    counts = D.group_skill_counts(cleaned, city_col, skills_col).withColumnRenamed("grp", "city")
    sizes = counts.where(F.col("skill").isNull()).select("city", F.col("count").alias("city_postings"))
    pairs = counts.where(F.col("skill").isNotNull())
    ranked = D.top_k_per_group(pairs, "city", [F.col("count").desc(), F.col("skill")], k)
    return (ranked.join(sizes, "city")
            .select("city", "skill", "count", "city_postings",
                    F.round(F.col("count") * 100.0 / F.col("city_postings"), 4).alias("percentage"), "rank"))
