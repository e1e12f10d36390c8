"""Hot keys: one city holds a third of all rows; results must equal a brute force."""

from collections import Counter

from pyspark.sql import functions as F

from postlens.operators import clean as C
from postlens.plans.flagship import skill_demand_by_city
from postlens.sources.generate import generate_postings


def _postings(spark):
    cities = [("Bangalore", 1.0 / 3)] + [(c, (2.0 / 3) / 9) for c in
                                         ["Mumbai", "Pune", "Delhi", "Chennai", "Noida", "Gurgaon", "Kolkata",
                                          "Hyderabad", "Ahmedabad"]]
    g = generate_postings(spark, 6000, seed=11, cities=cities, partitions=8)
    return g.select("job_id", "title", "company", F.col("city").alias("location"),
                    F.array_join("skills", ",").alias("skills"), "post_date")


def test_hot_city_share(spark):
    p = _postings(spark)
    share = p.where(F.col("location") == "Bangalore").count() / p.count()
    assert 0.3 < share < 0.37


def test_flagship_on_hot_key_equals_brute_force(spark):
    p = _postings(spark)
    cleaned = C.clean_postings(p, order_by=["job_id"])
    got = {(r["city"], r["skill"]): (r["count"], r["rank"]) for r in skill_demand_by_city(cleaned).collect()}
    rows = cleaned.select("city_standardized", "skills_normalized").collect()
    per_city: dict[str, Counter] = {}
    for r in rows:
        per_city.setdefault(r[0], Counter()).update(r[1])
    want = {}
    for city, cnt in per_city.items():
        for i, (skill, n) in enumerate(sorted(cnt.items(), key=lambda kv: (-kv[1], kv[0]))[:5], 1):
            want[(city, skill)] = (n, i)
    assert got == want


def test_dedup_hot_group_keeps_first(spark):
    p = _postings(spark)
    x = C.standardize_location(C.standardize_title(p))
    out = C.remove_duplicates(x, ["job_id"])
    pdf = x.select("title_standardized", "company", "city_standardized", "job_id").toPandas()
    want = pdf.sort_values("job_id").drop_duplicates(["title_standardized", "company", "city_standardized"])
    got = sorted(r["job_id"] for r in out.collect())
    assert got == sorted(want["job_id"].tolist())
