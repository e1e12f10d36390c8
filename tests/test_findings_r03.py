"""Plans and results behind F9 to F12 (analysis), F17 (warehouse) and F18 (matching)."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions import needles as K
from postlens.operators import match as M
from postlens.operators import reports as R
from postlens.sources.io import part_col, upsert
from tests.conftest import JOBS


def test_analysis_makes_no_row_per_skill(spark, monkeypatch):
    """Classes and skills of texts are counted without exploding them; short and long term lists agree."""
    seen = []
    monkeypatch.setattr(R, "cut_lineage", lambda df: seen.append(df) or df)
    jobs = spark.createDataFrame([dict(j, job_type="Full-time") for j in JOBS] * 2 + [dict(JOBS[0], description=None, title=None, job_type=None)])
    terms = ("Python", "sql", "react", "", "sql")
    out = R.full_analysis(jobs, terms=terms)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "count(1)" in plan
    got = {(r["section"], r["key"]): r["value"] for r in out.collect()}
    assert {k: v for (s, k), v in got.items() if s == "skills"} == {"Python": 2, "sql": 2, "react": 2}
    assert got["metadata", "total_jobs"] == 7 and got["top_titles", "Data Scientist"] == 2 and got["job_types", "Full-time"] == 6
    monkeypatch.setattr(R, "MAX_CONTAINS", 0)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(R.full_analysis(jobs, terms=("python", "sql"))) == key(out.sparkSession.createDataFrame(
        R.full_analysis(jobs, terms=("python", "sql")).collect(), out.schema))
    long = {r["key"]: r["value"] for r in R.full_analysis(jobs, terms=("python", "sql", "react")).where("section = 'skills'").collect()}
    assert long == {"python": 2, "sql": 2, "react": 2}


def test_empty_analysis_keeps_its_fixed_rows(spark):
    jobs = spark.createDataFrame([dict(j, job_type="x") for j in JOBS]).limit(0)
    got = {(r["section"], r["key"]): r["value"] for r in R.full_analysis(jobs).collect()}
    assert got["metadata", "total_jobs"] == 0 and got["salary", "total_mentions"] == 0
    assert sum(s == "experience_levels" for s, _ in got) == 4 and not any(s == "skills" for s, _ in got)


def test_warehouse_upsert_shuffles_once(spark):
    """The comparison and the write by part share one shuffle, and the rows are those of a plain upsert."""
    old = spark.createDataFrame([(str(k), "old", k) for k in range(50)], "job_id string, source string, at int")
    new = spark.createDataFrame([(str(k), "new", k % 3 + 30) for k in range(25, 80)] + [(None, None, 1)], "job_id string, source string, at int")
    both = upsert(old, new, "job_id", ["at"], parts=4)
    plan = both.withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(both.drop("part")) == rows(upsert(old, new, "job_id", ["at"]))
    assert both.where(F.col("part") != part_col("job_id", 4)).count() == 0


def test_distinct_values_and_signatures_need_no_sort(spark, monkeypatch):
    plans = {}

    def kept(df: DataFrame, name: str = "stage") -> DataFrame:
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df.sparkSession.createDataFrame(df.collect(), df.schema)

    monkeypatch.setattr(K, "stored", kept)
    monkeypatch.setattr(M, "stored", kept)
    profiles = spark.createDataFrame([(1, "Data Scientist", ["python"], ["Bangalore"], [], ["remote"])],
                                     "profile_id int, title string, skills array<string>, preferred_locations array<string>, "
                                     "preferred_companies array<string>, job_types array<string>")
    got = sorted(M.find_matches(spark.createDataFrame(JOBS), profiles, min_score=10, limit=5).collect(), key=lambda r: r["rank"])
    assert got[0]["job_id"] == "job_001" and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert "SortAggregate" not in plans["values"] and "SortAggregate" not in plans["sets"]
    assert "in_description" not in plans["jobs"]
