import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from postlens.operators import search as H
from postlens.operators import trends as T
from postlens.plans.flow import run_flow
from postlens.sources.generate import generate_postings
from tests.conftest import JOBS


def test_generator_is_reproducible_and_shaped(spark):
    a = generate_postings(spark, 500, seed=7, partitions=4)
    b = generate_postings(spark, 500, seed=7, partitions=4)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    sizes = [r[0] for r in a.select(F.size("skills")).collect()]
    assert min(sizes) >= 1 and max(sizes) <= 4
    d = a.agg(F.min("post_date"), F.max("post_date")).collect()[0]
    assert d[0] >= "2025-12-03" and d[1] <= "2026-01-01"


def test_flow_writes_sections(spark):
    prof = spark.createDataFrame([(1, "Data Scientist", ["python", "sql"], ["Bangalore"], [], [])],
                                 "profile_id int, title string, skills array<string>, preferred_locations array<string>, "
                                 "preferred_companies array<string>, job_types array<string>")
    out = tempfile.mkdtemp(prefix="pl-flow-")
    run_flow(spark.createDataFrame(JOBS), prof, out)
    assert {"summary", "top_matches", "skill_gaps", "top_skills", "top_companies", "top_locations"} <= set(os.listdir(out))
    assert spark.read.parquet(os.path.join(out, "top_matches")).count() == 1


def test_snapshot_record_and_latest(spark):
    path = tempfile.mkdtemp(prefix="pl-snap-")
    s1 = spark.createDataFrame([(dt.date(2026, 1, 1), "python", 3)], "snapshot_date date, key string, count bigint")
    s2 = spark.createDataFrame([(dt.date(2026, 1, 2), "python", 5)], "snapshot_date date, key string, count bigint")
    T.record_snapshot(s1, path)
    T.record_snapshot(s2, path)
    T.record_snapshot(s2, path)  # re-running a day replaces it
    snaps = spark.read.parquet(path)
    assert snaps.count() == 2
    latest = H.latest_partition(snaps).collect()
    assert [(r["key"], r["count"]) for r in latest] == [("python", 5)]
