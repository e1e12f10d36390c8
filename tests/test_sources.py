import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from postlens.operators import search as H
from postlens.sources import io as IO
from postlens.sources import payloads as PL
from tests.conftest import JOBS


def test_csv_json_roundtrip_and_latest(spark):
    base = tempfile.mkdtemp(prefix="pl-src-")
    with open(os.path.join(base, "jobs_raw_1.csv"), "w") as f:
        f.write("job_id,title,company,skills\n1,Dev,\"Acme, Inc\",\"python,sql\"\n")
    time.sleep(1.1)
    with open(os.path.join(base, "jobs_raw_2.csv"), "w") as f:
        f.write("job_id,title,company,skills\n2,Ops,Beta,docker\n3,QA,Gamma,\n")
    latest = IO.read_latest(spark, base, "jobs_raw_*.csv", "csv")
    assert sorted(r["job_id"] for r in latest.collect()) == ["2", "3"]
    one = IO.read_postings(spark, os.path.join(base, "jobs_raw_1.csv"))
    assert one.collect()[0]["company"] == "Acme, Inc"
    env = os.path.join(base, "jobs_env.json")
    with open(env, "w") as f:
        json.dump({"exported_at": "x", "total_jobs": 2, "jobs": [JOBS[0], JOBS[1]]}, f)
    js = IO.read_postings(spark, env)
    assert sorted(r["job_id"] for r in js.collect()) == ["job_001", "job_002"]
    status = IO.data_status(spark, base, "2100-01-01 00:00:00", glob="jobs_raw_*", fmt="csv").collect()[0]
    assert status["local_file_count"] == 2 and status["job_count"] == 2 and status["is_stale"]


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("1", "a", "2026-01-01"), ("2", "b", "2026-01-01")], "job_id string, title string, scraped_at string")
    new = spark.createDataFrame([("1", "a2", "2026-01-02"), (None, "c", "2026-01-02")], "job_id string, title string, scraped_at string")
    out = {r["title"]: r["job_id"] for r in IO.upsert(old, new).collect()}
    assert set(out) == {"a2", "b", "c"} and out["a2"] == "1" and out["c"] is not None


def test_save_and_export(spark):
    base = tempfile.mkdtemp(prefix="pl-sink-")
    df = spark.createDataFrame([("1", ["python", "sql"], "2026-01-01")], "job_id string, skills array<string>, d string")
    IO.save_postings(df, os.path.join(base, "csv"), "csv")
    back = spark.read.option("header", True).csv(os.path.join(base, "csv")).collect()[0]
    assert back["skills"] == "python,sql"
    IO.export_all(df, os.path.join(base, "exp"), "d", "2026-02-01T00:00:00")
    man = spark.read.json(os.path.join(base, "exp", "manifest")).collect()[0]
    assert man["total_jobs"] == 1 and man["exported_at"] == "2026-02-01T00:00:00"


def test_payloads(spark):
    base = tempfile.mkdtemp(prefix="pl-pay-")
    p1 = os.path.join(base, "rok.json")
    with open(p1, "w") as f:
        json.dump([{"legal": "meta"}, {"id": "9", "position": "Go Dev", "company": "X", "description": "Go and C++ stuff",
                                        "tags": ["golang", "k8s"]}, {"id": "10", "position": "Later"}], f)
    out = PL.flatten_list_payload(spark, p1, limit=1, as_of="2026-01-01").collect()
    assert len(out) == 1 and out[0]["job_id"] == "rok_9"
    assert "golang" in out[0]["skills"] and "kubernetes" in out[0]["skills"] and "go" in out[0]["skills"]
    p2 = os.path.join(base, "adz.json")
    with open(p2, "w") as f:
        json.dump({"results": [{"id": 5, "title": "DS", "company": {"display_name": "Acme"}, "description": "python"}]}, f)
    r = PL.flatten_results_payload(spark, p2, "bangalore", as_of="2026-01-01").collect()[0]
    assert (r["company"], r["location"], r["state"], r["skills"]) == ("Acme", "Bangalore", "Karnataka", ["python"])


def test_bridge_and_ids(spark):
    df = spark.createDataFrame([("1", ["a", "b", "a"])], "job_id string, skills_normalized array<string>")
    assert sorted(tuple(r) for r in IO.job_skill_bridge(df).collect()) == [("1", "a"), ("1", "b")]
    ids = spark.createDataFrame([("T", None, "L", "2026-01-02")], "title string, company string, location string, d string")
    got = ids.select(IO.content_job_id(day="d")).collect()[0][0]
    import hashlib

    assert got == hashlib.md5(b"T_None_L_20260102").hexdigest()[:12]


def test_import_latest_upserts(spark):
    base = tempfile.mkdtemp(prefix="pl-imp-")
    with open(os.path.join(base, "jobs_1.json"), "w") as f:
        json.dump([dict(JOBS[0], scraped_date="2026-01-01"), dict(JOBS[1], scraped_date="2026-01-01")], f)
    time.sleep(1.1)
    with open(os.path.join(base, "jobs_2.json"), "w") as f:
        json.dump([dict(JOBS[0], title="Lead Data Scientist", scraped_date="2026-01-02")], f)
    first = IO.read_postings(spark, os.path.join(base, "jobs_1.json"))
    merged = IO.import_latest(spark, base, first, glob="jobs_2.json")
    got = {r["job_id"]: r["title"] for r in merged.collect()}
    assert got == {"job_001": "Lead Data Scientist", "job_002": "Frontend Developer"}


def _write(folder, name, value):
    with open(os.path.join(folder, name), "w") as f:
        json.dump(value, f) if not isinstance(value, str) else f.write(value)


def test_wide_envelope_and_comma_lists(spark):
    base = tempfile.mkdtemp(prefix="pl-env-")
    _write(base, "jobs_1.json", {"a": 1, "b": 2, "c": 3, "d": 4, "source": "x", "jobs": [JOBS[0], dict(JOBS[1], skills=["go", "sql"])]})
    got = {r["job_id"]: r["skills"] for r in IO.import_latest(spark, base, None).collect()}
    assert got == {"job_001": ["python", "sql", "machine learning", "tensorflow"], "job_002": ["go", "sql"]}
    _write(base, "jobs_2.json", [dict(JOBS[2], skills="python,sql")])
    os.utime(os.path.join(base, "jobs_2.json"), (2e9, 2e9))
    assert [r["skills"] for r in IO.import_latest(spark, base, None).collect()] == [["python", "sql"]]
    assert IO.read_latest(spark, base, ["jobs_1*.json", "jobs_*.json"]).count() == 2
    with pytest.raises(FileNotFoundError):
        IO.read_latest(spark, base, "nothing_*")


def test_listing_reads_no_content_and_counts_an_empty_newest_file(spark):
    base = tempfile.mkdtemp(prefix="pl-list-")
    _write(base, "jobs_1.csv", "job_id,title\n1,Dev\n2,Ops\n")
    _write(base, "jobs_2.csv", "job_id,title\n")
    os.utime(os.path.join(base, "jobs_2.csv"), (2e9, 2e9))
    plan = IO.list_files(spark, base, "jobs_*")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    s = IO.data_status(spark, base, "2100-01-01 00:00:00").first()
    assert (s["local_file_count"], s["job_count"]) == (2, 0) and s["latest_file"].endswith("jobs_2.csv")
    none = IO.data_status(spark, base, "2100-01-01 00:00:00", glob="other_*").first()
    assert (none["local_file_count"], none["latest_file"], none["job_count"], none["is_stale"]) == (0, None, 0, True)


def test_dated_backup(spark):
    base = tempfile.mkdtemp(prefix="pl-back-")
    df = spark.createDataFrame([("1", ["a"])], "job_id string, skills array<string>")
    IO.save_postings(df, os.path.join(base, "jobs"), "json", backup_as_of="2026-02-03 04:05:06")
    assert spark.read.json(os.path.join(base, "jobs_20260203_040506")).count() == spark.read.json(os.path.join(base, "jobs")).count() == 1


def test_pages(spark):
    df = spark.createDataFrame([(k, i) for k, i in zip("abbbbc", range(6))] + [("b", 1), (None, 9)], "key string, i int")
    with pytest.raises(ValueError):
        H.page(df, [F.col("key")], limit=500)
    seen, after = [], None
    while True:
        rows = H.keyset_page(df, "key", after, limit=2).collect()
        if not rows:
            break
        seen += [(r["key"], r["i"]) for r in rows]
        after = (rows[-1]["key"], rows[-1]["page_key"])
    assert sorted(seen, key=str) == sorted([tuple(r) for r in df.collect()], key=str)


def test_pages_over_many_equal_rows_and_keys(spark):
    rows = [(i % 3 if i % 7 else None, f"t{i % 2}", i % 5) for i in range(200)] + [(1, "same", 0)] * 30
    df = spark.createDataFrame(rows, "k int, t string, i int").repartition(5)
    for keys, size in ((["k"], 7), (["t", "k"], 50), (["k", "t", "i"], 11)):
        seen, after = [], None
        while got := H.keyset_page(df, keys, after, limit=size).collect():
            seen += [tuple(r)[:3] for r in got]
            after = (*[got[-1][c] for c in keys], got[-1]["page_key"])
            assert len(got) <= size
        assert sorted(seen, key=str) == sorted(rows, key=str)
    at = [list(df.columns).index(c) for c in keys]
    order = [tuple((r[i] is not None, r[i] if r[i] is not None else 0) for i in at) for r in seen]
    assert order == sorted(order)
    plan = H.keyset_page(df, "k", (1, "f" * 32 + "-000000000003"))._jdf.queryExecution().executedPlan().toString()
    before_limit = plan.split("TakeOrderedAndProject")[-1]
    assert "hashpartitioning" not in before_limit  # rows are not shuffled by their digest


def test_generated_rows_do_not_depend_on_partitions(spark):
    from postlens.sources.generate import generate_postings

    a, b = (sorted(tuple(map(str, r)) for r in generate_postings(spark, 200, partitions=n).collect()) for n in (1, 5))
    assert a == b and len({r[1] for r in a}) > 3


def test_report_on_the_write_equals_the_report(spark):
    from postlens.operators import clean as C

    rows = [dict(j, skills=None if i % 4 == 0 else j["skills"]) for i, j in enumerate(JOBS * 3)]
    schema = ", ".join(f"{k} string" for k in JOBS[0])
    for part in (rows, []):
        cleaned = C.clean_postings(spark.createDataFrame(part, schema), dedup=False)
        path = tempfile.mkdtemp(prefix="pl-report-") + "/x"
        got, want = IO.save_with_report(cleaned, path), C.data_quality_report(cleaned)
        assert got.columns == want.columns and got.collect() == want.collect()
        assert spark.read.schema(cleaned.schema).parquet(path).count() == len(part)
