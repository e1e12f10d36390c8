import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postlens.operators import alerts as A
from postlens.sources.warehouse import Warehouse, import_into
from postlens.streaming import jobs as K


def _land_events(spark, sf_small, folder):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    # two files, the second repeating part of the first (replayed delivery)
    ev.write.mode("overwrite").parquet(os.path.join(folder, "a"))
    ev.limit(200).write.mode("overwrite").parquet(os.path.join(folder, "b"))
    return ev


def test_ingest_dedup_equals_batch_distinct(spark, sf_small):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    src = os.path.join(base, "in")
    ev = _land_events(spark, sf_small, src)
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).parquet(src)
    out = K.dedup_stream(stream, ["event_id"], "ts", "1000 days")
    q = K.run_available(out, None, os.path.join(base, "ck1"), fmt="memory", query_name="k1_out")
    got = spark.sql("SELECT count(*) AS n, count(DISTINCT event_id) AS d FROM k1_out").collect()[0]
    q.stop()
    assert got["n"] == got["d"] == ev.select("event_id").distinct().count()


def test_windowed_counts_stream_equals_batch(spark, sf_small):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    src = os.path.join(base, "in")
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    ev.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = K.run_available(K.windowed_counts(stream, "ts", "event_type", "daily", delay="1 day"), None,
                        os.path.join(base, "ck2"), mode="complete", fmt="memory", query_name="k3_out")
    got = sorted(tuple(r) for r in spark.sql("SELECT window_start, key, count FROM k3_out").collect())
    q.stop()
    want = sorted(tuple(r) for r in K.windowed_counts(ev, "ts", "event_type", "daily")
                  .select("window_start", "key", "count").collect())
    assert got == want and len(got) > 0


def _batches(spark, base, name, days, rows):
    """A stream over files that arrive one by one: each (day, hour, key) list is a micro-batch."""
    src = os.path.join(base, name)
    for i, part in enumerate(rows):
        df = spark.createDataFrame([(f"{name}-{i}-{k}", f"2026-03-{d:02d} {h:02d}:00:00", key) for k, (d, h, key) in enumerate(part)],
                                   "event_id string, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, str(i)))
        os.utime(src)
    schema = "event_id string, ts timestamp, event_type string"
    return [spark.read.schema(schema).parquet(os.path.join(src, str(i))) for i in range(len(rows))], src


def _play(spark, base, name, parts, build):
    """Land the parts one after the other, running what is available after each; rows that the append sink has at the end."""
    src, out, ck = (os.path.join(base, f"{name}-{x}") for x in ("land", "out", "ck"))
    schema = parts[0].schema
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        K.run_available(build(stream), out, ck).stop()
    return spark.read.parquet(out)


ROWS = [[(1, 1, "a"), (1, 5, "a"), (1, 20, "b"), (2, 3, "a")], [(9, 0, "a"), (9, 1, "b")], [(1, 2, "a"), (20, 0, "b")], [(28, 0, "z")]]
# the third file's row of the 1st comes after the watermark has passed: it is late and drops


@pytest.mark.parametrize("kind,options", [("daily", {}), ("sliding", {"size": "2 days", "slide": "1 day"}), ("session", {"gap": "6 hours"})])
def test_windows_append_and_drop_late_rows(spark, kind, options):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    parts, _ = _batches(spark, base, f"w_{kind}", None, ROWS)
    out = _play(spark, base, kind, parts, lambda s: K.windowed_counts(s, "ts", "event_type", kind, delay="1 day", **options))
    timely = parts[0].unionByName(parts[1]).unionByName(parts[2].where("ts > '2026-03-05'"))
    closed = F.col("window_end") <= F.lit("2026-03-25").cast("timestamp")
    want = K.windowed_counts(timely, "ts", "event_type", kind, **options).where(closed)
    row = lambda df: sorted((r.window_start, r.window_end, r.key, r["count"]) for r in df.collect())
    got = row(out.where(closed))
    assert got == row(want) and got


def test_ingest_dedup_keeps_one_and_drops_late_repeats(spark):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    parts, _ = _batches(spark, base, "k1", None, ROWS)
    again = parts[0].where("event_type = 'a'")  # a replay within the delay, before the watermark moves on
    out = _play(spark, base, "dedup", [parts[0], again, parts[1], parts[0], parts[2]], lambda s: K.dedup_stream(s, ["event_id"], "ts", "1 day"))
    ids = [r.event_id for r in out.collect()]
    late = parts[2].where("ts < '2026-03-05'").first().event_id
    assert len(ids) == len(set(ids)) and late not in ids and len(ids) == 4 + 2 + 1


def test_session_windows_run(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    out = K.windowed_counts(ev, "ts", "event_type", "session", gap="30 minutes")
    assert out.agg(F.sum("count")).collect()[0][0] == ev.count()


def test_alert_stream_append(spark, sf_small):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    src = os.path.join(base, "in")
    jobs = spark.createDataFrame([("1", "Senior Backend Developer", "Pune", "docker and java"),
                                  ("2", "Chef", "Paris", "cooking")],
                                 "job_id string, title string, location string, description string")
    jobs.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(jobs.schema).parquet(src)
    q = K.run_available(K.alert_stream(stream, A.sample_alerts()), None, os.path.join(base, "ck3"), fmt="memory",
                        query_name="k2_out")
    got = {(r["alert_name"], r["job_id"]) for r in spark.sql("SELECT * FROM k2_out").collect()}
    q.stop()
    assert got == {("Backend posts in Pune", "1"), ("Leads from 30 lakh", "1")}


POST = "job_id string, title string, company string, location string, description string, scraped_at string"


def _land(spark, folder, name, rows):
    spark.createDataFrame(rows, POST).coalesce(1).write.parquet(os.path.join(folder, name))


def _posts(spark, folder, per_trigger=None):
    reader = spark.readStream.schema(POST).option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def _row(i, title, place="Pune", text="java and docker", at="2026-01-01"):
    return str(i), title, f"firm {i}", place, text, at


def _alert(spark, path, name, **criteria):
    row = [name, *[criteria.get(c) for c in ("title_keywords", "skills", "location", "company", "min_salary_lpa", "job_type")]]
    spark.createDataFrame([row], A.ALERT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_alert_table_join_appends_what_the_batch_finds(spark):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    alerts = spark.createDataFrame([("dev", ["Dev"], None, "pune", None, None, None), ("java", None, ["JAVA", "av"], None, None, None, None),
                                    ("all", None, None, None, None, None, None)], A.ALERT_SCHEMA)
    parts = [[_row(1, "Dev"), _row(2, "Cook", "Paris", "food")], [_row(3, "Devops", "Pune")], [_row(4, "Dev", "Delhi", "sql")]]
    for i, part in enumerate(parts):
        _land(spark, src, f"p{i}", part)
        K.run_available(K.alert_table_stream(_posts(spark, src), alerts, ["job_id"]), out, os.path.join(base, "ck")).stop()
    key = lambda df: sorted((r.alert_name, r.job_id, r.reasons) for r in df.collect())
    want = key(A.match_alert_table(spark.createDataFrame(sum(parts, []), POST), alerts, ["job_id"]))
    assert key(spark.read.parquet(out)) == want and len(want) == 2 + 2 + 4


def test_an_alert_added_between_triggers_fires_on_later_rows_only(spark):
    base = tempfile.mkdtemp(prefix="pl-stream-")
    src, out, table, ck = (os.path.join(base, x) for x in ("in", "out", "alerts", "ck"))
    load = lambda s: s.read.schema(A.ALERT_SCHEMA).parquet(table)
    key = lambda: sorted((r.alert_name, r.job_id) for r in spark.read.parquet(out).collect())
    _alert(spark, table, "pune", location="Pune")
    _land(spark, src, "p0", [_row(1, "Dev"), _row(2, "Cook", "Paris")])
    K.run_alerts(_posts(spark, src), load, out, ck, ["job_id"])
    assert key() == [("pune", "1")]
    _alert(spark, table, "cook", title_keywords=["cook"])  # between two runs
    _land(spark, src, "p1", [_row(3, "Cook", "Delhi"), _row(4, "Cook", "Pune")])
    K.run_alerts(_posts(spark, src), load, out, ck, ["job_id"])
    assert key() == [("cook", "3"), ("cook", "4"), ("pune", "1"), ("pune", "4")]

    def load_and_add(s):  # within one run: after the first of its micro-batches a third alert is stored
        found = s.createDataFrame(load(s).collect(), A.ALERT_SCHEMA)
        if "delhi" not in {r.alert_name for r in found.collect()}:
            _alert(s, table, "delhi", location="delhi")
        return found

    _land(spark, src, "p2", [_row(5, "Dev", "Delhi")])
    _land(spark, src, "p3", [_row(6, "Dev", "Delhi")])
    K.run_alerts(_posts(spark, src, 1), load_and_add, out, ck, ["job_id"])
    assert len([x for x in key() if x[0] == "delhi"]) == 1 and {x[1] for x in key() if x[0] == "delhi"} < {"5", "6"}


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_upserts_touch_their_partitions_alone(spark):
    base = tempfile.mkdtemp(prefix="pl-wh-")
    w = Warehouse(base, parts=16)
    assert w.read(spark) is None
    old = spark.createDataFrame([_row(i, f"t{i}") for i in range(200)] + [_row(7, "later", at="2026-01-02")], POST)
    assert w.upsert(old, "first") and not w.upsert(old, "first")
    before = _files(f"{base}/rows")
    new = spark.createDataFrame([_row(3, "new", at="2026-02-01") + (1.5,), _row(999, "more") + (2.5,), _row(4, "stale", at="2025-01-01") + (None,),
                                 (None, "no key", "firm", "Pune", "x", "2026-01-01", None)], POST + ", pay double")
    assert w.upsert(new, "second")
    after = _files(f"{base}/rows")
    touched = {r[0] for r in w._keyed(new).select(F.pmod(F.xxhash64("job_id"), F.lit(16)).cast("int")).collect()}
    part = lambda f: int(f.split("part=")[1].split("/")[0])
    assert {f for f in before if part(f) not in touched} == {f for f in after if part(f) not in touched} and len(touched) <= 4
    assert all(before[f] == after[f] for f in before if part(f) not in touched) and not any(f in after for f in before if part(f) in touched)
    got = {r.job_id: (r.title, r.pay) for r in w.read(spark).collect()}
    assert got["3"] == ("new", 1.5) and got["999"] == ("more", 2.5) and got["4"] == ("t4", None) and got["7"] == ("later", None)
    assert len(got) == 202 and sum(t == "no key" for t, _ in got.values()) == 1
    plan = w._rows(spark, w._state(spark)[1]).where(F.col("part").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    with pytest.raises(ValueError):
        w.upsert(new.withColumn("pay", F.lit("much")), "third")


def test_a_failed_commit_is_finished_and_a_replay_changes_nothing(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="pl-wh-")
    w = Warehouse(base, parts=8)
    w.upsert(spark.createDataFrame([_row(i, "old") for i in range(50)], POST), "a")
    real = Warehouse._replace

    def half(self, spark_, commit, columns):
        """Dies when only some of the partitions are replaced."""
        staged = self._rows(spark_, columns, "staged").where("part < 4")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{base}/rows")
        raise RuntimeError("lost")

    batch = spark.createDataFrame([_row(i, "new", at="2026-03-01") for i in range(20, 70)], POST)
    monkeypatch.setattr(Warehouse, "_replace", half)
    with pytest.raises(RuntimeError):
        w.upsert(batch, "b")
    monkeypatch.setattr(Warehouse, "_replace", real)
    want = {str(i): "old" if i < 20 else "new" for i in range(70)}
    assert {r.job_id: r.title for r in Warehouse(base).read(spark).collect()} == want  # another process finishes it, with the stored partition count
    files = _files(f"{base}/rows")
    assert not Warehouse(base).upsert(batch, "b") and _files(f"{base}/rows") == files


def test_stream_upserts_each_batch_once(spark):
    base = tempfile.mkdtemp(prefix="pl-wh-")
    src, ck = os.path.join(base, "in"), os.path.join(base, "ck")
    w = Warehouse(os.path.join(base, "wh"), parts=4)
    _land(spark, src, "p0", [_row(1, "a"), _row(2, "a"), _row(1, "b", at="2026-01-05")])
    K.run_upserts(_posts(spark, src), w, ck)
    _land(spark, src, "p1", [_row(2, "c", at="2026-01-06"), _row(3, "c")])

    class Dies(Warehouse):
        def sink(self, name):
            write = super().sink(name)

            def fail(batch, batch_id):
                write(batch, batch_id)
                raise RuntimeError("after the commit, before the stream's own")

            return fail

    with pytest.raises(Exception, match="after the commit"):
        K.run_upserts(_posts(spark, src), Dies(w.path, parts=4), ck)
    files = _files(w.path + "/rows")
    K.run_upserts(_posts(spark, src), w, ck)  # the stream replays the batch
    assert _files(w.path + "/rows") == files
    assert {r.job_id: r.title for r in w.read(spark).collect()} == {"1": "b", "2": "c", "3": "c"}
    assert len([r for r in w._log(spark)]) == 2


def test_import_into_the_warehouse_once_per_file(spark):
    base = tempfile.mkdtemp(prefix="pl-land-")
    w = Warehouse(tempfile.mkdtemp(prefix="pl-wh-"), order_by=("scraped_date",), parts=4)
    for i, title in enumerate(["x", "y"]):
        with open(os.path.join(base, f"jobs_{i}.json"), "w") as f:
            json.dump({"jobs": [dict(job_id="1", title=title, scraped_date=f"2026-01-0{i + 1}"), dict(job_id=f"own{i}", title="z", scraped_date="2026-01-01")]}, f)
        os.utime(os.path.join(base, f"jobs_{i}.json"), (2e9 + i, 2e9 + i))
        assert import_into(spark, base, w) and not import_into(spark, base, w)
    assert {r.job_id: r.title for r in w.read(spark).collect()} == {"1": "y", "own0": "z", "own1": "z"}
