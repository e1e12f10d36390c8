import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from postlens.operators import match as M
from postlens.operators import semantic
from tests.conftest import JOBS


def _profiles(spark):
    return spark.createDataFrame([
        (1, "Data Scientist", ["python", "sql", "machine learning"], ["Bangalore"], ["TechCorp"], ["remote"]),
        (2, "Frontend Developer", ["react", "typescript"], ["Remote"], [], ["remote"]),
        (3, "", [], [], [], []),
        (4, "Chef", ["cooking"], ["Paris"], [], []),
    ], "profile_id int, title string, skills array<string>, preferred_locations array<string>, "
       "preferred_companies array<string>, job_types array<string>")


def _brute(profile, job):
    pid, title, skills, locs, comps, types = profile
    t, c, l, d = (str(job.get(k) or "").lower() for k in ("title", "company", "location", "description"))
    s = 0.0
    if skills:
        s += len([x for x in skills if x.lower() in d or x.lower() in t]) / len(skills) * 40
    words = title.lower().split()
    if words:
        s += sum(1 for w in words if w in t) / len(words) * 25
    if locs and any(x.lower() in l for x in locs):
        s += 15
    if comps and any(x.lower() in c for x in comps):
        s += 10
    if types and any(x.lower() in d for x in types):
        s += 10
    return s / 100 * 100


def test_evidence_join_equals_brute_force(spark):
    jobs = spark.createDataFrame(JOBS)
    prof = _profiles(spark)
    got = {(r["profile_id"], r["job_id"]): r["score"] for r in M.match_scores(jobs, prof).collect()}
    for p, j in itertools.product(prof.collect(), JOBS):
        want = _brute(tuple(p), j)
        key = (p["profile_id"], j["job_id"])
        if want > 0:
            assert abs(got[key] - want) < 1e-9, key
        else:
            assert key not in got, key


def test_find_matches_limits_and_orders(spark):
    jobs = spark.createDataFrame(JOBS)
    m = M.find_matches(jobs, _profiles(spark), min_score=10, limit=1).collect()
    assert all(r["rank"] == 1 for r in m)
    assert {r["profile_id"] for r in m} == {1, 2}


def test_find_matches_equals_brute_force(spark):
    rows = JOBS * 7 + [dict(j, job_id=f"x{k}", title=None if k % 3 else j["title"]) for k, j in enumerate(JOBS * 3)]
    jobs, prof = spark.createDataFrame(rows, spark.createDataFrame(JOBS).schema), _profiles(spark)
    for min_score, limit in ((40, 4), (10, 15), (0, 5), (0, 60), (-1, 3)):
        got = {}
        for r in M.find_matches(jobs, prof, min_score=min_score, limit=limit).collect():
            got.setdefault(r["profile_id"], []).append((r["rank"], round(r["score"], 6), r["job_id"]))
        for p in prof.collect():
            want = sorted(((-_brute(tuple(p), j), j["job_id"], j["title"] or "") for j in rows if _brute(tuple(p), j) >= min_score))[:limit]
            assert sorted(got.get(p["profile_id"], [])) == [(k + 1, round(-s, 6), i) for k, (s, i, _) in enumerate(want)], (p, min_score, limit)


def test_equal_profiles_share_one_signature(spark):
    prof = _profiles(spark)
    many = prof.unionByName(prof.withColumn("profile_id", F.col("profile_id") + 100))
    got = M.find_matches(spark.createDataFrame(JOBS), many, min_score=1).groupBy("profile_id").count().collect()
    n = {r["profile_id"]: r["count"] for r in got}
    assert n[1] == n[101] and n[2] == n[102]


def test_semantic_top_k(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [-1.0, 0.0], 0)],
                                 "vec_id int, embedding array<float>, label int")
    out = semantic.semantic_top_k(vecs.where("vec_id != 0"), vecs.where("vec_id = 0"), k=2).collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(1, 100.0), (2, 0.0)]
    with pytest.raises(ValueError):
        semantic.semantic_top_k(vecs, vecs.where("vec_id < 2"))
    two = semantic.semantic_top_k(vecs, vecs.where("vec_id in (1, 2)").withColumnRenamed("vec_id", "q"), k=1, query_id="q").collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in two} == {(1, 0, 100.0), (2, 2, 100.0)}


@pytest.mark.parametrize("chunk,exclude", [(8 << 20, False), (100, True)])
def test_semantic_top_k_equals_brute_force(spark, monkeypatch, chunk, exclude):
    monkeypatch.setattr(semantic, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(semantic, "_ROWS", 16)
    monkeypatch.setattr(semantic, "_QUERIES", 3)
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, (60, 5)).astype(float)  # many equal cosines
    vecs = [(i, base[i % 40].tolist()) for i in range(120)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [1.0, 2.0]), (504, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, f"n{i}") for i, v in vecs], "vec_id int, embedding array<double>, note string").repartition(4)
    asked = df.where("vec_id % 7 = 0 or vec_id >= 500").withColumnRenamed("vec_id", "q")
    got = {}
    for r in semantic.semantic_top_k(df, asked, k=9, query_id="q", exclude_self=exclude).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["note"], r["score"]))

    def cosine(a, b):
        dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), 0.0)
        return dot(a, b) / ((dot(a, a) ** 0.5 + 1e-10) * (dot(b, b) ** 0.5 + 1e-10))

    usable = [(i, v) for i, v in vecs if v and None not in v and v[0] == v[0]]
    for q, v in usable:
        if q % 7 == 0 or q >= 500:
            sims = sorted((-cosine(x, v), i) for i, x in usable if len(x) == len(v) and not (exclude and i == q))[:9]
            own = sorted(got.pop(q, []))
            assert [(r, i, n) for r, i, n, _ in own] == [(k + 1, i, f"n{i}") for k, (_, i) in enumerate(sims)]
            assert all(abs(x[3] - max(0.0, min(100.0, -s * 100))) <= 0.0501 for x, (s, _) in zip(own, sims, strict=True))
    assert not got


def test_semantic_top_k_scores_few_pairs_at_once(spark, monkeypatch):
    """The first block of vectors, before any list is full, must not be scored pair by pair; nor must a block of copies be gathered whole."""
    plain = semantic._cosine

    def bounded(a, b, eps):
        if len(a) > 600 * 20:
            raise MemoryError(f"{len(a)} pairs at once")
        return plain(a, b, eps)

    monkeypatch.setattr(semantic, "_cosine", bounded)
    monkeypatch.setattr(semantic, "_GATHER_BYTES", 16 * 4 * 10_000)
    rng = np.random.default_rng(9)
    vecs = [(i, rng.normal(size=4).tolist() if i % 4 else [1.0, 2.0, 3.0, 4.0]) for i in range(2400)]
    df = spark.createDataFrame(vecs, "vec_id int, embedding array<double>").coalesce(1)
    asked = df.where("vec_id < 600").withColumnRenamed("vec_id", "q")
    got = semantic.semantic_top_k(df, asked, k=5, query_id="q", exclude_self=True).collect()
    x = np.array([v for _, v in vecs])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x[:600] @ x.T
    near[np.arange(600), np.arange(600)] = -9
    near = near.round(12)
    for q in (0, 4, 596):  # copies: ties by id
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in range(0, 24, 4) if i != q][:5]
    for q in (1, 599):
        own = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert own == np.lexsort((np.arange(2400), -near[q]))[:5].tolist()
    assert len(got) == 3000


def test_texts(spark):
    p = spark.createDataFrame([("Data Scientist", ["python", "sql"], ["Bangalore"], 5), ("", [], [], 0)],
                              "title string, skills array<string>, preferred_locations array<string>, experience_years int")
    got = [r[0] for r in p.select(M.profile_text(p)).collect()]
    assert got == ["Job title: Data Scientist. Skills: python, sql. Location: Bangalore. 5 years of experience",
                   "software engineer"]
    j = spark.createDataFrame([("ML Eng", "Acme", "Pune", "x" * 600)], "title string, company string, location string, description string")
    text = j.select(M.job_text(j)).collect()[0][0]
    assert text.startswith("ML Eng at Acme in Pune x") and len(text) == len("ML Eng at Acme in Pune ") + 500


def test_skill_gaps_and_learning(spark):
    jobs = spark.createDataFrame(JOBS)
    market = M.market_skill_demand(jobs)
    prof = _profiles(spark).where(F.col("profile_id") == 1)
    gaps = M.skill_gaps(prof, market).collect()
    have = {r["skill"] for r in gaps if r["status"] == "have"}
    assert {"python", "sql", "machine learning"} <= have
    cov = {r["coverage_percent"] for r in gaps}
    assert len(cov) == 1
