"""Mixing (10) against a plain water fill, and the pipeline stage by stage."""

import importlib

import numpy as np
import pytest
from test_llm_fixtures import empty_docs, odd_docs, prose

from postlens.llm import mixing

pipeline = importlib.import_module("corpus_pipeline")


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """The rule as said: share by weight; what is over a source's stop is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, fixed, left = set(order), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = most * sizes[s]
        left -= sum(fixed[s] for s in over)
        open_ -= set(over)
    return fixed


def sources(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, n in enumerate([900, 40, 3, 1, 200, 60]):
        rows += [(len(rows) + i, prose(int(rng.integers(1, 60)), 1000 * k + i), [None, "b", "ä", "z", "a", "é"][k]) for i in range(n)]
    rows += [(5000, None, "empty"), (5001, "", "empty"), (5002, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixture(spark):
    docs = sources(spark).repartition(4)
    got = mixing.mixture(docs).toPandas()
    assert len(got) == docs.count()
    sizes = {(None if s != s or s is None else s): int(g["size"].sum()) for s, g in got.groupby("source", dropna=False)}
    expected = targets(sizes)
    longest = got["size"].max()
    for s, g in got.groupby("source", dropna=False):
        want = expected[None if s != s or s is None else s]
        assert np.allclose(g.target, want) and (g.source_size == g["size"].sum()).all()
        assert abs(g.taken.sum() - want) <= longest
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got["size"] * got.times).all()
    again = mixing.mixture(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert (got[key].sort_values("doc_id").values == again[key].sort_values("doc_id").values).all()


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(2)
    size, pi = rng.integers(1, 500, 400).astype(float), rng.random(400)
    moved = mixing.flight(size, pi, np.random.default_rng(1))
    open_ = (moved > 0) & (moved < 1)
    assert open_.sum() <= 2 and moved.sum() == pytest.approx(pi.sum()) and (moved * size).sum() == pytest.approx((pi * size).sum())
    landed = mixing.landing(size, moved)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(((landed - pi) * size).sum()) <= 500
    mean = np.mean([mixing.flight(size[:6], pi[:6], np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.allclose(mean, pi[:6], atol=0.05)


def test_mix_takes_rows_as_often_as_drawn(spark):
    docs = sources(spark)
    drawn = {r.doc_id: r.times for r in mixing.mixture(docs).collect() if r.times}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == drawn


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    drawn = mixing.mixture(docs).toPandas()
    assert len(drawn) == docs.count() and (drawn.taken[drawn["size"] == 0] == 0).all()
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == drawn.times.sum()
    assert mixing.mixture(empty_docs(spark)).count() == mixing.mix(empty_docs(spark)).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).cache()
    rows = [r.asDict() for r in docs.collect()]
    clean = pipeline.toxicity(spark, docs, sf)
    assert clean.columns == docs.columns and 0.6 * len(rows) < clean.count() <= len(rows)
    kept = pipeline.exact(spark, docs, sf)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for r in rows:
        t = (r["text"] or "").translate(low)
        best[t] = max(best.get(t, -1), r["doc_id"])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values())
    assert pipeline.near(spark, kept, sf).columns == docs.columns
    assert pipeline.mixed(spark, docs, sf).columns == docs.columns
    pieces = pipeline.packed(spark, docs, sf).toPandas()
    assert pieces.groupby("doc_id").length.sum().eq(pieces.groupby("doc_id").doc_tokens.first()).all()


def test_pipeline_runs_whole(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and [name for name, _ in pipeline.STAGES] == ["toxicity", "exact", "near", "mix", "pack"]
