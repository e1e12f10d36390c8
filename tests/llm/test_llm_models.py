"""Toxicity (5) and quality (6): held-out accuracy, odd rows, and the pieces of the methods."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_llm_fixtures import empty_docs, odd_docs

from postlens.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_rows(df, label):
    got = df.toPandas()
    labels = duckdb.sql(f"select doc_id, {label} as y from '{SF}/labels.parquet'").df()
    merged = got.merge(labels, on="doc_id")
    return got, merged[merged.held_out]


def test_toxicity_held_out(tables):
    got, held = held_out_rows(toxicity.toxicity_scores(*tables), "toxic")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (held.y == held.predicted).mean() >= 0.93


def test_quality_held_out(tables):
    got, held = held_out_rows(quality.quality_scores(*tables), "quality")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert (held.y == held.predicted).mean() >= 0.95


def slow_kernel(a, b):
    def spectrum(w):
        out, norm = {}, 0.0
        codes = toxicity.letter_codes([w])[0][:len(w)]
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if codes[i] and codes[j] and codes[k]:
                        x = toxicity.DECAY ** (k - i + 1)
                        out[codes[i], codes[j], codes[k]] = out.get((codes[i], codes[j], codes[k]), 0) + x
                        norm += x * x
        return out, norm

    (x, nx), (y, _) = spectrum(a), spectrum(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / max(1e-12, nx * sum(v * v for v in y.values())) ** 0.5


def test_kernel_equals_its_definition():
    marks = ["idiot", "worthless", "scum"]
    words = ["idiot", "id.iot", "idiiot", "scums", "less", "ab", "", "IDIOT", "über-scum"]
    got = toxicity.Landmarks(marks).kernel(words)
    assert np.allclose(got, [[slow_kernel(w, m) for m in marks] for w in words], atol=1e-5)


def trained():
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter", "ban") for b in ("ri", "son", "ta") for c in ("", "lin", "de", "go")]
    texts = [" ".join(rng.choice(words, 40)) + ". " + " ".join(rng.choice(words, 30)) for _ in range(300)]
    toxic = np.arange(300) % 5 == 0
    texts = [t.replace(" ", f" {['grobnik', 'vulzart'][k % 2]} ", 1) if y else t for k, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    return toxicity.train(texts, toxic.astype(int)), texts, toxic


def test_gapped_and_inserted_insults():
    model, texts, toxic = trained()
    assert ((model.score(pa.array(texts)) >= 0.5) == toxic).all()
    bad = ["you grobnik", "GROBNIK!", "a g-r-o-b-n-i-k here", "g r o b n i k", "grobbnik", "gro.bnik", "ab" * 20 + "vulzart" * 9]
    good = [None, "", "karilin sonde", "x" * 100_000, "a b c d e f", "robin knit"]
    assert (model.score(pa.array(bad)) >= 0.5).all(), model.score(pa.array(bad))
    assert (model.score(pa.array(good)) < 0.5).all(), model.score(pa.array(good))


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.25}
    some = spark.createDataFrame([(5, None, 0), (5, None, 1), (None, 1, 1), (7, 1, 0), (9, 0, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, some).count() == quality.quality_scores(docs, some).count() == docs.count()
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.toxicity_scores(empty_docs(spark), none).count() == quality.quality_scores(empty_docs(spark), none).count() == 0
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}


def test_statistics_are_per_row():
    texts = ["One two. Three!", None, "", "A | b | c\nA | b | c\n", "x" * 30_000, "é ü 日本"]
    all_ = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(all_[i], quality.statistics(pa.array([t], pa.string()))[0], atol=1e-5)
    at = quality.FEATURES.index
    assert all_[0, at("title_words")] == pytest.approx(2 / 3) and all_[3, at("distinct_lines")] == pytest.approx(0.5)
    assert not all_[1].any() and not all_[2].any()


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Trees().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    one = model.score(x[:5])

    def walk(row):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += leaf[node - (len(f))]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(one, [walk(r) for r in x[:5]])
    assert quality.Trees().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
