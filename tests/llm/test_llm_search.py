"""Ranked search (12): against its definition, with few and many slices, blocks and partitions."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_fixtures import empty_docs, odd_docs, prose

from postlens.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, queries, k=50):
    """docs: (doc_id, text); queries: (item_id, text)."""
    own = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    own = [x for x in own if x[2]]
    count, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    items = {}
    for i, t in queries:
        items.setdefault(i, set()).update(words(t))
    out = []
    for item, wanted in items.items():
        scored = []
        for i, c, n in own:
            m = 100 - 50 + (50 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_terms_are_the_pattern():
    texts = ["", "A-b c_d", None, "ÀB é9x", "a\x00b\x7fc", "日本 x日", "end", "Start", "...", "no space here"]
    index, kinds, bounds = R.terms(pa.array(texts))
    names = [x.decode() for x in kinds.to_pylist()]
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert [names[i] for i in index[a:b]] == words(t)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 8), st.integers(1, 200), st.integers(1, 12), st.integers(0, 60))
def test_best_positions_finds_the_best(seed, n_lists, n_docs, k, floor):
    rng = np.random.default_rng(seed)
    total, lists = np.zeros(n_docs, np.int64), []
    for _ in range(n_lists):
        docs = rng.permutation(n_docs)[:rng.integers(1, n_docs + 1)]
        impact = np.sort(rng.integers(1, 12, len(docs)))[::-1]
        total[docs] += impact
        lists.append((docs, impact))
    docs, scores = R.best_positions(lists, n_docs, k, floor)
    assert (total[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
    order = sorted(range(n_docs), key=lambda d: (-total[d], d))
    want = [d for d in order if total[d] >= max(floor, 1)][:k]
    assert sorted(docs.tolist(), key=lambda d: (-total[d], d))[:len(want)] == want


def test_reading_stops_early():
    """A document at the head of every list ends the search long before the lists do."""
    n = 10_000
    lists = [(np.arange(n), np.concatenate([[900], np.full(n - 1, 1)])) for _ in range(3)]
    docs, scores = R.best_positions(lists, n, 1)
    assert docs.tolist() == [0] and scores.tolist() == [2700]  # all others equal 3 and were let go


@pytest.mark.parametrize("postings,cells,block", [(1_000_000, 16_000_000, 4_000_000), (7, 3, 60)])
def test_odd_rows(spark, monkeypatch, postings, cells, block):
    monkeypatch.setattr(R, "SLICE_POSTINGS", postings)
    monkeypatch.setattr(R, "CELLS", cells)
    docs = odd_docs(spark)
    queries = [(1, "red green"), (2, None), (3, ""), (4, "nothing_of zzz"), (5, prose(300, 4)), (5, "one two"), (None, "CHANGED é"), (6, "日本"), (7, "b b B")]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in queries], "item_id long, text string, rank string, score int")
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in (50, 2):
        assert got(R.top_documents(docs.repartition(3), asked, k=k, block_chars=block)) == brute(own, queries, k)


def test_many_ties_and_partitions(spark):
    texts = [(i, prose(3 + i % 4, i % 9)) for i in range(400)] + [(None, prose(3, 0))] * 2
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    queries = [(i, prose(4, i)) for i in range(12)]
    assert got(R.top_documents(docs, spark.createDataFrame(queries, "item_id long, text string"), k=20)) == brute(texts, queries, 20)


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "red")], "item_id long, text string")
    assert got(R.top_documents(empty_docs(spark), asked)) == []
    assert got(R.top_documents(odd_docs(spark), asked.limit(0))) == []
