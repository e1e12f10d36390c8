"""Exact dedup (4), Jaccard join (7) and embedding near-duplicates (8) against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from test_llm_fixtures import empty_docs, odd_docs, prose

from postlens.llm import components, embed_dedup, exact_dedup, jaccard_join, tally

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_tally_has_no_false_negative(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-2**63, 2**63 - 1, 4000)
    repeated = values[:700]
    df = spark.createDataFrame([(int(v),) for v in [*values, *repeated]] + [(None,)], "h long").repartition(7)
    log_m = tally.buckets_for(4700, 16, 1)
    twice = tally.tally(df, "h", log_m, k=2, at_least=2)
    hit = tally.all_set(twice, values, log_m, 2)
    assert hit[:700].all() and hit[700:].mean() < 0.1
    levels = tally.tally(df, "h", log_m, bits_each=4)
    found = tally.levels(levels, values, log_m)
    assert (found[:700] >= 2).all() and (found >= 1).all()


def test_components_hub_chain_and_loops(spark):
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200)] + [(60, 59)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 141)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, (r.text or "").translate(LOW)) for r in docs.collect()]
    got = exact_dedup.duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {d: t for d, t in rows}[r.doc_id]
        same = [d for d, t in rows if t == text]
        assert r.group_size == len(same) and r.keep_id == max((d for d in same if d is not None), default=None)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.kept for r in got) == len({t for _, t in rows})
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_drop_duplicates_keeps_one_row_of_repeated_ids(spark):
    texts = [(1, "Hot"), (2, "hot"), (2, "HOT"), (2, "hot"), (None, "hot"), (3, "alone"), (None, None), (None, ""), (4, "null"), (None, "null"), (5, "x"), (5, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'c' as sha", "'c' as key", "'c' as stays", "'c' as once").repartition(4)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str) == sorted([(2, "hot"), (3, "alone"), (None, ""), (4, "null"), (5, "x")], key=str)


def test_exact_empty(spark):
    assert exact_dedup.duplicate_groups(empty_docs(spark)).count() == exact_dedup.drop_duplicates(empty_docs(spark)).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, closure(len(sets), links)


def edited(text, rng, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**6))
    return " ".join(words)


def test_jaccard_components(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "one", "ONE", "a b c d", "A b c d", "a b c d e", prose(3000, 1)]
    for k in range(12):
        base = prose(rng.choice([8, 20, 60, 150, 400]), 50 + k)
        texts += [base] + [edited(base, rng, rng.choice([0.002, 0.01, 0.02, 0.03, 0.05])) for _ in range(rng.choice([1, 5, 14]))]
    passage = prose(60, 77)
    texts += [prose(40, 500 + k) + " " + passage for k in range(60)]
    rng.shuffle(texts)
    sets, root = brute(texts)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(5)
    got = {r.doc_id: r for r in jaccard_join.components_of_documents(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), root[i])
    kept = jaccard_join.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and kept.columns == docs.columns


def test_jaccard_large_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    rng = random.Random(9)
    base = prose(80, 3)
    texts = [edited(base, rng, rng.choice([0.005, 0.013, 0.02, 0.03])) for _ in range(150)] + [prose(50, 900 + k) for k in range(50)]
    sets, root = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.components_of_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_forest_derives_answers(spark):
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 2**62, 300).astype(np.uint64))
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.integers(0, 300, rng.integers(0, 60))] = rng.integers(0, 2**62)
        sets.append(np.unique(own))
    links = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert closure(40, jaccard_join.linked_forest(np.arange(40), sets, 80)) == closure(40, links)


def test_jaccard_odd_and_empty(spark):
    docs = odd_docs(spark)
    got = jaccard_join.components_of_documents(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[0] == 0 and by_id[1] == 1 and by_id[6] == by_id[7] == by_id[8] == by_id[5] == 5
    assert jaccard_join.components_of_documents(empty_docs(spark)).count() == 0
    assert jaccard_join.keep_one_of_each(empty_docs(spark)).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    out = [list(map(float, v)) for v in rng.normal(size=(150, 24))]
    for k in range(10):
        centre = rng.normal(size=24)
        out += [list(map(float, centre + 0.12 * rng.normal(size=24))) for _ in range([2, 40][k == 0])]
    out += [out[3], out[3], [2 * x for x in out[4]]]
    out += [None, [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] * 24, [], [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]]
    return out


def test_embedding_links(spark, vectors, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    unit = []
    for v in vectors:
        ok = v and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    links = [(i, j) for i in range(len(unit)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95]
    root = closure(len(unit), links)
    number = np.bincount(np.array(links).ravel(), minlength=len(unit))
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, v string").repartition(3)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(vectors)
    found = sum(got[i].n_links for i in range(len(unit)))
    assert found <= number.sum() and found >= 0.98 * number.sum()
    assert all(got[i].n_links <= number[i] for i in range(len(unit)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(unit))]) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(unit)))


def test_embedding_repeated_and_null_ids(spark):
    def rows(pairs):
        df = spark.createDataFrame(pairs, "vec_id long, embedding array<double>")
        return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()), key=str)

    a, b, near = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 0.05, 0.0, 0.0]
    assert rows([(1, a), (1, b), (2, near)]) == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False)], key=str)
    assert rows([(1, a), (1, near)]) == [(1, 1, 1, True), (1, 1, 1, True)]
    assert rows([(None, a), (5, near), (None, b), (7, a)]) == sorted([(None, 2, 5, False), (5, 2, 5, True), (None, 0, None, True), (7, 2, 5, False)], key=str)
    assert rows([(None, a), (None, near)]) == [(None, 1, None, True), (None, 1, None, True)]


@pytest.mark.parametrize("hashes", [2, 3, 4, 5])
def test_embedding_recall_by_hashes(hashes):
    """Share of pairs at cosine 0.95 that meet in some bucket, for as many hashes as 10^2 to 10^10 vectors of 64 dimensions take."""
    rng = np.random.default_rng(hashes)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * side
    tables = embed_dedup.tables_for(hashes)
    a, b = (embed_dedup.codes(v, hashes, tables, 4, 8) for v in (x, y))
    meet = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1)
    assert meet.mean() >= 0.97


def test_embedding_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hadamard_rotation_keeps_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 16))
    y = embed_dedup.rotate(x, rng.choice([-1.0, 1.0], (3, 16)))
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(x @ x.T, y @ y.T)
