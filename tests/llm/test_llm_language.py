"""Language (13): held-out accuracy, spans of mixed texts, Viterbi against all sequences, odd rows."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_fixtures import empty_docs, odd_docs

from postlens.llm import language as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.languages(docs).toPandas().merge(docs.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.98
    for r in got.itertuples():
        parts = [x.rsplit(":", 2) for x in r.spans.split(",")]
        ends = [(int(a), int(b)) for _, a, b in parts]
        assert all(a < b for a, b in ends) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False)) and ends[-1][1] <= len(r.text)
        assert all(p[0] != q[0] for p, q in zip(parts, parts[1:], strict=False))


def test_labels_outside_the_fold_only(spark):
    """Changed labels of held-out rows change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    wrong = docs.selectExpr("doc_id", "text", "source", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) as lang")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(L.languages(docs)) == key(L.languages(wrong))


def test_spans_of_mixed_text(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 800 and 3000").orderBy("doc_id").collect()
    by = {x: [re.sub(r"\s+", " ", r.text) for r in docs if r.lang == x][:12] for x in ("en", "de", "fr", "es")}
    hit = total = 0
    for i in range(12):
        for a, b in itertools.permutations(by, 2):
            if i < min(len(by[a]), len(by[b])):
                one, two = by[a][i][:400], by[b][i][-400:]
                df = pa.array([f"{one} {two}"])
                p = L.Pieces(df)
                own = L.viterbi(model.judge(p)[p.index], p.bounds, L.SWITCH)
                want = np.where(p.start < len(one), model.languages.index(a), model.languages.index(b))
                hit, total = hit + (own == want).sum(), total + len(own)
    assert total > 1000 and hit / total > 0.95


def brute(score, switch):
    n, k = score.shape
    return max(sum(score[t, s] for t, s in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False)) for path in itertools.product(range(k), repeat=n))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(0, 8), max_size=6), st.integers(1, 3), st.integers(1, 4), st.booleans())
def test_viterbi_is_best(seed, lengths, k, block, whole):
    rng = np.random.default_rng(seed)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    score = rng.integers(-3, 4, (bounds[-1], k)).astype(float) if whole else rng.standard_normal((bounds[-1], k)) * 2
    got = L.viterbi(score, bounds, 1.0, block)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            own = got[a:b]
            assert abs(score[a:b][np.arange(b - a), own].sum() - (np.diff(own) != 0).sum() - brute(score[a:b], 1.0)) < 1e-9


def test_pieces():
    texts = ["ab  cd", None, "", "12 x9 ..", "Привет,мир abcДЕ", "a" * 70, "日本語テキスト", " \n", "z"]
    p = L.Pieces(pa.array(texts))
    got = [[t[s - p.rows[i]:e - p.rows[i]] for s, e in zip(p.start[a:b], p.end[a:b], strict=True)] for i, (t, a, b) in enumerate(zip(texts, p.bounds, p.bounds[1:], strict=False))]
    assert got == [["ab", "cd"], [], [], ["12", "x9", ".."], ["Привет,мир", "abc", "ДЕ"], ["a" * 32, "a" * 32, "a" * 6], ["日本語", "テキスト"], [], ["z"]]
    flat = [x for row in got for x in row]
    assert [int(p.letters[i]) for i in p.index] == [sum(c.isalpha() for c in x) for x in flat]
    names = [L.SCRIPT_NAMES[p.script[i]] for i in p.index]
    assert names == ["Latin", "Latin", "", "Latin", "", "Cyrillic", "Latin", "Cyrillic", "Latin", "Latin", "Latin", "Han", "Kana", "Latin"]


def test_grams_are_those_of_each_piece():
    p = L.Pieces(pa.array(["Ab c", "abcd ñ"]))
    names = p.text.tobytes().decode("utf-32-le").lower().split()
    count = {n: 0 for n in names}
    for _, piece in p.grams(16):
        for i in piece.tolist():
            count[names[i]] += 1
    want = {n: len(n) + sum(max(0, len(n) + 2 - k + 1) for k in (2, 3, 4)) for n in names}
    assert count == want


def test_scripts_narrow(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en"), ("guten tag wie geht es", "de")] * 8)]
    rows += [(100, "мир hello", None), (101, "12 34", None), (102, None, "en"), (103, "日本", None), (104, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score, r.spans) for r in L.languages(df).collect()}
    model = L.learn(df)
    able = dict(zip(L.SCRIPT_NAMES, model.able.tolist(), strict=True))
    assert able["Cyrillic"] == [False, False, True] and able["Latin"] == [True, True, False] and able["Han"] == [True] * 3
    assert got[100][2] == "ru:0:3,en:4:9" and got[100][0] == "en"
    assert got[101] == ("und", 0.0, "") and got[102] == ("und", 0.0, "") and got[104] == ("und", 0.0, "")
    assert got[103][0] in ("ru", "en", "de") and got[103][1] == 1.0


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = L.languages(docs.repartition(3)).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} <= {"en", "und"} and all(0 <= r.score <= 1 for r in got)
    none = L.languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(got)
    assert L.languages(empty_docs(spark)).collect() == []


def test_bytes_that_are_no_text():
    bad = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 3, 5], np.int32)), pa.py_buffer(b"a\xffbcd")])
    assert len(L.Pieces(bad).index) == 2
