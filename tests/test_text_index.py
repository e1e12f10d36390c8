import re
import tempfile

import pytest
from pyspark.sql import functions as F

from postlens.operators import search as H
from postlens.operators import text_index as X

SCHEMA = "job_id string, title string, company string, description string, location string, posted_at int"


def _posts(spark):
    words = ["Python", "python3", "ÀÉÎ café", "sql", "aa", "aaa", "日本語テ", "New  York", "50%_x"]
    rows = [(str(i), words[i % 9], None if i % 5 == 0 else words[i % 7] + " " + words[i % 4], "x" * (i % 3) + words[(i // 9) % 9], words[i % 2], i % 40) for i in range(600)]
    return spark.createDataFrame(rows + rows[:3] + [("long", "t", "c", "ab" * 3000 + "needle" + "é" * 50, "l", 99)], SCHEMA)


@pytest.fixture(scope="module")
def index(spark):
    patch = pytest.MonkeyPatch()
    patch.setattr(X, "PART_ROWS", 150)
    patch.setattr(X, "BLOCK_ROWS", 16)
    patch.setattr(X, "_PIECE", 100)
    yield X.TextIndex.build(_posts(spark), tempfile.mkdtemp(prefix="pl-index-") + "/i")
    patch.undo()


@pytest.mark.parametrize("q", ["python", " PYTHON3 ", "café", "aaa", "aa", "a", "日本語", "w  y", "50%_", "needle", "babab", "ééé", "xyz", "", "python sql"])
def test_search_equals_the_scan(spark, index, q):
    df = _posts(spark)
    row = lambda x: [tuple(r) for r in x.collect()]
    assert sorted(row(index.matching(q)), key=str) == sorted(row(H.search(df, q, limit=10_000)), key=str)
    assert row(index.search(q, limit=20)) == row(H.search(df, q, limit=20))
    assert row(index.search(q, ["company"])) == row(H.by_field(df, "company", q))


def test_only_candidate_blocks_are_read(spark, index):
    found = index.matching("needle")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan(found).split("FileScan")[1:] if "job_id" in x.split("Batched")[0]]
    assert re.search(r"PartitionFilters: \[.*_part#", rows[0]) and re.search(r"PushedFilters: \[.*\(_block,", rows[0])
    lists = plan(index._candidates("needle", ["description"]))
    assert re.search(r"PartitionFilters: \[.*bucket#", lists) and re.search(r"PushedFilters: \[.*\(gram,", lists)
    assert index._candidates("needle", index.fields).count() == 1 and found.count() == 1


def test_many_blocks_and_empty_table(spark, index, monkeypatch):
    monkeypatch.setattr(X, "NAMED_BLOCKS", 1)
    assert index.matching("python").count() == H.search(_posts(spark), "python", limit=10_000).count()
    none = X.TextIndex.build(_posts(spark).where(F.lit(False)), tempfile.mkdtemp(prefix="pl-index-") + "/i")
    assert none.search("python").count() == 0 and none.search("p").count() == 0


def test_trigrams_of_a_block_equal_those_of_each_text(monkeypatch):
    import numpy as np

    from postlens.operators import text_index as T

    texts = ["supplier#000000001", None, "", "ab", "abc", "supplier#000000001", "héllo \U0001f600 wörld", "aaaa" * 9, "x" * 70, "abcabc"]
    want = sorted((int(g), i) for i, t in enumerate(texts) for g in T.trigrams(t or ""))
    calls = []
    real = np.unique
    for piece in (1 << 20, 64, 20, 4):  # all together, in groups, and long texts on their own
        monkeypatch.setattr(T, "_PIECE", piece)
        monkeypatch.setattr(T.np, "unique", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
        gram, row = T.row_trigrams(texts)
        assert list(zip(gram.tolist(), row.tolist(), strict=True)) == want
        if piece == 1 << 20:
            assert len(calls) == 2  # not one per text
        monkeypatch.setattr(T.np, "unique", real)
    assert len(T.row_trigrams([None, ""])[0]) == 0
