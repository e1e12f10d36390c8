"""Shared rows: nulls, empty and long texts, ties, repeated rows, and columns that clash with inner names."""

import os
import random

WORDS = ("red green blue house river stone light cloud paper glass under over between summer winter field garden window door table").split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", "   \t\n ", "one", "One two", base, base.upper(), base, " ".join(near), prose(5000, 2), "é ü ñ 日本", prose(30, 3), None, "a@b.com " * 300]
    return [(i, t, ["en", None][i % 2], ["s1", None, "s2"][i % 3], None) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    """The rows once, one of them twice, and one with a null id; with extra columns."""
    rows = odd_rows() + [odd_rows()[5], (None, "null id " + prose(20, 9), "en", "s1", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("sha", "row", "key", "rid", "size", "times", "digest", "token", "maybe", "seen", "x", "score", "unit", "id", "n"):
        df = df.selectExpr("*", f"'clash' as {c}")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def files_of(folder):
    return [f for _, _, names in os.walk(folder) for f in names]


def test_fixture_has_the_cases():
    texts = [r[1] for r in odd_rows()]
    assert None in texts and "" in texts and max(len(t or "") for t in texts) > 20_000
