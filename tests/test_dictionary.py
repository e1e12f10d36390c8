import random
import re

import pytest
from pyspark.sql import functions as F

from postlens.functions.dictionary import MODES, labels_of, match_terms
from postlens.operators import extract as X

TERMS = tuple((t, t) for t in ["c++", "c#", "c", "go", "r", "node.js", "node", "machine learning", "machine", "ai", "sql", "ci/cd", "ci", ".net",
                               "a.", "co", "coco"])


def brute(text, mode):
    low = text.lower()
    out = set()
    for t, label in TERMS:
        q = re.escape(t)
        pat = {"substring": q, "boundary": r"\b" + q + r"\b", "lookaround": r"(?<!\w)" + q + r"(?!\w)"}[mode]
        if re.search(pat, low):
            out.add(label)
    return sorted(out)


@pytest.mark.parametrize("mode", MODES)
def test_matches_python_re(spark, mode):
    rng = random.Random(11)
    letters = list("abcgorstn+#./ -_lqéAC1²ß\n")
    pieces = [t for t, _ in TERMS] + letters
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.found for r in df.select("i", match_terms(F.col("t"), TERMS, mode).alias("found")).collect()}
    bad = [(t, got[i], brute(t, mode)) for i, t in enumerate(texts) if got[i] != brute(t, mode)]
    assert not bad, bad[:3]


def found(spark, text, mode, terms=TERMS):
    return spark.createDataFrame([(text,)], "t string").select(match_terms(F.col("t"), terms, mode)).first()[0]


def test_mode_disagreements(spark):
    assert found(spark, "I know C++ well", "boundary") == ["c"]          # \b after '+' needs a word char
    assert found(spark, "I know C++ well", "lookaround") == ["c", "c++"]
    assert "r" in found(spark, "react", "substring")
    assert "r" not in found(spark, "react", "lookaround")


def test_null_empty_long_and_labels(spark):
    assert found(spark, None, "substring") == [] and found(spark, "", "boundary") == []
    assert found(spark, "x " * 50_000 + "sql", "lookaround") == ["sql"]
    assert found(spark, "any", "substring", []) == []
    assert found(spark, "k8s", "lookaround", [("k8s", "kubernetes"), ("k8s", "k8s")]) == ["k8s", "kubernetes"]
    assert labels_of([("go", "a"), ("golang", "b")], "substring")["golang"] == ["a", "b"]
    assert labels_of([("go", "a"), ("golang", "b")], "lookaround")["golang"] == ["b"]
    with pytest.raises(ValueError):
        match_terms(F.lit("x"), TERMS, "fuzzy")


@pytest.mark.parametrize("mode", MODES)
def test_plan_is_native(spark, mode):
    df = spark.createDataFrame([("python",)], "t string").select(X.dictionary_terms(F.col("t"), X.skill_terms(), mode))
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_short_substring_lists_need_no_regex(spark):
    df = spark.createDataFrame([("Python and SQL",)], "t string").select(X.substring_skills_col(F.col("t")).alias("s"))
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first().s == ["python", "sql"]
    assert found(spark, "K8s and docker", "substring", [("k8s", "kubernetes"), ("docker", "docker"), ("k8s", "a"), ("8s", "a")]) == ["a", "docker", "kubernetes"]
    many = [(f"term{i:03d}", f"term{i:03d}") for i in range(200)]
    assert found(spark, "term007 TERM199", "substring", many) == ["term007", "term199"]
