"""Patterns that are tried only where a match can begin give what the plain ones give."""
import random

import pytest
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.text import UNICODE, anchored_pattern, first_characters, guarded_rlike

PATTERNS = [p for _, p in V.EXPERIENCE_PATTERNS] + [V.SALARY_TEXT_PATTERN, r"a(?:b|c)|(?:x|\$)+y", r"-a|&b|c?d", r"\b(?:a|b)?\s*year", r"(a)\1|b", "(?i)ab|c"]


def test_first_characters():
    assert first_characters(r"\b(?:0|1|2)\+?\s*(?:years?|yrs?)|fresher") == "012f"
    assert first_characters(V.EXPERIENCE_PATTERNS[3][1]) == "12-9pad"
    assert first_characters(V.SALARY_TEXT_PATTERN) == "₹IRU\\$"
    for unsure in ("a?b", "(?:a|b)?c", "(?:a|[^b])c", r"\d+x", "", "a|", "(?i)a", r"(a)\1", "x*y", "a{0}b", "(?=a)b"):
        assert first_characters(unsure) is None and anchored_pattern(unsure) == unsure


def test_experience_patterns_are_not_tried_everywhere(spark):
    df = spark.createDataFrame([("x",)], "t string").select(*[guarded_rlike(F.col("t"), p) for _, p in V.EXPERIENCE_PATTERNS])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "(?U)\\b" not in plan and "(?U)(?=[012])" in plan


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_matches(spark, pattern):
    rng = random.Random(5)
    pieces = ["1", "2", "10", "35", "+", " ", " ", "years", "yr", "fresher", "entry", "level", "junior", "mid", "lead", "director", "é", "_", "a", "b", "c", "d",
              "x", "y", "$", "₹", "INR", "inr", "ınr", "Rs.", "usd", ",", "-", "&", "LPA", "ſ", "K", "per month", "\n", "𝟙"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(2000)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for flags in ("", "(?i)"):
        spans = lambda p: F.regexp_extract_all("t", F.lit(flags + UNICODE + p), F.lit(0))  # noqa: B023, E731
        assert df.where(~spans(pattern).eqNullSafe(spans(anchored_pattern(pattern)))).count() == 0
    assert df.where(~F.col("t").rlike(UNICODE + pattern).eqNullSafe(guarded_rlike(F.col("t"), pattern))).count() == 0
