import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.text import guarded_rlike, title_case

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJéÉüñ0123456789 -_/.,'()+#\t"
WORDS = st.lists(st.sampled_from(["data", "analyst", "scientist", "software", "engineer", "developer", "sde", "-",
                                  "full", "stack", "sre", "ml", "ops", "lead", "tech", "financial", "financia",
                                  "2", "years", "yrs", "senior", "site", "on", "office", " ", "  "]), max_size=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=20), min_size=1, max_size=30))
def test_title_case_property(spark, samples):
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r[0] for r in df.select(title_case("v")).collect()]
    assert got == [s.title() for s in samples]


@settings(max_examples=40, deadline=None)
@given(st.lists(WORDS.map(" ".join), min_size=1, max_size=30))
def test_guarded_rlike_equals_rlike(spark, texts):
    patterns = [p for p, _ in V.TITLE_RULES] + [p for _, p in V.EXPERIENCE_PATTERNS] + [p for _, p in V.JOB_TYPE_PATTERNS]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cols = [guarded_rlike(F.col("t"), p).alias(f"g{i}") for i, p in enumerate(patterns)]
    for row, text in zip(df.select(*cols).collect(), texts):
        for i, p in enumerate(patterns):
            assert row[f"g{i}"] == bool(re.search(p, text)), (p, text)
