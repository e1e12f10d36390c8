"""Which of many needles stand in which field values: substring matching of two tables without comparing all pairs.

A needle is found by one of its 3-grams, the one that the fewest needles share (a shorter needle is its own gram). The
grams of the distinct field values, with the value's key alone, meet these anchors; only pairs that do are
verified with ``contains`` on the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.session import stored

GRAM = 3


def lowered(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def grams(text: Column, lengths: Sequence[int] = (GRAM,)) -> Column:
    """The distinct substrings of these lengths, in one linear scan per length."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sorted(lengths)]))


def anchored(needles: DataFrame) -> DataFrame:
    """(field, needle, gram): each non-empty needle with its anchor."""
    own = F.when(F.length("needle") <= GRAM, F.array("needle")).otherwise(grams(F.col("needle")))
    every = needles.where(F.length("needle") > 0).select("field", "needle").distinct().withColumn("gram", F.explode(own))
    shared = every.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    best = every.join(shared, ["field", "gram"]).groupBy("field", "needle").agg(F.min(F.struct("n", "gram")).alias("best"))
    return best.select("field", "needle", F.col("best.gram").alias("gram"))


def found_needles(df: DataFrame, fields: Sequence[str], needles: DataFrame) -> DataFrame:
    """(field, vkey, found): per distinct lower-cased value that contains any needle of its field, those needles, sorted.

    ``needles(field, needle)`` are lower-cased; empty ones are left out. ``vkey`` is the md5 of the value.
    """
    anchors = stored(anchored(needles), "anchors")
    lengths = [r[0] for r in anchors.select(F.length("gram")).distinct().collect()]  # 1, 2 and 3 at most
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), lowered(f).alias("v")) for f in fields]))
    # distinct by the values themselves: a hash aggregate, where any value carried beside its key would be sorted
    values = df.select(pairs.alias("x")).select("x.field", "x.v").where(F.length("v") > 0).distinct()
    values = stored(values.withColumn("vkey", F.md5("v")), "values")
    met = values.select("field", "vkey", F.explode(grams(F.col("v"), lengths or [GRAM])).alias("gram")).join(anchors, ["field", "gram"]).select("field", "vkey", "needle")
    sure = met.where(F.length("needle") <= GRAM)
    maybe = met.where(F.length("needle") > GRAM).join(values, ["field", "vkey"]).where(F.col("v").contains(F.col("needle"))).select("field", "vkey", "needle")
    return sure.union(maybe).groupBy("field", "vkey").agg(F.array_sort(F.collect_set("needle")).alias("found"))


def with_found(df: DataFrame, columns: Sequence[str], fields: Sequence[str], found: DataFrame) -> DataFrame:
    """``columns`` of ``df`` and, per field, ``in_<field>``: the needles that its value contains."""
    out = df.select(*columns, *[F.md5(lowered(f)).alias(f"_key_{f}") for f in fields])
    for f in fields:
        own = found.where(F.col("field") == f).select(F.col("vkey").alias("_k"), F.col("found").alias(f"in_{f}"))
        out = out.join(own, F.col(f"_key_{f}") == F.col("_k"), "left").drop(f"_key_{f}", "_k")
        out = out.withColumn(f"in_{f}", F.coalesce(f"in_{f}", F.array().cast("array<string>")))
    return out
