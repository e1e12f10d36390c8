"""Mixing sources to target weights by balanced sampling with the cube method (operator 10).

Each document of a source should be taken target / source_size times on average. The whole
part of that rate is certain; the fraction is an inclusion probability. The flight
phase moves the probabilities of a few documents at a time along the null space of
the constraints (document total and word total stay the same) until all but two of a
shard are 0 or 1. The two left of every shard meet in the next round; the last
round of a source lands its last documents where the word total is nearest.

Shards are dealt by a hash of the document, so a hot source is many small groups, and
neither partitioning nor reruns change the outcome.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.files import as_rows, written

SHARD = 250
_EPS = 1e-9
_STATE = "doc_id long, source string, size long, source_size long, target double, base int, pi double, h long, shard long"


def word_count(text) -> F.Column:
    """Number of words (runs of non-space characters); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target, from ``sizes(source, size)``.

    Sources by code point (null last) take ``weights`` in turn and share all sizes by weight; a target stops
    at ``most`` times its source's size and what is over is shared anew. That ends at one level per unit of
    weight, found here with running sums over the sources (one row each).
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = src.select("*", F.element_at(cycle, (nth % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    src = src.select("*", F.sum("source_size").over(whole).alias("total"), F.sum("w").over(whole).alias("w_all"),
                     F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    src = src.withColumn("capped", (F.col("total") - F.col("cap_before")) * F.col("w") >= F.col("cap") * (F.col("w_all") - F.col("w_before")))
    src = src.select("*", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0)).alias("cap_sum"), F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(whole), F.lit(0.0)).alias("w_sum"))
    level = (F.col("total") - F.col("cap_sum")) * F.col("w") / (F.col("w_all") - F.col("w_sum"))
    return src.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(level).alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight: probabilities moved until at most two are strictly between 0 and 1; sum(pi) and sum(pi * size) stay."""
    pi = pi.astype(float).copy()
    active: list[int] = []
    for unit in range(len(pi)):
        if _EPS < pi[unit] < 1 - _EPS:
            active.append(unit)
        while len(active) >= 2:
            a = active[:3]
            s = [float(size[i]) for i in a]
            if len(a) == 3:
                u = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            elif s[0] == s[1]:
                u = [1.0, -1.0]
            else:
                break
            up = min((1 - pi[i]) / v if v > 0 else pi[i] / -v for i, v in zip(a, u, strict=True) if v)
            down = min(pi[i] / v if v > 0 else (1 - pi[i]) / -v for i, v in zip(a, u, strict=True) if v)
            step = up if rng.random() * (up + down) < down else -down
            for i, v in zip(a, u, strict=True):
                pi[i] = min(1.0, max(0.0, pi[i] + step * v))
                if pi[i] < _EPS or pi[i] > 1 - _EPS:
                    pi[i] = round(pi[i])
            active = [i for i in active if 0 < pi[i] < 1]
    return pi


def landing(size: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """The last units (two at most): the outcome whose word total is nearest to the expected one."""
    left = np.flatnonzero((pi > 0) & (pi < 1))
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(((m >> k & 1) - pi[i]) * size[i] for k, i in enumerate(left))), m), default=0)
    pi = pi.copy()
    for k, i in enumerate(left):
        pi[i] = best >> k & 1
    return pi


def _round(last: bool, level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable")
        size = pdf["size"].to_numpy(float)
        rng = np.random.default_rng([seed, level, int(pdf["shard"].iloc[0]), int(pdf["h"].iloc[0]) & 0xFFFFFFFF])
        pi = flight(size, pdf["pi"].to_numpy(float), rng)
        return pdf.assign(pi=landing(size, pi) if last else pi)

    return run


def mixture(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 10,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken.

    ``size`` counts words (null text: 0), ``taken`` = size * times. Documents without words
    are never taken. Null sources are one source. Rows that share an id are drawn each for itself. An empty
    table gives an empty table.
    """
    sizes = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")), "sizes")
    src = written(source_targets(sizes, weights, most).withColumnRenamed("source", "_source"), "targets")
    rate = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    whole = F.floor(rate + _EPS)
    units = sizes.join(src, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("base"), F.greatest(F.lit(0.0), rate - whole).alias("pi"),
        F.xxhash64("doc_id", "size").alias("h"), F.ceil(F.col("n_docs") / SHARD).alias("shards"))
    open_ = f"pi > {_EPS}"
    parts = [units.where(f"not ({open_})").select(*[c.split()[0] for c in _STATE.split(", ")[:-2]]).withColumn("pi", F.lit(0.0))]
    state, level = units.where(open_), 0
    while True:
        most_shards = state.agg(F.max("shards")).first()[0] or 1
        last = most_shards <= 1
        dealt = state.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(level)), F.col("shards")).cast("long")).drop("shards")
        out = written(dealt.groupBy("source", "shard").applyInPandas(_round(last, level, seed), _STATE), f"round{level}").drop("h", "shard")
        if last:
            parts.append(out)
            break
        parts.append(out.where("pi = 0 or pi = 1"))
        state, level = out.where("pi > 0 and pi < 1"), level + 1
        left = state.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / SHARD).alias("shards"))
        state = state.join(left, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("h", F.xxhash64("doc_id", "size"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part.select(out.columns))
    times = (F.col("base") + F.col("pi").cast("int")).alias("times")
    return out.select("doc_id", "source", "size", "source_size", "target", times, (F.col("size") * (F.col("base") + F.col("pi").cast("int"))).cast("long").alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` (all columns), each row as often as :func:`mixture` takes it.

    Rows that share id and size are interchangeable: they share their times out evenly.
    """
    drawn = mixture(docs, id_col=id_col, text_col=text_col, **options).groupBy(F.col("doc_id").alias("id"), F.col("size").alias("n")).agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    row = F.col("row")
    own = as_rows(docs).select("row", row[id_col].cast("long").alias("key"), word_count(row[text_col].cast("string")).alias("size"))
    both = own.join(drawn.where("times > 0"), F.col("key").eqNullSafe(F.col("id")) & (F.col("size") == F.col("n")))
    nth = F.row_number().over(Window.partitionBy("key", "size").orderBy("key"))
    both = both.withColumn("nth", F.when(F.col("rows") > 1, nth).otherwise(F.lit(1)))
    each = F.floor(F.col("times") / F.col("rows")) + F.when(F.col("nth") <= F.col("times") % F.col("rows"), 1).otherwise(0)
    both = both.withColumn("each", each.cast("int")).where("each > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("each"))).alias("copy")).select("row.*")
