"""Exact duplicates by two Bloom passes (operator 4).

Pass 1 hashes every whole text (A-Z lower-cased, SHA-256) and tells a Bloom table which
bits were set twice. Pass 2 looks every hash up: a text whose bits are not all set
twice is certainly alone and passes straight through. Only the others are shuffled,
as hash and id, and settled exactly. The table grows with the rows up to 32 MB; past
that it passes more candidates on, never fewer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.columns import LOWER, text_buffers
from postlens.llm.files import as_rows, written
from postlens.llm.tally import all_set, buckets_for, tally

_PER_ROW, _K = 16, 2


def digests(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """SHA-256 of each text with A-Z lower-cased, and its first 8 bytes as a number."""
    data, offsets = text_buffers(column)
    raw, at = memoryview(LOWER[data]), offsets.tolist()
    found = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at, at[1:], strict=False)]
    return found, np.frombuffer(b"".join(found), "<i8")[::4]


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, nth (a number of the row), sha, h: written once, so the texts are read once."""

    def run(batches):
        for batch in batches:
            sha, h = digests(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["nth"], pa.array(sha, pa.binary()), pa.array(h, pa.int64())], ["doc_id", "nth", "sha", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("nth"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, nth long, sha binary, h long"), "sha")


def _repeat_table(rows: DataFrame) -> tuple[np.ndarray, int]:
    log_m = buckets_for(rows.count(), _PER_ROW, 1)
    return tally(rows, "h", log_m, k=_K, at_least=2), log_m


def _maybe_repeated(rows: DataFrame, table: np.ndarray, log_m: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            flag = all_set(shared.value, batch["h"].to_numpy(zero_copy_only=False), log_m, _K)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "nth", "sha")), pa.array(flag)], ["doc_id", "nth", "sha", "maybe"])

    return rows.mapInArrow(run, "doc_id long, nth long, sha binary, maybe boolean")


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest id stays (a
    null id is less than any other); of rows that share id and text exactly one is ``kept``. An
    empty table gives an empty table; other columns are not read.
    """
    rows = hashed(docs, id_col, text_col)
    flagged = _maybe_repeated(rows, *_repeat_table(rows))
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    again = flagged.where("maybe")
    groups = again.groupBy("sha").agg(F.max(F.struct("doc_id", "nth")).alias("stays"), F.count("*").alias("group_size"))
    # joined by the hex form: the sums are dealt out anew, so the rows of a hot hash can be split between tasks
    text_sha = F.lower(F.hex("sha")).alias("text_sha256")
    settled = again.select("doc_id", "nth", text_sha).join(groups.select("stays", "group_size", text_sha), "text_sha256")
    settled = settled.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("nth") == F.col("stays.nth")).alias("kept"), "text_sha256")
    return alone.union(settled)


def _marks(h: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A number of a text and an id together; a null id counts as 0."""
    return h ^ (ids.fill_null(0).to_numpy(zero_copy_only=False) << 21)


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) without the rows that :func:`duplicate_groups` does not keep.

    Texts that are certainly alone are not shuffled. Of the others the id that stays is settled by hash and id; a
    Bloom table of these pairs drops the copies where they are read, and what it passes is held against the pairs exactly.
    """
    rows = hashed(docs, id_col, text_col)
    table, log_m = _repeat_table(rows)
    again = _maybe_repeated(rows, table, log_m).where("maybe")
    stays = written(again.groupBy("sha").agg(F.max("doc_id").alias("stays")), "stays")
    log_k = buckets_for(stays.count(), _PER_ROW, 1)

    def marked(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(batch["sha"].to_pylist()), "<i8")[::4]
            yield pa.RecordBatch.from_arrays([pa.array(_marks(h, batch["stays"]))], ["mark"])

    context = docs.sparkSession.sparkContext
    repeated, staying = context.broadcast(table), context.broadcast(tally(stays.mapInArrow(marked, "mark long"), "mark", log_k, k=_K))

    @F.arrow_udf("struct<sha: binary, alone: boolean, stays: boolean>")
    def look(text: pa.Array, ids: pa.Array) -> pa.Array:
        sha, h = digests(text)
        found = ~all_set(repeated.value, h, log_m, _K), all_set(staying.value, _marks(h, ids), log_k, _K)
        return pa.StructArray.from_arrays([pa.array(sha, pa.binary()), *map(pa.array, found)], ["sha", "alone", "stays"])

    key = F.col("row")[id_col].cast("long")
    seen = as_rows(docs).select("row", look(F.col("row")[text_col].cast("string"), key).alias("seen"))
    alone = seen.where("seen.alone").select("row.*")
    maybe = seen.where("not seen.alone and seen.stays").select("row", F.hex("seen.sha").alias("key"))
    kept = maybe.join(stays.select(F.hex("sha").alias("key"), "stays"), "key").where(key.eqNullSafe(F.col("stays")))
    # rows that repeat text and id fold under another key than the join's, which may so be split
    return alone.union(kept.withColumn("once", F.md5("key")).dropDuplicates(["once"]).select("row.*"))
