"""Token ids in fixed-width bit-packed blocks, written and read back with Spark (operator 2).

File format: a Parquet data set in the shared folder, one row per block, in the
order of the documents. A block holds whole documents:

* ``part, block``     place of the block: range partition, then number within it
* ``first``           ids in earlier blocks of the same part
* ``doc_ids, ends``   its documents and the id offset at which each ends in the block
* ``payload``         16-byte header (b"TIDS", version, bits, 2 spare bytes, u64 number
                      of ids), then the ids, ``bits`` bits each, least significant first

``bits`` is the least width that holds the vocabulary. As every id has the same
width, id i lies at bit i * bits: a span is read without unpacking what is before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.llm.bpe import default_path, worker_encoder
from postlens.llm.columns import slices
from postlens.llm.files import shared_path
from postlens.llm.worker import trim

_HEAD, _HEAD_SIZE = "<4sBBHQ", 16
_BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<bigint>, ends array<bigint>, payload binary"
_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])


def width(vocabulary: int) -> int:
    """Least number of bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Header and packed ids; raises ValueError for an id that needs more bits."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    head = struct.pack(_HEAD, b"TIDS", 1, bits, 0, len(ids))
    if bits in (8, 16, 32):
        return head + ids.astype(f"<u{bits // 8}").tobytes()
    parts = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        some = ids[i:i + (1 << 16), None] >> np.arange(bits, dtype=np.uint32) & 1
        parts.append(np.packbits(some.astype(np.uint8), bitorder="little").tobytes())
    return head + b"".join(parts)


def unpack(payload: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """ids [begin, end) of a block, read from their own bytes alone."""
    magic, version, bits, _, n = struct.unpack_from(_HEAD, payload)
    if magic != b"TIDS" or version != 1:
        raise ValueError("no block of token ids")
    end = n if end is None else min(end, n)
    if end <= begin:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", end - begin, _HEAD_SIZE + begin * bits // 8).astype(np.uint32)
    low, high = begin * bits // 8, (end * bits + 7) // 8
    raw = np.concatenate([np.frombuffer(payload, np.uint8, high - low, _HEAD_SIZE + low), np.zeros(8, np.uint8)])
    at = np.arange(begin, end, dtype=np.int64) * bits - low * 8
    word = np.zeros(len(at), np.uint64)
    for k in range((bits + 7) // 8 + 1):
        word |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _blocks(path: str, end_id: int, block_ids: int, id_col: str, text_col: str):
    def run(batches):
        from pyspark import TaskContext

        encoder, part, block, first = worker_encoder(path), TaskContext.get().partitionId(), 0, 0
        bits = width(max(encoder.size, end_id + 1))
        waiting, docs, ends, n = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, block, first, n, docs, ends, pack(np.concatenate(waiting), bits)), _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            keys, texts = batch[id_col].to_pylist(), batch[text_col]
            for a, b in slices(texts, 4 << 20):
                ids, offsets = encoder.encode(texts.slice(a, b - a))
                for k in range(b - a):
                    own = ids[offsets[k]:offsets[k + 1]]
                    if n and n + len(own) + 1 > block_ids:
                        yield flush()
                        block, first = block + 1, first + n
                        waiting, docs, ends, n = [], [], [], 0
                    waiting += [own, np.array([end_id], np.uint32)]
                    n += len(own) + 1
                    docs.append(keys[a + k])
                    ends.append(n)
            trim()
        if n:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, *, path: str | None = None, end_id: int = 2, block_ids: int = 1 << 17,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write blocks in ascending document order at ``out``.

    Documents are dealt out in ranges of their id before they are encoded, so each
    task writes its own file of consecutive documents. A null text is empty (its end id is
    still written); rows with a null id come first; rows that share an id stand in
    the order of their texts; an empty table writes no block. A document is never
    divided between blocks: one of over ``block_ids`` ids has a block of its own.
    """
    if end_id < 0:
        raise ValueError("end_id is negative")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(_blocks(path or default_path(), end_id, block_ids, "id", "text"), _BLOCKS).write.parquet(out)


def _documents(batches):
    names = ["doc_id", "part", "at", "n_tokens", "ids_crc32"]
    for batch in batches:
        out: dict[str, list] = {k: [] for k in names}
        for row in batch.to_pylist():
            ids, begin = unpack(row["payload"]).astype("<u4"), 0
            for doc, end in zip(row["doc_ids"], row["ends"], strict=True):
                for k, v in zip(names, (doc, row["part"], row["first"] + begin, end - begin, zlib.crc32(ids[begin:end].tobytes())), strict=True):
                    out[k].append(v)
                begin = end
        yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int32() if k == "part" else pa.int64()) for k in names], names)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: one row per document, from the files.

    A part's start is the sum of the parts before it: one small row per part, read
    from the two number columns alone.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(out)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = blocks.select("part", "first", "doc_ids", "ends", "payload").mapInArrow(_documents, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_span(spark: SparkSession, out: str, doc_id: int, begin: int, end: int) -> np.ndarray:
    """ids [begin, end) of one document: random access through the block's offsets."""
    row = (spark.read.schema(_BLOCKS).parquet(out).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).limit(1).collect() or [None])[0]
    if row is None:
        raise KeyError(doc_id)
    k = row["doc_ids"].index(doc_id)
    base = row["ends"][k - 1] if k else 0
    return unpack(bytes(row["payload"]), base + begin, min(base + end, row["ends"][k]))


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` with :func:`write_tokens` in the shared folder and return what :func:`read_tokens` finds there."""
    out = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, **options)
    return read_tokens(docs.sparkSession, out)
