"""Bounded tables of small counts over hash buckets, gathered sparsely and merged bucket range by bucket range.

Each task sends, per range of buckets, only the buckets that it has met, compressed
(about a byte a value). One streaming pass per range adds them up, so no task
holds more than its ranges, however many tasks there are. The merged table has a
fixed bound (``MAX_BYTES``) and may therefore be broadcast. Past the bound the
buckets fill up: a filter then passes more rows than needed, but never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES = 32 << 20
RANGE_BITS = 18
_SCHEMA = pa.schema([("range", pa.int32()), ("body", pa.binary())])


def buckets_for(n: int, per_value: int, bits_each: int) -> int:
    """log2 of the number of buckets: ``per_value`` times ``n``, within MAX_BYTES."""
    want = max(RANGE_BITS, int(np.ceil(np.log2(max(2, n * per_value)))))
    return min(want, int(np.log2(MAX_BYTES * 8 // bits_each)))


def positions(hashes: np.ndarray, log_m: int, k: int) -> list[np.ndarray]:
    """k bucket numbers of each 64-bit hash."""
    h = np.asarray(hashes).astype(np.uint64, copy=False)
    out = []
    for _ in range(k):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out.append(h >> np.uint64(64 - log_m))
    return out


def level_of(count) -> np.ndarray:
    """0, 1 and 2 as they are, then powers of two: 3 for 3 and 4, 4 for 5 to 8, up to 15."""
    count = np.asarray(count)
    return np.where(count < 3, count, np.minimum(15, 1 + np.ceil(np.log2(np.maximum(count, 1))))).astype(np.uint8)


class Sparse:
    """Counts of one task: buckets met, each with its number, at most 255."""

    def __init__(self, log_m: int, k: int, most: int = 1_500_000):
        self.log_m, self.k, self.most, self.parts, self.n = log_m, k, most, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts += positions(hashes, self.log_m, self.k)
        self.n += self.k * len(hashes)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        at, count = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.n = [], 0
        bound = np.searchsorted(at, np.arange((1 << (self.log_m - RANGE_BITS)) + 1, dtype=np.uint64) << np.uint64(RANGE_BITS))
        ranges, bodies = [], []
        for r in np.flatnonzero(np.diff(bound)):
            own = at[bound[r]:bound[r + 1]] & np.uint64((1 << RANGE_BITS) - 1)
            step = np.diff(own.astype(np.int64), prepend=0)
            raw = np.int64(len(own)).tobytes() + np.minimum(step, 255).astype(np.uint8).tobytes()
            long = step >= 255
            raw += step[long].astype(np.int32).tobytes() + np.minimum(count[bound[r]:bound[r + 1]], 255).astype(np.uint8).tobytes()
            ranges.append(r)
            bodies.append(_pack(raw))
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(bodies, pa.binary())], schema=_SCHEMA)


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    step = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    long = np.flatnonzero(step == 255)
    step[long] = np.frombuffer(raw, np.int32, len(long), 8 + n)
    return np.cumsum(step), np.frombuffer(raw, np.uint8, n, 8 + n + 4 * len(long))


def _merged(bits_each: int, at_least: int):
    def run(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, body in zip(batch["range"].to_pylist(), batch["body"].to_pylist(), strict=True):
                at, count = _unpack(body)
                table = tables.setdefault(r, np.zeros(1 << RANGE_BITS, np.uint16))
                table[at] = np.minimum(table[at].astype(np.uint32) + count, 65535)
        for r, table in tables.items():
            if bits_each == 1:
                body = np.packbits(table >= at_least, bitorder="little")
            else:  # nibbles: 0, 1, 2, then powers of two
                level = level_of(table)
                body = level[::2] | (level[1::2] << 4)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([body.tobytes()], pa.binary())], schema=_SCHEMA)

    return run


def merge(sparse: DataFrame, log_m: int, bits_each: int = 1, at_least: int = 1) -> np.ndarray:
    """The merged table (uint8, MAX_BYTES at most) of what tasks have sent as ``range int, body binary`` rows."""
    n_ranges = 1 << (log_m - RANGE_BITS)
    each = (1 << RANGE_BITS) * bits_each // 8
    table = np.zeros(n_ranges * each, np.uint8)
    spread = sparse.repartition(min(n_ranges, 64), "range")
    for row in spread.mapInArrow(_merged(bits_each, at_least), "range int, body binary").collect():  # MAX_BYTES at most
        table[row["range"] * each:(row["range"] + 1) * each] = np.frombuffer(row["body"], np.uint8)
    return table


def tally(df: DataFrame, column: str, log_m: int, k: int = 1, bits_each: int = 1, at_least: int = 1) -> np.ndarray:
    """Merged table over a column of 64-bit hashes: bit set where a bucket was met ``at_least`` times (or nibble levels)."""

    def run(batches):
        own = Sparse(log_m, k)
        for batch in batches:
            h = batch.column(0)
            yield from own.add(h.drop_null().to_numpy(zero_copy_only=False))
        yield from own.flush()

    return merge(df.select(column).mapInArrow(run, "range int, body binary"), log_m, bits_each, at_least)


def all_set(table: np.ndarray, hashes: np.ndarray, log_m: int, k: int) -> np.ndarray:
    """Whether all k bits of each hash are set."""
    out = np.ones(len(hashes), bool)
    for at in positions(hashes, log_m, k):
        out &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def levels(table: np.ndarray, hashes: np.ndarray, log_m: int) -> np.ndarray:
    """Nibble of each hash's bucket: 0 (never met), 1 (once), 2, 3, ... by powers of two."""
    at = positions(hashes, log_m, 1)[0]
    return (table[at >> np.uint64(1)] >> (4 * (at & np.uint64(1))).astype(np.uint8)) & 15
