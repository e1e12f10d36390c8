"""Matrices that tasks gather, added up by Spark block of rows by block of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "part int, body binary"


def blocks(matrix: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """A task's matrix as rows of SCHEMA, ``rows`` of its rows in each, compressed; blocks of zeros are not sent."""
    for part, at in enumerate(range(0, len(matrix), rows)):
        own = np.ascontiguousarray(matrix[at:at + rows], float)
        if own.any():
            body = own.nbytes.to_bytes(8, "little") + pa.compress(own.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([body], pa.binary())], ["part", "body"])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, body in zip(batch["part"].to_pylist(), batch["body"].to_pylist(), strict=True):
            own = np.frombuffer(pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), float)
            total[part] = total[part] + own if part in total else own
    for part, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "body"])


def matrix_sum(partials: DataFrame, shape: tuple[int, int], rows: int) -> np.ndarray:
    """The sum, of a shape that the caller bounds; each block is added up in one task, as it streams in."""
    out = np.zeros(shape)
    dealt = partials.repartition(max(1, min(-(-shape[0] // rows), 64)), "part")
    for row in dealt.mapInArrow(_add, SCHEMA).collect():
        at = row["part"] * rows
        out[at:at + rows] += np.frombuffer(row["body"], float).reshape(-1, shape[1])
    return out
