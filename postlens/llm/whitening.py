"""Whitening of embeddings on their leading principal components (operator 11).

Vectors become whole numbers, so sums over all rows are exact. Sums and centred products are
gathered per task and added up by Spark; the covariance of a fixed width is all that reaches the driver,
where :mod:`postlens.llm.spectrum` finds its leading eigenpairs by spectrum slicing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.files import written
from postlens.llm.spectrum import leading
from postlens.llm.sums import SCHEMA, blocks, matrix_sum

#: Entries at or beyond this (after scaling) are no whole numbers of 64 bits.
TOO_LARGE = 2.0**62
_BLOCK = 64


def whole_numbers(column: pa.Array, scale: float, shift: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each usable row or -1, rows of this width, their x as int64 [rows, width])."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # null entries are nan
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * scale)
    bad = ~(np.abs(scaled) < TOO_LARGE)
    ends = np.cumsum(np.maximum(length, 0))
    wrong = np.concatenate([[0], np.cumsum(bad)])
    starts = ends - np.maximum(length, 0)
    length[(length == 0) | (wrong[ends] > wrong[starts])] = -1
    rows = np.flatnonzero(length == width) if width else np.zeros(0, np.int64)
    if not len(rows):
        return length, rows, np.zeros((0, width or 0), np.int64)
    x = scaled[starts[rows][:, None] + np.arange(width)]
    return length, rows, x.astype(np.int64) + shift


def _products(rows: DataFrame, read, center: np.ndarray) -> np.ndarray:
    """Sum over all rows of (y - center)(y - center)'."""
    k = len(center)

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            y = read(batch)
            for a in range(0, len(y), 4096):
                own = y[a:a + 4096] - center
                total += own.T @ own
        yield from blocks(total, _BLOCK)

    return matrix_sum(rows.mapInArrow(run, SCHEMA), (k, k), _BLOCK)


def _sums(rows: DataFrame, read, width: int) -> tuple[int, list[int]]:
    """Exact number of rows and sum of each dimension: high and low halves are added apart, in decimals."""

    def run(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = read(batch)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(width, n))], ["dim", "high", "low", "n"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.mapInArrow(run, "dim int, high long, low long, n long").groupBy("dim").agg(whole("high"), whole("low"), whole("n")).collect()
    sums = {r["dim"]: int(r["high"]) * 2**32 + int(r["low"]) for r in found}
    return int(found[0]["n"]), [sums[k] for k in range(width)]


def _squares(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null where 64 bits do not hold it."""
    most = max((abs(n * int(v) - s) for lohi in (x.min(0), x.max(0)) for v, s in zip(lohi.tolist(), sums, strict=True)), default=0) if len(x) else 0
    if most * most * max(1, x.shape[1]) < 2**63:
        own = n * x - np.array(sums, np.int64) if all(abs(s) < 2**63 for s in sums) and n * max(1, int(np.abs(x).max(initial=0))) < 2**63 else None
        if own is not None:
            return pa.array((own * own).sum(1))
    own = x.astype(object) * n - np.array(sums, object)
    return pa.array([v if v < 2**63 else None for v in (own * own).sum(1).tolist()], pa.int64())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per kept vector and component.

    Each entry c counts as floor(scale * c) + shift. Left out are vectors that are null or empty, hold null or
    non-finite entries or some that 64 bits do not hold, and vectors of another length than most have (of
    equally frequent lengths the longest counts). Repeated rows and ids count each for itself, a null id stays null.
    Components whose eigenvalue is zero up to rounding (one row, equal rows, fewer dimensions than
    ``components``) have no unit scale and are left out, so such a table, like an empty one, may give no row.
    ``deviation`` is null where 64 bits do not hold it. ``vectors`` is read four times.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def lengths(batches):
        total: dict[int, int] = {}
        for batch in batches:
            own, _, _ = whole_numbers(batch["v"], scale, shift)
            for k, c in zip(*(a.tolist() for a in np.unique(own[own > 0], return_counts=True)), strict=True):
                total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["width", "n"])

    usual = rows.select("v").mapInArrow(lengths, "width long, n long").groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if usual is None:
        return spark.createDataFrame([], _OUT)
    width = usual["width"]
    read = lambda batch: whole_numbers(batch["v"], scale, shift, width)[2]
    n, sums = _sums(rows.select("v"), read, width)
    mean = np.array([s / n for s in sums])
    covariance = _products(rows.select("v"), read, mean) / n
    values, axes = leading(covariance, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], _OUT)
    turn = (axes / np.sqrt(values)[:, None]).T

    def project(batches):
        for batch in batches:
            _, kept, x = whole_numbers(batch["v"], scale, shift, width)
            z = (x - mean) @ turn
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(kept)), _squares(x, n, sums), flat], ["vec_id", "deviation", "z"])

    done = written(rows.mapInArrow(project, "vec_id long, deviation long, z array<double>"), "whitened")
    own = lambda batch: batch["z"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    center = np.array(done.agg(*[F.avg(F.col("z")[i]) for i in range(k)]).first(), float)
    error = float(np.abs(_products(done.select("z"), own, center) / n - np.eye(k)).max())
    share = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    one = done.select("vec_id", "deviation", F.posexplode("z").alias("pos", "whitened"))
    return one.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      "whitened", F.get(share, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))
