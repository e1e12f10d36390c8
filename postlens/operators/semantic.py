"""Semantic top-k (G9): cosine of many query vectors with all stored vectors, block against block.

Vectors stream through Arrow batches; a matrix product per block of vectors and block of queries finds the few pairs
that can still enter a query's list, and only those are scored exactly (sums in order, in double precision). A task
keeps the best k per query; Spark ranks what the tasks have kept. Queries go to the tasks in chunks of
bounded size, one pass over the vectors for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from postlens.functions.numeric import py_round

#: Bytes of query vectors that one pass over the vectors takes along.
CHUNK_BYTES = 8 << 20
_ROWS, _QUERIES, _MARGIN = 2048, 512, 1e-9
#: Bytes of vectors that exact scoring gathers at once.
_GATHER_BYTES = 16 << 20


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: the rows that are not null and hold only finite numbers, and these as a matrix."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(np.maximum(length, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    starts = ends - np.maximum(length, 0)
    good = (length > 0) & (bad[ends] == bad[starts])
    out = {}
    for width in np.unique(length[good]).tolist():
        rows = np.flatnonzero(good & (length == width))
        out[width] = rows, flat[starts[rows][:, None] + np.arange(width)]
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the dimensions."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _cosine(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    return _dot(a, b) / ((np.sqrt(_dot(a, a)) + eps) * (np.sqrt(_dot(b, b)) + eps))


def _codes(rows: pa.ChunkedArray, queries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids as numbers, equal for equal ids; a null id equals none."""
    kind = pa.int64() if pa.types.is_integer(rows.type) and pa.types.is_integer(queries.type) else rows.type
    rows = pa.chunked_array([*rows.cast(kind).chunks, queries.cast(kind)]).combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    code = pc.fill_null(rows.dictionary_encode().indices, -1).to_numpy().astype(np.int64)
    n = len(code) - len(queries)
    return code[:n], np.where(code[n:] < 0, -2, code[n:])


class _Best:
    """The k best rows so far of each query: similarity falling, then id rising."""

    def __init__(self, queries: int, k: int, own: pa.Schema, id_col: str):
        self.k, self.id_col, self.least = k, id_col, np.full(queries, -np.inf)
        self.query, self.score, self.rows = np.zeros(0, np.int64), np.zeros(0), own.empty_table()

    def add(self, query: np.ndarray, score: np.ndarray, rows: pa.Table) -> None:
        query, score, rows = np.concatenate([self.query, query]), np.concatenate([self.score, score]), pa.concat_tables([self.rows, rows])
        order = pc.sort_indices(pa.table({"q": query, "s": score, "i": rows[self.id_col]}), [("q", "ascending"), ("s", "descending"), ("i", "ascending")], null_placement="at_start").to_numpy()
        sorted_query = query[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        order = order[nth < self.k]
        self.query, self.score, self.rows = query[order], score[order], rows.take(pa.array(order))
        last = np.flatnonzero(nth[nth < self.k] == self.k - 1)
        self.least[self.query[last]] = self.score[last]


def semantic_top_k(vectors: DataFrame, query: DataFrame, k: int = 15, id_col: str = "vec_id", vec_col: str = "embedding", eps: float = 1e-10,
                   query_id: str | None = None, exclude_self: bool = False) -> DataFrame:
    """Cosine of every query vector with every vector, x100, clamped 0..100, 1 decimal, top k per query, ties by id.

    Queries are a stated set, told apart by ``query_id`` (a column of ``query``; needed for more than one row). Vectors that are
    null, hold null or non-finite numbers, or are of another length than the query have no similarity with it and
    are left out. ``exclude_self`` leaves out pairs of equal ids. Norms get the reference's 1e-10.
    """
    spark = vectors.sparkSession
    asked = query.select((F.col(query_id) if query_id else F.lit(0)).alias("query_id"), F.col(vec_col).cast("array<double>").alias("_q"))
    count, width = asked.agg(F.count("*"), F.max(F.size("_q"))).first()
    if query_id is None and count > 1:
        raise ValueError("several query vectors need a query_id")
    chunks = max(1, -(-count * max(width or 1, 1) * 8 // CHUNK_BYTES))
    own = [c for c in vectors.columns if c != vec_col]
    rows = vectors.select(*own, F.col(vec_col).cast("array<double>").alias("_v"))
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), *[rows.schema[c] for c in own], StructField("similarity", DoubleType())])
    parts = [_pass(rows, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c), k, id_col, own, eps, exclude_self, schema) for c in range(chunks)]
    top = parts[0]
    for p in parts[1:]:
        top = top.union(p)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(id_col))
    top = top.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("similarity") * 100))
    return top.select(*(["query_id"] if query_id else []), "rank", *own, py_round(clamped, 1).alias("score"))


def _pass(rows: DataFrame, asked: DataFrame, k: int, id_col: str, own: list[str], eps: float, exclude_self: bool, schema: StructType) -> DataFrame:
    chunk = asked.toArrow().combine_chunks()  # CHUNK_BYTES at most
    ids = chunk["query_id"].combine_chunks() if chunk.num_rows else pa.array([], chunk.schema.field("query_id").type)
    queries = _matrix(chunk["_q"].combine_chunks()) if chunk.num_rows else {}

    def can_enter(near, least, same):
        """Pairs of a block that can be among the k best: of the list so far, and of the block itself."""
        near[np.isnan(near) if same is None else np.isnan(near) | same] = -np.inf
        good = (near >= least - _MARGIN) & (near > -np.inf)
        if len(near) > k and np.count_nonzero(good) > 4 * k * near.shape[1]:
            good &= near >= np.partition(near, len(near) - k, axis=0)[len(near) - k] - _MARGIN
        return np.nonzero(good)

    def run(batches):
        bests: dict[tuple, _Best] = {}  # of each block of queries
        for batch in batches:
            mine = pa.Table.from_batches([batch]).select(own)
            for width, (at, x) in _matrix(batch["_v"]).items():
                if width not in queries:
                    continue
                number, q = queries[width]
                unit, unit_q = (m / (np.sqrt((m * m).sum(1)) + eps)[:, None] for m in (x, q))
                row_code = query_code = None
                if exclude_self:
                    row_code, query_code = _codes(mine[id_col].take(pa.array(at)), ids.take(pa.array(number)))
                step = max(1, _GATHER_BYTES // (16 * width))
                for b in range(0, len(q), _QUERIES):
                    asked_here = number[b:b + _QUERIES]
                    best = bests.setdefault((width, b), _Best(len(asked_here), k, mine.schema, id_col))
                    for a in range(0, len(x), _ROWS):
                        near = unit[a:a + _ROWS] @ unit_q[b:b + _QUERIES].T
                        same = None if row_code is None else row_code[a:a + _ROWS, None] == query_code[None, b:b + _QUERIES]
                        i, j = can_enter(near, best.least, same)
                        for c in range(0, len(i), step):
                            r, n = i[c:c + step] + a, j[c:c + step]
                            best.add(n, _cosine(x[r], q[b + n], eps), mine.take(pa.array(at[r])))
        for (width, b), best in bests.items():
            if not len(best.query):
                continue
            out = best.rows.combine_chunks()
            asked_ids = ids.take(pa.array(queries[width][0][b + best.query]))
            columns = [asked_ids, *[out[c].combine_chunks() for c in own], pa.array(best.score)]
            yield from pa.Table.from_arrays(columns, ["query_id", *own, "similarity"]).to_batches()

    return rows.mapInArrow(run, schema)
