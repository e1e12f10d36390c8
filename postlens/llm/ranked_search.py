"""Ranked lexical search by the Best Position Algorithm (operator 12).

Documents are split between tasks, and each task holds, for a slice of its documents, one list per
query term: the documents that have it, by falling impact. A query reads its lists side by side. A document that
turns up is looked up in all the query's lists at once (direct access), which gives its whole score and marks
its position in each of them. The best position of a list is the end of its unbroken run of marked positions; a
document not met yet stands behind it in every list, so it scores at most the sum of the impacts there.
That sum falls faster than the one at the positions last read. Reading stops once it is strictly below
the k-th best score: an equal score could still win by its id.

Query terms are kept for a block of queries at a time, and texts are read once per block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.columns import LOWER, distinct_words, row_starts, slices, text_buffers
from postlens.llm.files import written
from postlens.llm.worker import trim

#: Characters of query text whose terms are looked up in one reading of the documents.
BLOCK_CHARS = 4_000_000
#: A slice holds so many postings at most (a longer document stands alone), and a query's table of positions so many cells.
SLICE_POSTINGS, CELLS = 1_000_000, 16_000_000

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each term, the distinct terms (UTF-8, A-Z lower-cased), and each row's bounds among the terms."""
    data, offsets = text_buffers(column)
    solid, edge = _TERM[data], row_starts(len(data), offsets)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    index, kinds = distinct_words(LOWER[data], starts, ends)
    return index, kinds, np.searchsorted(starts, offsets)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term adds to a document's score; ``length``: the document's terms."""
    m = 100 - 50 + (50 * length * documents) // max(1, all_terms)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def best_positions(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best of documents 0 .. n_docs - 1, and of all that equal the k-th; some more may follow.

    ``lists``: documents and their impacts above 0, falling, for each term. Scores below ``floor`` are of no interest.
    """
    size = np.array([len(d) for d, _ in lists])
    base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    total = int(size.sum()) + len(lists)
    impact, doc = np.zeros(total, np.int64), np.full(total, -1, np.int64)  # behind each list: a place for documents that it lacks
    place = np.empty((len(lists), n_docs), np.int32)
    for i, (docs, own) in enumerate(lists):
        impact[base[i]:base[i] + size[i]], doc[base[i]:base[i] + size[i]] = own, docs
        place[i] = base[i] + size[i]
        place[i, docs] = np.arange(base[i], base[i] + size[i])
    met, marked = np.zeros(n_docs, bool), np.zeros(total, bool)
    best = np.zeros(len(lists), np.int64)
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step, least = 0, 16, floor
    while True:
        reading = np.flatnonzero(size > depth)
        own = doc[np.minimum(base[reading, None] + np.arange(depth, depth + step), (base + size)[reading, None])].ravel()
        own = own[own >= 0]
        own = np.unique(own[~met[own]])
        met[own] = True
        at = place[:, own]
        marked[at] = True
        score = impact[at].sum(0)
        keep = score >= max(least, 1)
        found, scores = np.concatenate([found, own[keep]]), np.concatenate([scores, score[keep]])
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            keep = scores >= least
            found, scores = found[keep], scores[keep]
        bound = 0
        for i in np.flatnonzero(best < size).tolist():
            run = marked[base[i] + best[i]:base[i] + size[i]]
            stop = int(run.argmin())
            best[i] = size[i] if run[stop] else best[i] + stop
            bound += int(impact[base[i] + best[i] - 1]) if best[i] < size[i] else 0
        if bound < least or (best == size).all():
            return found, scores
        depth, step = depth + step, step * 2


class Slice:
    """The impact lists of some documents, for all query terms."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        some = impact > 0
        doc, term, impact = doc[some], term[some], impact[some]
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.kinds, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(order))

    def lists(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.searchsorted(self.kinds, wanted)
        at = at[(at < len(self.kinds)) & (self.kinds[np.minimum(at, len(self.kinds) - 1)] == wanted)] if len(self.kinds) else at[:0]
        return [(self.doc[a:b], self.impact[a:b]) for a, b in zip(self.bounds[at], self.bounds[at + 1], strict=True)]


def top_of(lists: list[tuple[np.ndarray, np.ndarray]], low: int, high: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`best_positions` over documents low .. high - 1, cut in two where the table of positions would be too large."""
    lists = [x for x in lists if len(x[0])]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(lists) * (high - low) > CELLS and high - low > 1:
        mid = (low + high) // 2
        first = top_of([(d[d < mid], x[d < mid]) for d, x in lists], low, mid, k, floor)
        second = top_of([(d[d >= mid], x[d >= mid]) for d, x in lists], mid, high, k, floor)
        return np.concatenate([first[0], second[0]]), np.concatenate([first[1], second[1]])
    docs, scores = best_positions([(d - low, x) for d, x in lists], high - low, k, floor)
    return docs + low, scores


def _postings(vocabulary: pa.Array):
    """doc_id, n, terms, tfs of each document: its length and the query terms in it."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch["text"], 4 << 20):
                index, kinds, bounds = terms(batch["text"].slice(a, b - a))
                known = pc.fill_null(pc.index_in(kinds, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                own = known[index] if len(index) else np.zeros(0, np.int32)
                row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(bounds))
                pair, tf = np.unique((row << 32)[own >= 0] + own[own >= 0], return_counts=True)
                cut = np.searchsorted(pair, np.arange(b - a + 1, dtype=np.int64) << 32) * 4
                packed = [(x.astype(np.int32)).tobytes() for x in (pair & 0xFFFFFFFF, tf)]
                blobs = [pa.array([raw[i:j] for i, j in zip(cut, cut[1:], strict=False)], pa.binary()) for raw in packed]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(np.diff(bounds).astype(np.int64)), *blobs], ["doc_id", "n", "terms", "tfs"])
            trim()

    return run


def _holding(batches):
    """How many documents hold each term, over the documents of one task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        count = np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32))
        if len(count) > len(total):
            count[:len(total)] += total
            total = count
        else:
            total[:len(count)] += count
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["term", "df"])


def _search(items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, documents: int, all_terms: int, k: int):
    """item_id, doc_id, score: each item's k best documents of one task, and those that equal the k-th."""

    def run(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)  # ids, whether null, scores
        least = [0] * len(items)

        def read(part: pa.RecordBatch):
            ids, empty = part["doc_id"].fill_null(0).to_numpy(), part["doc_id"].is_null().to_numpy(zero_copy_only=False)
            blob = part["terms"].to_pylist()
            count = np.array([len(x) // 4 for x in blob], np.int64)
            term, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (blob, part["tfs"].to_pylist()))
            doc = np.repeat(np.arange(len(blob)), count)
            own = Slice(doc, term, impacts(weights[term], tf, part["n"].to_numpy()[doc], documents, all_terms))
            for q, (_, wanted) in enumerate(items):
                docs, scores = top_of(own.lists(wanted), 0, len(blob), k, least[q])
                if not len(docs):
                    continue
                own_ids, nulls, all_scores = (np.concatenate(x) for x in zip(held[q], (ids[docs], empty[docs], scores), strict=True))
                if len(all_scores) > k:
                    order = np.lexsort((own_ids, nulls, -all_scores))[:k]
                    own_ids, nulls, all_scores = own_ids[order], nulls[order], all_scores[order]
                held[q] = own_ids, nulls, all_scores
                if len(all_scores) == k:
                    least[q] = int(all_scores.min())

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch["terms"]).to_numpy() // 4)
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + SLICE_POSTINGS, "right")))
                read(batch.slice(at, end - at))
                at = end
            trim()
        for (item, _), (own_ids, nulls, scores) in zip(items, held, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(scores), pa.int64()), pa.array(own_ids, pa.int64(), mask=nulls), pa.array(scores)], ["item_id", "doc_id", "score"])

    return run


def top_documents(docs: DataFrame, queries: DataFrame, *, k: int = 50, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents (all, if fewer score above 0), equal scores by ascending id.

    Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. Null and empty texts have
    none: such documents are not counted and such queries get no row. Rows of ``queries`` that share an id, null
    included, are one query with the terms of all their texts. Repeated documents are ranked each for
    itself; a null doc_id comes behind the others of its score. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(item_col).cast("long").alias("item_id"), F.col(query_col).cast("string").alias("text")).where("text is not null")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = [_block(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, id_col, text_col) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    rows = asked.collect()  # of about BLOCK_CHARS characters
    index, kinds, bounds = terms(pa.array([r["text"] for r in rows], pa.large_string()))
    if not len(kinds):
        return None
    wanted: dict[int | None, set[int]] = {}
    for r, a, b in zip(rows, bounds, bounds[1:], strict=False):
        wanted.setdefault(r["item_id"], set()).update(index[a:b].tolist())
    items = [(item, np.array(sorted(own), np.int64)) for item, own in wanted.items() if own]
    vocabulary = kinds.cast(pa.large_binary())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    postings = written(texts.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms binary, tfs binary"), "postings")
    documents, all_terms = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(kinds), np.int64)
    for r in postings.select("terms").mapInArrow(_holding, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms
        holding[r["term"]] = r["df"]
    weights = np.array([weight(documents, h) for h in holding.tolist()], np.int64)
    near = postings.where("length(terms) > 0").mapInArrow(_search(items, weights, documents, all_terms, k), "item_id long, doc_id long, score long")
    # a task sends k rows per item: two rounds of ranking, so that many tasks do not all meet in one
    parts = max(1, math.isqrt(documents // 20_000))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    if parts > 1:
        some = Window.partitionBy("item_id", "part").orderBy(*best)
        near = near.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best)).cast("int")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
