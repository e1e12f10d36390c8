"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6).

One pass turns every whole text into a few dozen statistics. The trees are fitted on a bounded
sample of labelled rows (``most_rows``), flattened into arrays, and traversed for
whole batches at once: one gather per level for all rows and trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.columns import distinct_values, distinct_words, row_starts, slices, text_buffers, word_spans
from postlens.llm.files import written

_CLASSES = {
    "space": [9, 10, 11, 12, 13, 32], "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
    "stop": b".!?", "comma": b",;:", "bang": b"!", "bar": b"|", "odd": b"#$%&*@^~<>{}[]\\_=+/`", "quote": b"\"'()-",
    "vowel": b"aeiouAEIOU", "high": range(128, 256),
}
FEATURES = [
    "log_chars", "log_words", "word_len", "word_len_sd", "word_len_max", *[f"{k}_share" for k in _CLASSES], "entropy", "line_len", "log_lines",
    "distinct_words", "top_word", "distinct_lines", "caps_words", "title_words", "stop_lines", "words_per_stop", "word_tail_odd",
]


def _grouped(values: np.ndarray, bounds: np.ndarray, how=np.add) -> np.ndarray:
    """``how.reduceat`` per row of ``bounds``; 0 for empty rows."""
    out = np.zeros(len(bounds) - 1, float)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = how.reduceat(values, bounds[:-1][full])
    return out


def _variety(row: np.ndarray, index: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct values, and the count of the most frequent one."""
    pairs, count = np.unique(row.astype(np.int64) * size + index, return_counts=True)
    own = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) * size)
    return np.diff(own).astype(float), _grouped(count, own, np.maximum)


def statistics(column: pa.Array) -> np.ndarray:
    """float32 [rows, FEATURES] of whole texts; empty and null texts give zeros."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    hist = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(size, 1)
    shares = [hist[:, list(c)].sum(1) / total for c in _CLASSES.values()]
    p = hist / total[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    starts, ends, words = word_spans(data, offsets)
    n_words = np.diff(words).astype(float)
    some = np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    mean = _grouped(length, words) / some
    spread = np.sqrt(np.maximum(_grouped(length * length, words) / some - mean * mean, 0))
    index, kinds = distinct_words(data, starts, ends)
    distinct, top = _variety(np.repeat(np.arange(n), np.diff(words)), index, n, max(1, len(kinds)))
    first, second, last = data[starts], data[np.minimum(starts + 1, ends - 1)], data[ends - 1]
    up = (first >= 65) & (first <= 90)
    caps = up & (second >= 65) & (second <= 90) & (ends - starts > 1)
    odd_tail = np.isin(last, list(_CLASSES["odd"]) + [33])
    stops = np.isin(last, list(_CLASSES["stop"]))
    cut = row_starts(len(data), offsets)
    breaks = np.flatnonzero(data == 10) + 1
    cut[breaks] = True
    line_at = np.flatnonzero(cut[:-1])
    lines = np.searchsorted(line_at, offsets)
    n_lines = np.maximum(np.diff(lines), 1)
    line_index, line_kinds = distinct_values(data, np.append(line_at, len(data)))
    kinds_of_line, _ = _variety(np.repeat(np.arange(n), np.diff(lines)), line_index, n, max(1, len(line_kinds)))
    line_end = np.append(line_at, len(data))[1:] - 1
    tail = data[np.where((line_end > 0) & (data[line_end] == 10), line_end - 1, line_end)] if len(data) else data
    good_end = _grouped(np.isin(tail, list(b".!?\"')")), lines) if len(data) else np.zeros(n)
    chars = size - hist[:, 128:192].sum(1)
    columns = [
        np.log1p(chars), np.log1p(n_words), mean, spread, _grouped(length, words, np.maximum), *shares, entropy, chars / n_lines, np.log1p(n_lines),
        distinct / some, top / some, kinds_of_line / n_lines, _grouped(caps, words) / some, _grouped(up, words) / some, good_end / n_lines,
        n_words / (1 + _grouped(stops, words)), _grouped(odd_tail, words) / some,
    ]
    out = np.stack(columns, 1).astype(np.float32)
    out[size == 0] = 0
    return out


class Trees:
    """Boosted trees on the logistic loss, flattened: trees x nodes of a complete binary tree."""

    def __init__(self, depth: int = 4, rounds: int = 80, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: int = 10):
        self.depth, self.rounds, self.rate, self.bins, self.penalty, self.least = depth, rounds, rate, bins, penalty, least
        self.base = 0.0
        inner = (1 << depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((0, inner), np.int32), np.zeros((0, inner), np.float32), np.zeros((0, 1 << depth), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Without rows the score is 1/2; with one class it is that class's smoothed share."""
        if not len(y):
            return self
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        margin = np.full(len(y), self.base)
        features, cuts, leaves = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            feature, cut, leaf, node = self._tree(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6))
            margin += leaf[node]
            features.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.stack(features), np.stack(cuts), np.stack(leaves)
        return self

    def _tree(self, binned, edges, g, h):
        n, m = binned.shape
        node = np.zeros(n, np.int64)
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        for level in range(self.depth):
            wide, first = 1 << level, (1 << level) - 1
            best, chosen = np.zeros(wide), np.full((wide, 2), -1)
            for f in range(m):
                key = node * self.bins + binned[:, f]
                gs, hs, cs = (np.cumsum(np.bincount(key, w, wide * self.bins).reshape(wide, self.bins), 1) for w in (g, h, None))
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                ga, ha, ca = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gl**2 / (hl + self.penalty) + (ga - gl) ** 2 / (ha - hl + self.penalty) - ga**2 / (ha + self.penalty)
                gain[(cl < self.least) | (ca - cl < self.least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(wide), at]
                better = (top > best + 1e-9) & (at < len(edges[f]))
                best[better], chosen[better, 0], chosen[better, 1] = top[better], f, at[better]
            for k in np.flatnonzero(chosen[:, 0] >= 0):
                feature[first + k], cut[first + k] = chosen[k, 0], edges[chosen[k, 0]][chosen[k, 1]]
            f = np.maximum(chosen[node, 0], 0)
            right = (chosen[node, 0] >= 0) & (binned[np.arange(n), f] > chosen[node, 1])
            node = node * 2 + right
        gs, hs = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
        return feature, cut, (-self.rate * gs / (hs + self.penalty)).astype(np.float32), node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, trees = len(x), len(self.leaf)
        if not trees:
            return np.full(n, 1 / (1 + np.exp(-self.base)))
        node, tree, row = np.zeros((n, trees), np.int64), np.arange(trees), np.arange(n)[:, None]
        for level in range(self.depth):
            at = node + ((1 << level) - 1)
            node = node * 2 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node].sum(1, dtype=float))))


def held_out(id_column, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as its empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, y) of rows outside the held-out fold; null labels are left out, repeated ones count as the largest."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return own.where(~held_out(F.col("doc_id"), folds, fold))


def quality_scores(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, folds: int = 4, fold: int = 2, threshold: float = 0.7,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; score uses the text alone.

    Fitted on at most ``most_rows`` labelled rows outside the held-out fold (those with the smallest hash of the id).
    Null and empty texts have statistics of 0 and are scored like any other; repeated rows are each
    scored; without labels every score is 1/2; an empty table gives an empty table.
    """
    k = len(FEATURES)

    def measure(batches):
        for batch in batches:
            for a, b in slices(batch["text"], 6 << 20):
                x = statistics(batch["text"].slice(a, b - a))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, k, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), flat], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = written(rows.mapInArrow(measure, "doc_id long, x array<float>"), "statistics")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = written(labelled(labels, label_col, folds, fold).join(measured.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(most_rows), "chosen")
    # most_rows ids at most; of rows that share an id one is learned from
    sample = measured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy(*order).select("x", "y").toPandas()
    x = np.stack(sample["x"].to_list()).astype(np.float32) if len(sample) else np.zeros((0, k), np.float32)
    model = Trees().fit(x, sample["y"].to_numpy(float))

    def apply(batches):
        for batch in batches:
            flat = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(flat))], ["doc_id", "score"])

    scored = measured.mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
