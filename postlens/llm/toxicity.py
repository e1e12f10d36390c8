"""Toxicity: support vector machine on a gapped subsequence kernel with Nystroem landmarks (operator 5).

Two words are as similar as the weighted triples of letters that they share in order,
each occurrence weighing DECAY per character that it spans, up to SPAN characters; a
character that is no letter is a gap. So "i.d.i.o.t" or "idiiot" is near "idiot". The
kernel values of a word against a few landmark words (chosen from the labelled
sample), whitened with the landmarks' own kernel matrix (Nystroem), go to a linear
SVM. A sentence is judged by its worst word, a text by its worst sentence.

Labels are of whole texts, so training is by bags: it starts with the words near a landmark
that only toxic texts hold, and then repeatedly takes the worst word of each
toxic text; every word of a clean text is a negative.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.columns import LOWER, distinct_words, slices, text_buffers, word_spans
from postlens.llm.files import written
from postlens.llm.quality import held_out, labelled
from postlens.llm.worker import kept, trim

SPAN, DECAY, LONGEST, ACTIVE = 6, 0.7, 32, 0.35
#: Words whose kernel values are found at once, and bytes of text that are scored at once.
CHUNK, PART = 10_000, 1 << 20
_LETTERS = "abcdefghijklmnopqrstuvwxyzáàâäçéèêëíìîïñóòôöúùûüß"
_PARTED = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")
_BASE = len(_LETTERS) + 1
_CLASS = np.zeros(0x250, np.uint8)
for _i, _c in enumerate(_LETTERS):
    _CLASS[ord(_c)] = _i + 1
    if len(_c.upper()) == 1:
        _CLASS[ord(_c.upper())] = _i + 1
_SHAPES = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def letter_codes(words: list[str]) -> np.ndarray:
    """Letter classes [words, LONGEST], 0 for gaps and beyond the end."""
    points = np.array(words, f"U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST) if words else np.zeros((0, LONGEST), np.uint32)
    return _CLASS[np.minimum(points, 0x24F)]


def _triples(codes: np.ndarray):
    """For each shape: weight of an occurrence, keys [words, places] (0 where a gap takes part)."""
    for i, j in _SHAPES:
        n = codes.shape[1] - j
        if n <= 0:
            continue
        a, b, c = (codes[:, k:k + n].astype(np.int32) for k in (0, i, j))
        yield DECAY ** (j + 1), np.where((a > 0) & (b > 0) & (c > 0), (a * _BASE + b) * _BASE + c, 0)


class Landmarks:
    """Kernel values of words against landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.table, rows = np.zeros(_BASE**3, np.int32), [np.zeros(len(words))]
        for weight, keys in _triples(letter_codes(words)):
            for w, k in zip(*np.nonzero(keys), strict=True):
                key = keys[w, k]
                if not self.table[key]:
                    self.table[key] = len(rows)
                    rows.append(np.zeros(len(words)))
                rows[self.table[key]][w] += weight
        spectrum = np.stack(rows)
        self.spectrum = (spectrum / np.maximum(np.sqrt((spectrum**2).sum(0)), 1e-12)).astype(np.float32)

    def kernel(self, words: list[str]) -> np.ndarray:
        """float32 [words, landmarks], in 0..1 (about 1: the same)."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for i in range(0, len(order), CHUNK):
            rows = order[i:i + CHUNK]
            codes = letter_codes([words[k] for k in rows])
            own = codes[:, :max(1, int(((codes > 0) * np.arange(1, LONGEST + 1, dtype=np.uint8)).max()))]
            norm, sums = np.zeros(len(rows), np.float32), np.zeros((len(rows), len(self.words)), np.float32)
            for weight, keys in _triples(own):
                norm += np.float32(weight**2) * (keys > 0).sum(1)
                found = self.table[keys]
                for k in range(found.shape[1]):
                    hit = np.flatnonzero(found[:, k])
                    sums[hit] += np.float32(weight) * self.spectrum[found[hit, k]]
            out[rows] = sums / np.sqrt(np.maximum(norm, 1e-12))[:, None]
        return out


class Remembered:
    """Decision values of words met before: sorted 64-bit hashes, 16 bytes a word, at most ``most`` of them."""

    def __init__(self, most: int = 500_000):
        self.most, self.keys, self.values = most, np.zeros(0, np.uint64), np.zeros(0)

    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, nan where it is new."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.nan)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        room = self.most - len(self.keys)
        if room > 0 and len(keys):
            keys, first = np.unique(np.concatenate([self.keys, keys[:room]]), return_index=True)
            self.keys, self.values = keys, np.concatenate([self.values, values[:room]])[first]


def tokens(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word number of each occurrence, distinct lower-cased words, and row of each occurrence, rows in order.

    A run of three or more single characters between spaces is one word more; a word over LONGEST
    characters is also read in overlapping windows, so nothing of it is left out.
    """
    data, offsets = text_buffers(column)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    index, kinds = distinct_words(data, starts, ends)
    words = [w.decode("utf-8", "replace") for w in kinds.to_pylist()]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    extra: dict[str, int] = {}
    more_index, more_row = [], []

    def windows(text: str, first: int, r: int):
        for i in range(first, max(first + 1, len(text) - LONGEST // 2), LONGEST // 2):
            more_index.append(extra.setdefault(text[i:i + LONGEST], len(words) + len(extra)))
            more_row.append(r)

    single = np.array([len(w) <= 2 and len(w.strip(".,;:!?\"'()")) <= 1 for w in words], bool)[index] if len(index) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= 3:
            for r in np.unique(row[a:b]):
                windows("".join(words[index[k]] for k in range(a, b) if row[k] == r), 0, r)
    long = [i for i, w in enumerate(words) if len(w) > LONGEST]
    if long:
        for k in np.flatnonzero(np.isin(index, long)):
            windows(words[index[k]], LONGEST // 2, row[k])
    if more_index:
        index, row = np.concatenate([index, np.array(more_index, np.int64)]), np.concatenate([row, np.array(more_row, np.int64)])
        order = np.argsort(row, kind="stable")
        index, row = index[order], row[order]
    return index, words + list(extra), row


def _plain_words(text: str) -> set[str]:
    own = {w.strip(".,;:!?\"'()*-_") for w in text.lower().split()}
    return {w for w in own if 3 <= len(w) <= LONGEST}


def choose_landmarks(texts: pa.Array, toxic: np.ndarray, most: int) -> list[str]:
    """Words that mark toxic texts: each next one is in the most toxic texts that the earlier ones leave open, three times over."""
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int(toxic.sum()))
    in_toxic, in_clean = Counter(), Counter()
    for k in np.flatnonzero(toxic).tolist():
        in_toxic.update(_plain_words(texts[k].as_py()))
    in_toxic = {w: c for w, c in in_toxic.items() if c >= max(3, n1 // 400)}
    for k in np.flatnonzero(toxic == 0).tolist():
        in_clean.update(w for w in _plain_words(texts[k].as_py()) if w in in_toxic)
    good = {w for w, c in in_toxic.items() if (c + 0.5) / n1 >= 8 * (in_clean[w] + 0.5) / n0}
    has = [_plain_words(texts[k].as_py()) & good for k in np.flatnonzero(toxic).tolist()]
    covered, chosen = np.zeros(len(has), int), []
    while len(chosen) < most:
        count = Counter(w for s, c in zip(has, covered, strict=True) if c < 3 for w in s)
        for w in chosen:
            count.pop(w, None)
        if not count:
            break
        word = max(count, key=lambda w: (count[w], w))
        chosen.append(word)
        covered += [word in s for s in has]
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge SVM by Newton steps on the margin violators; y in -1, 1."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w, ridge = np.zeros(a.shape[1]), np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        open_ = y * (a @ w) < 1
        own = a[open_] * weight[open_, None]
        new = np.linalg.solve(ridge + 2 * c * own.T @ a[open_], 2 * c * own.T @ y[open_])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of y to the decision values (smoothed targets)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, a = np.array([1.0, 0.0]), np.stack([f, np.ones(len(f))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - t) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class Model:
    """Landmark words, and a decision that is linear in their kernel values."""

    def __init__(self, words: list[str], direction: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.direction, self.bias, self.slope, self.shift = Landmarks(words), direction, bias, slope, shift
        self.known = Remembered()

    def params(self) -> tuple:
        """What the constructor takes: a few numbers per landmark, small enough for a closure."""
        return self.landmarks.words, self.direction, self.bias, self.slope, self.shift

    def _judge(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for i in range(0, len(words), CHUNK):
            kernel = self.landmarks.kernel(words[i:i + CHUNK])
            out[i:i + CHUNK] = np.where(kernel.max(1, initial=0) >= ACTIVE, kernel @ self.direction + self.bias, self.bias)
        return out

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision value of each word, also read without what separates its letters; a bounded number of words is remembered."""
        keys = Remembered.hashes(words)
        out = self.known.look(keys)
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            own = [words[i] for i in new]
            out[new] = self._judge(own)
            parted = [k for k, w in enumerate(own) if _PARTED.search(w)]
            if parted:
                closed = self._judge(["".join(c for c in own[k] if c.isalpha())[:LONGEST] for k in parted])
                out[new[parted]] = np.maximum(out[new[parted]], closed)
            self.known.add(keys[new], out[new])
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability that each whole text is toxic."""
        f = np.full(len(column), self.bias)
        if self.landmarks.words:
            index, words, row = tokens(column)
            if len(index):
                head = np.flatnonzero(np.diff(row, prepend=-1))
                f[row[head]] = np.maximum(self.bias, np.maximum.reduceat(self.decide(words)[index], head))
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -30, 30)))


def train(texts: pa.Array | list[str], toxic: np.ndarray, most_landmarks: int = 48) -> Model:
    """Model of labelled texts; without both kinds of label, or without any telling word, a constant one.

    Texts stay in their Arrow buffers, and of their words only those near a landmark are held.
    """
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.25
    constant = Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    words = choose_landmarks(texts, toxic, most_landmarks) if len(texts) and 0 < toxic.sum() < len(toxic) else []
    if not words:
        return constant
    landmarks = Landmarks(words)
    gram = landmarks.kernel(words).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    number: dict[str, int] = {}
    rows, kinds, kernels = [], [], []
    for a, b in slices(texts, PART):
        index, own, row = tokens(texts.slice(a, b - a))
        some = landmarks.kernel(own)
        near = some.max(1, initial=0) >= ACTIVE
        place = np.full(len(own), -1)
        for k in np.flatnonzero(near).tolist():
            if own[k] not in number:
                kernels.append(some[k])
            place[k] = number.setdefault(own[k], len(number))
        at = np.flatnonzero(near[index]) if len(index) else np.zeros(0, np.int64)
        pair = np.unique((row[at] + a) * (1 << 40) + place[index[at]])
        rows.append(pair >> 40)
        kinds.append(pair & ((1 << 40) - 1))
    row, kind, n = np.concatenate(rows), np.concatenate(kinds), len(number)
    kernel = np.stack(kernels)
    x = kernel @ whiten
    in_toxic = np.bincount(kind[toxic[row] == 1], minlength=n)
    in_clean = np.bincount(kind[toxic[row] == 0], minlength=n)
    positive = (in_clean == 0) & (kernel.max(1) > 0.8) & (in_toxic > 0)
    for _ in range(4):
        use = positive | (in_clean > 0)
        y = np.where(positive[use], 1.0, -1.0)
        weight = np.where(y > 0, in_toxic[use], in_clean[use]).astype(float)
        weight[y > 0] *= weight[y < 0].sum() / max(1.0, weight[y > 0].sum()) * 0.25 if (y < 0).any() else 1.0
        w, b = _svm(np.vstack([x[use], np.zeros((1, x.shape[1]))]), np.append(y, -1.0), np.append(weight, max(1.0, weight.mean())))
        f = x @ w + b
        worst = np.full(len(texts), b)
        np.maximum.at(worst, row, f[kind])
        witness = np.zeros(n, bool)
        witness[kind[(toxic[row] == 1) & (f[kind] >= worst[row]) & (f[kind] > -0.5)]] = True
        positive = (in_clean * 20 < in_toxic) & (witness | (f > 0.5))
    slope, shift = _calibrate(worst, toxic.astype(float))
    return Model(words, whiten @ w, b, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, *, most_toxic: int = 1500, most_clean: int = 4500, most_chars: int = 64_000_000, folds: int = 5, fold: int = 0,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from a bounded sample of labelled rows outside the held-out fold.

    At most ``most_toxic`` toxic and ``most_clean`` other texts, those with the smallest hash of
    the id, as long as they come to ``most_chars`` characters together.
    """
    own = labelled(labels, label_col, folds, fold).select("y", F.col("doc_id").alias("_id"))
    kinds = [own.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    own = written(kinds[0].union(kinds[1]), "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = texts.withColumn("size", F.length("text")).join(F.broadcast(own), "_id")
    # the bound on characters is drawn over sizes alone; rows of one id and size stand or fall together
    sizes = texts.groupBy("_id", "size").agg(F.count("*").alias("times"))
    upto = F.sum(F.col("size") * F.col("times")).over(Window.orderBy(F.xxhash64("_id"), "_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    bounded = sizes.withColumn("upto", upto).where(F.col("upto") <= most_chars).select("_id", "size")
    rows = texts.join(F.broadcast(bounded), ["_id", "size"]).orderBy(F.xxhash64("_id"), "_id", "text").select("text", "y").toArrow()
    return train(rows["text"].cast(pa.large_string()).combine_chunks(), rows["y"].to_numpy().astype(int))


def _scorer(model: Model):
    params = model.params()
    key = ("toxicity", hash((tuple(params[0]), params[1].tobytes(), params[2:])))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        own = kept(key, lambda: Model(*params))
        scores = [own.score(text.slice(a, b - a)) for a, b in slices(text, PART)]
        trim()
        return pa.array(np.concatenate(scores or [np.zeros(0)]))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, folds: int = 5, fold: int = 0,
                    id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; score uses the whole text alone.

    Null and empty texts have no sentence and get the score of a text without any likeness; repeated rows are
    each scored; without labels of both kinds every score is the smoothed share of toxic rows (1/4 without
    any); an empty table gives an empty table.
    """
    score = _scorer(fit(docs, labels, folds=folds, fold=fold, id_col=id_col, text_col=text_col, **sample))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col).cast("string")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """``docs`` (all columns) without the rows that score ``threshold`` or more."""
    score = _scorer(fit(docs, labels, id_col=id_col, text_col=text_col, **sample))
    return docs.where(score(F.col(text_col).cast("string")) < threshold)
