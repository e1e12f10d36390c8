"""Language of texts and of the spans of mixed texts (operator 13).

A text is read as pieces: runs between white space, cut where the script changes and every LONGEST characters.
The script of a piece narrows the languages that it may be in to those that learned text writes in that script.
A piece scores for each of them by its character n-grams (hashed, with word bounds; multinomial counts over all
learned text). Viterbi's algorithm finds the best sequence of languages over the pieces, where each change of
language costs SWITCH; so short foreign words do not part a span, and longer passages do. The text's
language is the one that most of its letters are labelled with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.columns import binary_buffers, distinct_values, slices, text_buffers
from postlens.llm.quality import held_out
from postlens.llm.sums import SCHEMA, blocks, matrix_sum
from postlens.llm.worker import trim

LONGEST, ORDERS, SWITCH, BARRED = 32, (1, 2, 3, 4), 8.0, -1e6
#: A language is a candidate for a script that holds this share of its learned letters.
WRITES = 0.01
#: Bytes of the table of n-gram scores; with many languages its n-grams share fewer buckets.
MODEL_BYTES = 16 << 20
UNDECIDED = "und"

# First code point of Unicode blocks of letters, by script; "" ends a range.
SCRIPTS = [
    (0x0041, "Latin"), (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""),
    (0x0750, "Arabic"), (0x0780, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1780, "Khmer"),
    (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""),
    (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x32000, ""),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = ["", *dict.fromkeys(n for _, n in SCRIPTS if n)]
_NUMBERS = np.array([0] + [SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.int8)


class Pieces:
    """The pieces of a column of texts, and the distinct ones."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8 count as replacement characters
            column = pa.array([x.decode("utf-8", "replace") if x is not None else None for x in column.cast(pa.large_binary()).to_pylist()], pa.large_string())
            data, offsets = text_buffers(column)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        inner = np.flatnonzero((data & 0xC0) == 0x80)
        self.rows = offsets - np.searchsorted(inner, offsets)  # where each text begins, in characters
        used = np.flatnonzero(np.bincount(chars, minlength=1))
        is_letter = np.array([chr(c).isalpha() for c in used.tolist()], bool)
        kinds_of = np.zeros(used[-1] + 1 if len(used) else 1, np.int8)  # 0: no letter, else the number of its script and 1
        kinds_of[used] = np.where(is_letter, _NUMBERS[np.searchsorted(_STARTS, used, "right")] + 1, 0)
        kind = kinds_of[chars]
        letter = kind > 0
        solid = ~((chars == 32) | (chars >= 9) & (chars <= 13))
        edge = np.zeros(len(chars) + 1, bool)
        edge[self.rows] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        turn = np.zeros(len(chars), bool)
        turn[1:] = letter[1:] & letter[:-1] & (kind[1:] != kind[:-1])
        first |= turn & solid
        start = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= first[1:] | ~solid[1:]
        end = np.flatnonzero(last) + 1
        if len(start) and (end - start).max() > LONGEST:
            times = -(-(end - start) // LONGEST)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, end = np.repeat(start, times) + nth * LONGEST, np.repeat(end, times)
            end = np.minimum(end, start + LONGEST)
        self.start, self.end = start, end
        self.bounds = np.searchsorted(start, self.rows)  # of each text among the pieces
        keep = np.zeros(len(chars) + 1, np.int8)
        keep[start] += 1  # no place begins, or ends, two pieces
        keep[end] -= 1
        packed = chars[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
        self.index, kinds = distinct_values(packed.view(np.uint8), np.concatenate([[0], np.cumsum(end - start)]) * 4)
        n = len(kinds)
        one = np.zeros(n, np.int64)
        one[self.index] = np.arange(len(self.index))  # some place where the distinct piece stands
        at = np.flatnonzero(letter)
        first, last = np.searchsorted(at, start[one]), np.searchsorted(at, end[one])
        self.letters = last - first
        self.script = np.where(self.letters > 0, kind[np.append(at, 0)[first]] - 1, 0) if n else np.zeros(0, np.int8)
        # the distinct pieces, a blank before and behind each
        flat, ends = binary_buffers(kinds)
        size = np.diff(ends) // 4
        self.text = np.full(int(size.sum()) + n + 1, 32, np.uint32)
        self.text[np.arange(size.sum()) + np.repeat(np.arange(1, n + 1), size)] = flat[ends[0]:ends[-1]].view(np.uint32) if n else 0

    def grams(self, bits: int):
        """(bucket, distinct piece) of each n-gram of the lower-cased distinct pieces with a blank on either side, order by order."""
        c = np.frombuffer(self.text.tobytes().decode("utf-32-le").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
        blank = c == 32
        piece = np.cumsum(blank) - 1
        value, inner = np.zeros(len(c), np.uint64), np.zeros(len(c), bool)
        for n in range(1, max(ORDERS) + 1):
            m = len(c) - n + 1
            if m <= 0:
                return
            value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:]
            if n > 2:
                inner = inner[:m] | blank[n - 2:n - 2 + m]
            if n in ORDERS:
                ok = np.flatnonzero(~inner[:m] if n > 1 else ~blank)
                mixed = (value[ok] ^ (value[ok] >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed >> np.uint64(64 - bits)).astype(np.int64), piece[ok]


def _bits(languages: int) -> int:
    return int(np.clip(np.floor(np.log2(MODEL_BYTES / 4 / max(1, languages))), 8, 16))


class Model:
    """Languages, log scores of n-gram buckets [languages, buckets], and the candidates of each script [scripts, languages]."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        total = counts.sum(0) + 0.5 * len(counts)
        self.bits = int(np.log2(len(counts)))
        self.scores = np.ascontiguousarray((np.log((counts + 0.5) / total) / len(ORDERS)).T, np.float32)
        able = letters >= WRITES * np.maximum(1, letters.sum(0))
        able[~able.any(1)] = True
        able[0] = True
        self.able = able

    def judge(self, pieces: Pieces) -> np.ndarray:
        """float64 [distinct pieces, languages]; pieces without letters score 0 for all."""
        n, k = len(pieces.letters), len(self.languages)
        out = np.zeros((n, k))
        for bucket, piece in pieces.grams(self.bits):
            for j in range(k):
                out[:, j] += np.bincount(piece, self.scores[j][bucket], n)[:n]
        out[~self.able[pieces.script]] += BARRED
        out[pieces.letters == 0] = 0
        return out


def viterbi(score: np.ndarray, bounds: np.ndarray, switch: float, block: int = 64) -> np.ndarray:
    """The best label of each piece [pieces], text by text, where a change of label costs ``switch``.

    Texts are cut into blocks of pieces. The best score from any label before a block to any label at its end is found
    for all blocks at once; a text's blocks are then joined in order, and read back all at once.
    """
    k, length = score.shape[1], np.diff(bounds)
    texts = np.flatnonzero(length)
    if not len(texts):
        return np.zeros(0, np.int64)
    many = -(-length[texts] // block)
    first = np.cumsum(many) - many  # first block of each text
    nth = np.arange(many.sum()) - np.repeat(first, many)
    start = np.repeat(bounds[texts], many) + nth * block
    size = np.minimum(block, np.repeat(bounds[texts + 1], many) - start)
    steps = int(size.max())
    at = start[:, None] + np.arange(steps)
    inside = np.arange(steps) < size[:, None]
    e = np.where(inside[:, :, None], score[np.minimum(at, len(score) - 1)], 0.0)
    stay = np.where(np.eye(k, dtype=bool), 0.0, -switch)
    through = stay + e[:, 0, None, :]  # best score of each block from the label before it to the label at its end
    for t in range(1, steps):
        through = np.maximum(through, through.max(2, keepdims=True) - switch) + e[:, t, None, :]
    before, state, entry = np.zeros((len(start), k)), np.zeros(len(start), np.int64), np.zeros((len(start), k), np.int64)
    order = np.argsort(-many, kind="stable")
    reach = [order[:np.searchsorted(-many[order], -j, "left")] for j in range(int(many.max()))]  # texts with a block j
    for j, own in enumerate(reach):
        at_j = first[own] + j
        both = before[at_j][:, :, None] + through[at_j]
        entry[at_j], best = both.argmax(1), both.max(1)
        more = many[own] > j + 1
        before[at_j[more] + 1] = best[more]
        state[at_j[~more]] = best[~more].argmax(1)
    known = np.zeros((len(start), k))
    for j in range(len(reach) - 1, 0, -1):
        at_j = first[reach[j]] + j
        state[at_j - 1] = entry[at_j, state[at_j]]
        known[at_j] = np.where(np.arange(k) == state[at_j - 1][:, None], 0.0, -np.inf)
    # within each block, from the label known to stand before it to the one at its end
    y, best, turned = known, np.zeros((steps, len(start)), np.int64), np.zeros((steps, len(start), k), bool)
    for t in range(steps):
        best[t] = y.argmax(1)
        top = y.max(1, keepdims=True) - switch
        turned[t] = top > y
        y = np.maximum(y, top) + e[:, t]
    label = np.zeros((len(start), steps), np.int64)
    rows = np.arange(len(start))
    for t in range(steps - 1, -1, -1):
        label[:, t] = state
        state = np.where(turned[t, rows, state], best[t], state)
    out = np.zeros(len(score), np.int64)
    out[at[inside]] = label[inside]
    return out


def _parts(column: pa.Array, languages: int):
    """Row ranges of bounded text and number of rows."""
    for a, b in slices(column, max(1 << 18, (8 << 20) // max(2, languages))):
        for i in range(a, b, 2000):
            yield i, min(b, i + 2000)


def learn(docs: DataFrame, *, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of all rows outside the held-out fold with a text and a language; None without any."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"), folds, fold)).select("text", "lang")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # the labels
    if not languages:
        return None
    k, bits = len(languages), _bits(len(languages))
    buckets, scripts = 1 << bits, len(SCRIPT_NAMES)

    def count(batches):
        total = np.zeros((buckets + scripts, k))
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = np.array([number[x] for x in batch["lang"].to_pylist()], np.int64)
            for a, b in _parts(batch["text"], k):
                p = Pieces(batch["text"].slice(a, b - a))
                n = len(p.letters)
                own = np.repeat(lang[a:b], np.diff(p.bounds)) * n + p.index
                times = np.bincount(own, minlength=k * n).reshape(k, n) * (p.letters > 0)
                for bucket, piece in p.grams(bits):
                    for j in range(k):
                        total[:buckets, j] += np.bincount(bucket, times[j, piece], buckets)
                for j in range(k):
                    total[buckets:, j] += np.bincount(p.script, times[j] * p.letters, scripts)
            trim()
        yield from blocks(total, 4096)

    total = matrix_sum(rows.mapInArrow(count, SCHEMA), (buckets + scripts, k), 4096)
    return Model(languages, total[:buckets], total[buckets:])


def label(docs: DataFrame, model: Model | None, *, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans of every row.

    ``score`` is the share of the text's letters that are labelled lang_pred (of equally many letters, the first
    language in order counts); ``spans`` lists language:start:end of maximal runs of one label, in code points, comma-joined.
    Null texts, those without a letter, and all texts without a model are UNDECIDED, with score 0 and no span.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit("").alias("spans"))

    def run(batches):
        names = model.languages
        k = len(names)
        for batch in batches:
            for a, b in _parts(batch["text"], k):
                p = Pieces(batch["text"].slice(a, b - a))
                n = b - a
                labels = viterbi(model.judge(p)[p.index], p.bounds, switch)
                row = np.repeat(np.arange(n), np.diff(p.bounds))
                letters = np.bincount(row * k + labels, p.letters[p.index] if len(p.index) else None, n * k).reshape(n, k)
                total, pred = letters.sum(1), letters.argmax(1)
                first = np.ones(len(labels), bool)
                first[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(first)
                stop = p.end[np.append(at[1:], len(labels)) - 1] if len(at) else at
                spans: list[list[str]] = [[] for _ in range(n)]
                for r, j, s, e in zip(row[at].tolist(), labels[at].tolist(), (p.start[at] - p.rows[row[at]]).tolist(), (stop - p.rows[row[at]]).tolist(), strict=True):
                    if total[r]:
                        spans[r].append(f"{names[j]}:{s}:{e}")
                said = [names[j] if t else UNDECIDED for j, t in zip(pred.tolist(), total.tolist(), strict=True)]
                score = letters.max(1) / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, n), pa.array(said, pa.string()), pa.array(score), pa.array([",".join(s) for s in spans], pa.string())], ["doc_id", "lang_pred", "score", "spans"])
            trim()

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans string")


def languages(docs: DataFrame, *, folds: int = 4, fold: int = 2, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every row; learned from rows outside the held-out fold (see :func:`label`).

    Repeated rows are each learned from and labelled; rows with a null id are outside the fold unless the empty
    text's remainder says otherwise; an empty table gives an empty table.
    """
    model = learn(docs, folds=folds, fold=fold, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = label(docs, model, switch=switch, id_col=id_col, text_col=text_col)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "spans")
