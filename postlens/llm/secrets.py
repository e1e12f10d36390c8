"""Secret scan with dictionary-primed zstandard novelty (operator 1).

Three fixed kinds are found by pattern. The method adds strings that no pattern knows: a run of
16 or more value characters, letters with digits or of both cases, that follows a sensitive word
closely on its line (it begins within ``reach`` characters behind any such word; every such run
is measured, once). Its novelty is what it adds, per character, to the compressed size of the
text around it, under zstandard primed with a dictionary of the corpus's own
identifiers. What its surroundings or the identifiers can spell adds little; what
nothing predicts adds nearly a byte a character and is reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.columns import distinct_words, slices, text_buffers, word_spans

KINDS = ("assign", "access", "hex", "novel")
# fixed values: the base patterns
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# words that make what follows them sensitive
SENSITIVE = r"passw|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|signature|session[_-]?id|conn(?:ection)?[_-]?str"
_VALUE = r"[A-Za-z0-9+/_.=~-]{16,}"
_MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]")
_IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{3,47}")
_PIECE = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def identifier_dictionary(docs: DataFrame, text_col: str = "text", most_bytes: int = 32 << 10) -> bytes:
    """The corpus's most frequent identifiers (snake or camel case), the commonest last, in ``most_bytes`` at most.

    Every text is counted; each task sends its own sums. A repeated key is no identifier: its pieces are no words.
    """

    def count(batches):
        total: dict[bytes, int] = {}

        def sent():
            rows = pa.RecordBatch.from_arrays([pa.array([k.decode() for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            for a, b in slices(batch["text"], 8 << 20):
                data, offsets = text_buffers(batch["text"].slice(a, b - a))
                starts, ends, _ = word_spans(data, offsets)
                index, words = distinct_words(data, starts, ends)
                number = np.bincount(index, minlength=len(words)) if len(words) else np.zeros(0, int)
                shaped = pc.match_substring_regex(words, "_[a-z0-9]|[a-z][A-Z]").to_numpy(zero_copy_only=False) if len(words) else []
                for k in np.flatnonzero(shaped):
                    for name in _IDENTIFIER.findall(words[int(k)].as_py()):
                        if spelled(name):
                            total[name] = total.get(name, 0) + int(number[k])
                if len(total) > 200_000:
                    yield sent()
        yield sent()

    names = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    top = names.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most_bytes // 5).collect()
    out, size = [], 0
    for row in top:
        word = row["word"].encode()
        size += len(word) + 1
        if size > most_bytes:
            break
        out.append(word)
    return b"\n".join(out[::-1])


def spelled(name: bytes) -> bool:
    """Whether an identifier is put together from words: two pieces or more of three letters on average, few digits."""
    pieces = _PIECE.findall(name)
    letters = sum(map(len, pieces))
    return len(pieces) > 1 and letters >= 3 * len(pieces) and sum(48 <= c < 58 for c in name) <= 3


class Scanner:
    """Spans of whole texts. ``threshold``: marginal compressed bytes per character from which a string is reported."""

    def __init__(self, dictionary: bytes, threshold: float = 0.62, around: int = 256, reach: int = 48):
        import zstandard

        self.assign, self.access, self.hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
        self.sensitive = re.compile(rf"(?=({SENSITIVE}))", re.I | re.A)  # words may share letters
        # runs beside an "@" are parts of addresses, but for the password of "user:password@host"
        self.value = re.compile(rf"(?<![A-Za-z0-9+/_.=~@-]){_VALUE}(?![A-Za-z0-9+/_.=~@-])|(?<=:){_VALUE}(?=@)")
        self.threshold, self.around, self.reach = threshold, around, reach
        primer = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False)

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes per character of text[start:end] against its surroundings."""
        near = text[max(0, start - self.around):start] + "\n" + text[end:end + self.around]
        alone = len(self.compressor.compress(near.encode()))
        return (len(self.compressor.compress((near + "\n" + text[start:end]).encode())) - alone) / (end - start)

    def candidates(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of each value run that begins within reach of a sensitive word before it on its line."""
        ends = sorted(m.end(1) for m in self.sensitive.finditer(text))
        for m in self.value.finditer(text, ends[0]) if ends else ():
            a, b = m.span()
            word = ends[bisect_right(ends, a) - 1]  # the nearest: if it is too far, all are
            if a - word <= self.reach and "\n" not in text[word:a]:
                yield a, b

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), sorted."""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        base = list(found)
        for a, b in self.candidates(text):
            value = text[a:b]
            if _MIXED.search(value) and not any(s < b and a < e for s, _, e in base) and self.novelty(text, a, b) >= self.threshold:
                found.append((a, 3, b))
        return sorted(found)


def _suspect(texts: pa.Array) -> np.ndarray:
    """Rows that may hold a span: one linear scan per pattern, for the whole batch."""
    texts = texts.fill_null("")
    out = np.zeros(len(texts), bool)
    for pattern, loose in (("passw|passphrase|secret|token|key|credential|bearer|authorization|signature|session|conn", True), (ACCESS, False), (HEX, False)):
        out |= pc.match_substring_regex(texts, pattern, ignore_case=loose).to_numpy(zero_copy_only=False)
    return out


def scan(docs: DataFrame, *, threshold: float = 0.62, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans array<struct<kind, start, end, value>>`` (code points, end exclusive) of every whole text.

    Null and empty texts have no spans; repeated rows are each scanned; an empty table gives an empty table.
    """
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string>>"

    def rows(keys, texts, found):
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in f] for t, f in zip(texts, found, strict=True)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        return pa.RecordBatch.from_arrays([keys, pa.array(spans, kind)], ["doc_id", "spans"])

    return _scanned(docs, threshold, id_col, text_col, rows, schema)


def scan_digest(docs: DataFrame, *, threshold: float = 0.62, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts per kind, a hash of the base spans, and all spans as text."""

    def rows(keys, texts, found):
        said = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in f] for f in found]
        base = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in f if k < 3) for f in found]
        number = [[sum(k == x for _, k, _ in f) for f in found] for x in range(4)]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in base]
        columns = [keys, *(pa.array(x, pa.int64()) for x in number[:3]), pa.array(sha), pa.array([",".join(x) for x in said]), pa.array(number[3], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return _scanned(docs, threshold, id_col, text_col, rows, _DIGEST)


def _scanned(docs, threshold, id_col, text_col, rows, schema):
    dictionary = identifier_dictionary(docs, text_col)

    def run(batches):
        scanner = Scanner(dictionary, threshold)
        for batch in batches:
            keys, texts = batch["doc_id"], batch["text"]
            suspect = _suspect(texts)
            own = [""] * len(texts)
            for k in np.flatnonzero(suspect).tolist():
                own[k] = texts[k].as_py()
            yield rows(keys, own, [scanner.spans(t) if t else [] for t in own])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
