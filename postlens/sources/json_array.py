"""JSON files of one large array, read by many tasks.

Spark's text reader deals byte ranges of a file; with ``}`` as the end of a line its rows are short, and no row is cut
by a range. Whether a range begins inside a string, and how deep, is not known to the task that reads it. So a first
pass sums every range up for both cases: quotes open at its end, brackets that it closes of those before it, brackets that it
leaves open. Composed in order (a row per range) they tell where each range begins, and the second pass cuts
the records out; one that runs over ranges is glued from its pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def brackets(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Positions of the brackets outside strings, and whether the text ends inside one; ``inside``: it begins so."""
    quote = np.flatnonzero(data == 34)
    if len(quote):
        plain = data != 92
        last = np.maximum.accumulate(np.where(plain, np.arange(len(data)), -1))
        before = np.where(quote > 0, last[np.maximum(quote - 1, 0)], -1)
        quote = quote[(quote - 1 - before) % 2 == 0]  # after an even number of backslashes
    at = np.flatnonzero(_STEP[data] != 0)
    turns = np.searchsorted(quote, at) + inside
    return at[turns % 2 == 0], bool((len(quote) + inside) % 2)


def _names_key(data: bytes, at: int, key: re.Pattern) -> bool:
    return key.search(data, max(0, at - 256), at) is not None


def _key_pattern(key: str) -> re.Pattern:
    return re.compile(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*$')


class _Summary:
    """What a text does to the stack of open brackets: how many it closes, and which it opens and leaves open.

    ``[`` after the key is written ``k``. ``least``: the lowest depth, against the beginning, at which one is opened.
    ``first`` is the first bracket.
    """

    def __init__(self, inside: bool):
        self.inside, self.closes, self.opens, self.least, self.first = inside, 0, "", 1 << 30, ""

    def add(self, data: bytes, key: re.Pattern) -> None:
        raw = np.frombuffer(data, np.uint8)
        at, self.inside = brackets(raw, self.inside)
        if not len(at):
            return
        step = _STEP[raw[at]]
        self.first = self.first or chr(raw[at[0]])
        depth = np.cumsum(step)
        below = np.append(np.minimum.accumulate(depth[::-1])[::-1][1:], 1 << 30)
        kept = at[(step > 0) & (depth <= below)]
        here = len(self.opens) - self.closes
        for i in np.flatnonzero(raw[at] == 91).tolist():
            if here + depth[i] - 1 < self.least and _names_key(data, int(at[i]), key):
                self.least = here + int(depth[i]) - 1
        opened = "".join("k" if data[i:i + 1] == b"[" and _names_key(data, i, key) else chr(data[i]) for i in kept.tolist())
        closed = max(0, -int(depth.min()))
        self.closes += max(0, closed - len(self.opens))
        self.opens = self.opens[:max(0, len(self.opens) - closed)] + opened


def _texts(batches):
    """(file, block, text) of each run of rows of one range, line ends put back."""
    for batch in batches:
        file, block = batch["file"].to_pylist(), batch["block"].to_numpy()
        cuts = [i for i in range(len(file)) if not i or file[i] != file[i - 1] or block[i] != block[i - 1]] + [len(file)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield file[a], int(block[a]), b"".join(x.encode() + b"}" for x in batch["value"].slice(a, b - a).to_pylist())


def _sum_up(key: str):
    names = ["file", "block", "state", "inside", "closes", "opens", "least", "first"]

    def run(batches):
        pattern, here, own = _key_pattern(key), None, []

        def done():
            rows = [(*here, bool(s), x.inside, x.closes, x.opens, x.least, x.first) for s, x in enumerate(own)]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for file, block, text in _texts(batches):
            if (file, block) != here:
                if here is not None:
                    yield done()
                here, own = (file, block), [_Summary(False), _Summary(True)]
            for x in own:
                x.add(text, pattern)
        if here is not None:
            yield done()

    return run


def _begins(rows: list) -> tuple[dict, dict]:
    """(file, block) -> (inside a string, stack) where each range begins, and file -> its records' depth."""
    ranges: dict[tuple, dict] = {}
    for r in rows:
        ranges.setdefault((r["file"], r["block"]), {})[r["state"]] = r
    begins, depth, inside, stack, file = {}, {}, False, "", None
    for at in sorted(ranges):
        if at[0] != file:
            file, inside, stack = at[0], False, ""
            depth[file] = 1 if ranges[at][False]["first"] == "[" else 0
        begins[at] = inside, stack
        r = ranges[at][inside]
        if not depth[file] and len(stack) + r["least"] == 1:  # the key's array stands in the top object
            depth[file] = 2
        stack = stack[:max(0, len(stack) - r["closes"])] + r["opens"]
        inside = r["inside"]
    return begins, depth


class _Cutter:
    """Records of one range, whole or the piece of one that it holds."""

    def __init__(self, inside: bool, stack: str, level: int):
        self.inside, self.stack, self.level = inside, stack, level
        self.open = self._within(stack) and stack[level:level + 1] == "{"
        self.kind, self.part = ("h", []) if self.open else ("t", [])

    def _within(self, stack: str) -> bool:
        """Whether records stand right here, or around us."""
        return stack[:self.level] == ("", "[", "{k")[self.level]

    def add(self, data: bytes, key: re.Pattern):
        """(kind, text) of what ends here: "r" a record, "h" the end of one that began before."""
        raw = np.frombuffer(data, np.uint8)
        at, self.inside = brackets(raw, self.inside)
        begin = 0
        if len(at):
            depth = len(self.stack) + np.cumsum(_STEP[raw[at]])
            # only brackets that open or close a record, or what records stand in, are looked at one by one
            look = np.flatnonzero((depth <= self.level) | (depth == self.level + 1) & (_STEP[raw[at]] > 0))
            for i in look.tolist():
                p, up = int(at[i]), _STEP[raw[at[i]]] > 0
                if not up:
                    if self.open and depth[i] == self.level:
                        yield (self.kind if self.kind == "h" else "r"), b"".join([*self.part, data[begin:p + 1]])
                        self.open, self.kind, self.part = False, "t", []
                    self.stack = self.stack[:max(0, int(depth[i]))]
                elif depth[i] == self.level + 1:
                    if raw[p] == 123 and self._within(self.stack) and not self.open:
                        self.open, begin = True, p
                else:
                    mark = "k" if raw[p] == 91 and _names_key(data, p, key) else chr(raw[p])
                    self.stack = self.stack[:int(depth[i]) - 1] + mark
            end = int(depth[-1])
            self.stack = self.stack[:self.level] + "?" * max(0, end - self.level) if end > len(self.stack[:self.level]) else self.stack[:max(0, end)]
        if self.open:
            self.part.append(data[begin:])


def _cut(key: str, begins: dict, depth: dict):
    names = ["file", "block", "seq", "kind", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        pattern, here, cutter, rows, seq = _key_pattern(key), None, None, [], 0

        def sent():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        def left():
            return [(*here, seq, "t" if cutter.kind == "t" else "m", b"".join(cutter.part).decode())] if cutter is not None and cutter.open else []

        for file, block, text in _texts(batches):
            if (file, block) != here:
                rows += left()
                here, cutter, seq = (file, block), _Cutter(*begins[file, block], depth[file]), 0
            for kind, own in cutter.add(text, pattern):
                rows.append((file, block, seq, kind, own.decode()))
                seq += 1
            if len(rows) >= 2000:
                yield sent()
                rows = []
        rows += left()
        yield sent()

    return run


def json_records(spark: SparkSession, path: str, key: str = "jobs") -> DataFrame:
    """(file, block, seq, text): the objects of the array under ``key`` of a top object, of a top array, or top objects themselves.

    ``block`` and ``seq`` give the order in the file. A file may be as large as it likes; only a record has to fit
    into a row. Elements that are no objects are left out.
    """
    lines = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = lines.mapInArrow(_sum_up(key), "file string, block long, state boolean, inside boolean, closes long, opens string, least long, first string").collect()  # two rows per range
    if not found:
        return spark.createDataFrame([], "file string, block long, seq long, text string")
    rows = lines.mapInArrow(_cut(key, *_begins(found)), "file string, block long, seq long, kind string, text string")
    whole = rows.where("kind = 'r'").select("file", "block", "seq", "text")
    # a record over several ranges: its beginning "t", what lies between "m", and its end "h"
    piece = rows.where("kind <> 'r'").withColumn("nth", F.when(F.col("kind") == "t", 1).otherwise(0))
    before = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.struct("block", "seq")
    piece = piece.withColumn("record", F.last(F.when(F.col("kind") == "t", begun), ignorenulls=True).over(before))
    glued = piece.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "nth", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")
    return whole.union(glued.select("file", "record.block", "record.seq", text))
