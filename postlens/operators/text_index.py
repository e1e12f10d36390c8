"""Substring search by stored trigram lists (H1, H2): a query reads the lists of its trigrams and the rows that have them all.

``<path>/rows/_part=<n>``       the rows, numbered within each part, a block being BLOCK_ROWS of them
``<path>/lists/bucket=<n>``     (field, gram, part, block, rows): which rows of a block have the trigram in the field, sorted by gram

A block's lists come from the one task that reads it, so building shuffles finished lists, not trigrams. A search
prunes buckets and grams in the scan of the lists, intersects them block by block, and then prunes parts and blocks in
the scan of the rows; ``contains`` has the last word.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from postlens.operators.search import SEARCH_FIELDS, TIE_COLS, newest_first

BLOCK_ROWS, BUCKETS, PART_ROWS = 1024, 64, 250_000
#: Up to so many blocks are named in the filter of the rows' scan; beyond, their parts are.
NAMED_BLOCKS = 2000
_PIECE = 1 << 20
_LISTS = StructType().add("field", "integer").add("gram", "long").add("part", "integer").add("block", "integer").add("rows", ArrayType(IntegerType())).add("bucket", "integer")
_NUMBERS = StructType().add("_nth", "integer").add("_block", "integer").add("_part", "integer")


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a lower-cased text: three code points of 21 bits each in a number, sorted."""
    found = np.zeros(0, np.int64)
    for a in range(0, max(1, len(text) - 2), _PIECE):
        c = np.frombuffer(text[a:a + _PIECE + 2].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        if len(c) >= 3:
            own = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
            found = np.union1d(found, own) if len(found) else own
    return found


def row_trigrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row number) of the distinct trigrams of each text, sorted; short texts are taken together."""
    grams, rows, group, size = [], [], [], 0

    def together():
        c = np.frombuffer("".join(texts[i] for i in group).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(group)), [len(texts[i]) for i in group])
        at = np.flatnonzero(own[2:] == own[:-2])  # a trigram lies in one text
        found, nth = np.unique(c[at] << 42 | c[at + 1] << 21 | c[at + 2], return_inverse=True)
        pairs = np.unique(nth * len(group) + own[at])
        grams.append(found[pairs // len(group)])
        rows.append(np.array(group)[pairs % len(group)])

    for i, t in enumerate(texts):
        if t and len(t) >= _PIECE:
            own = trigrams(t)
            grams.append(own)
            rows.append(np.full(len(own), i))
        elif t:
            group.append(i)
            size += len(t)
        if group and (size >= _PIECE or i + 1 == len(texts)):
            together()
            group, size = [], 0
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram, row = np.concatenate(grams), np.concatenate(rows)
    if len(grams) > 1:
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
    return gram, row


def _lists(fields: Sequence[str]):
    names = _LISTS.fieldNames()

    def of_block(field: int, part: int, block: int, texts: list[str | None], at: np.ndarray):
        gram, row = row_trigrams(texts)
        if not len(gram):
            return
        row = at[row].astype(np.int32)
        head = np.flatnonzero(np.diff(gram, prepend=gram[0] - 1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(gram)).astype(np.int32)), pa.array(row))
        n = len(head)
        whole = [pa.array(np.full(n, x, np.int32)) for x in (field, part, block)]
        bucket = pa.array((gram[head] % BUCKETS).astype(np.int32))
        yield pa.RecordBatch.from_arrays([whole[0], pa.array(gram[head]), whole[1], whole[2], lists, bucket], names)

    def run(batches):
        for batch in batches:
            part, nth = batch["_part"].to_numpy(), batch["_nth"].to_numpy()
            key = part.astype(np.int64) << 32 | nth // BLOCK_ROWS
            cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:], strict=False):  # a block that two batches share gives two lists of a gram
                for f, name in enumerate(fields):
                    yield from of_block(f, int(part[a]), int(nth[a] // BLOCK_ROWS), batch[name].slice(a, b - a).to_pylist(), nth[a:b])

    return run


class TextIndex:
    """A stored table and the trigram lists of some of its text fields."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.json(f"{self.path}/about").first()
        self.fields, stored = list(about["fields"]), StructType.fromJson(json.loads(about["stored"]))
        self.columns = stored.fieldNames()
        # schemas are given, so that an empty table reads as one
        self.rows = spark.read.schema(StructType([*stored.fields, *_NUMBERS.fields])).parquet(f"{self.path}/rows")
        self.lists = spark.read.schema(_LISTS).parquet(f"{self.path}/lists")

    @classmethod
    def build(cls, df: DataFrame, path: str, fields: Sequence[str] = SEARCH_FIELDS) -> TextIndex:
        """Store ``df`` and the lists of ``fields`` under ``path``. Null fields are empty; matching ignores case."""
        spark, path, columns = df.sparkSession, path.rstrip("/"), list(df.columns)
        parts = max(1, -(-df.count() // PART_ROWS))
        number = F.monotonically_increasing_id()
        rows = df.repartition(parts).withColumn("_number", number)
        rows = rows.select(*columns, F.shiftright("_number", 33).cast("int").alias("_part"), F.col("_number").bitwiseAND((1 << 33) - 1).cast("int").alias("_nth"))
        rows.withColumn("_block", F.floor(F.col("_nth") / BLOCK_ROWS).cast("int")).write.partitionBy("_part").parquet(f"{path}/rows")
        texts = spark.read.schema(StructType([*df.schema.fields, *_NUMBERS.fields])).parquet(f"{path}/rows")
        texts = texts.select("_part", "_nth", *[F.lower(F.col(f).cast("string")).alias(f) for f in fields])
        lists = texts.mapInArrow(_lists(fields), _LISTS)
        lists = lists.repartition(F.col("bucket"), F.col("part")).sortWithinPartitions("bucket", "gram")
        lists.write.partitionBy("bucket").parquet(f"{path}/lists")
        about = spark.range(1).select(F.array(*map(F.lit, fields)).alias("fields"), F.lit(df.schema.json()).alias("stored"))
        about.coalesce(1).write.json(f"{path}/about")
        return cls(spark, path)

    def _candidates(self, q: str, fields: Sequence[str]) -> DataFrame:
        """(_part, _block, _nth) of the rows that have all trigrams of ``q`` in one of the fields."""
        grams = trigrams(q).tolist()
        wanted = self.lists.where(F.col("bucket").isin(sorted({g % BUCKETS for g in grams})) & F.col("gram").isin(grams)
                             & F.col("field").isin([self.fields.index(f) for f in fields]))
        whole = wanted.groupBy("field", "part", "block", "gram").agg(F.flatten(F.collect_list("rows")).alias("rows"))
        both = whole.groupBy("field", "part", "block").agg(F.count(F.lit(1)).alias("n"), F.collect_list("rows").alias("lists")).where(F.col("n") == len(grams))
        rows = F.reduce("lists", F.get("lists", F.lit(0)), F.array_intersect)  # BLOCK_ROWS at most
        return both.select(F.col("part").alias("_part"), F.col("block").alias("_block"), F.explode(rows).alias("_nth")).distinct()

    def matching(self, q: str, fields: Sequence[str] | None = None) -> DataFrame:
        """The rows of which a field contains ``q``, whatever the case; below three characters all rows are read."""
        q, fields = q.strip().lower(), list(fields or self.fields)
        rows = self.rows
        if len(q) >= 3:
            found = self._candidates(q, fields)
            blocks = found.select("_part", "_block").distinct().limit(NAMED_BLOCKS + 1).collect()
            if len(blocks) <= NAMED_BLOCKS:
                named = F.col("_block").isin(sorted({b["_block"] for b in blocks}))
                rows = rows.where(F.col("_part").isin(sorted({b["_part"] for b in blocks})) & named)
            rows = rows.join(found, ["_part", "_block", "_nth"], "left_semi")
        sure = F.lit(False)
        for f in fields:
            sure = sure | F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(q)
        return rows.where(sure).select(*self.columns)

    def search(self, q: str, fields: Sequence[str] | None = None, ts_col: str = "posted_at", limit: int = 50, tie_cols: Sequence[str] = TIE_COLS) -> DataFrame:
        """H1 / H2: the rows of :func:`postlens.operators.search.search`, newest first."""
        return self.matching(q, fields).orderBy(*newest_first(ts_col, tie_cols)).limit(limit)
