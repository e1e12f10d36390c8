"""Near-duplicate embeddings by cross-polytope hashing (operator 8).

A vector is turned by pseudo-random rotations (three rounds of sign flips and a fast Hadamard
transform) and hashed to its nearest axis, with sign. A table's code joins a few such hashes,
so many that there are about as many buckets as vectors. Each vector stands in its own bucket of every table and asks, besides, in the buckets of its next
nearest axes (multiprobe). All pairs that meet in a bucket are verified by cosine in double
precision, block against block, and only sums leave the task: links per vector,
and the edges of a spanning forest. A pair that meets more than once counts in the
first place where it meets.

Buckets are found with ids alone; only entries that share a bucket with its owner get their
vectors. Equal vectors are one representative, a 64-bit hash of the vector, with a multiplicity. Buckets larger than a block are
dealt out as pairs of blocks, so no bucket is capped and none is one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.components import components
from postlens.llm.files import written

BLOCK = 512
_ENTRY = "bucket long, rep long, main boolean"
_BODY = "rep long, times long, codes binary, v binary, width int"


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x through rounds of sign flips and the Hadamard transform (row length a power of two)."""
    d = x.shape[1]
    for flip in signs:
        x = x * flip
        h = 1
        while h < d:
            y = x.reshape(len(x), d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def codes(x: np.ndarray, hashes: int, tables: int, probes: int, seed: int) -> np.ndarray:
    """int64 [rows, tables, 1 + probes]: own code first, then the codes with one hash at a next nearest axis."""
    n, width = x.shape
    d = max(2, 1 << (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - width)))
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    near = min(probes, d - 1)
    for t in range(tables):
        axes, steps = [], []
        for _ in range(hashes):
            turned = rotate(x, rng.choice([-1.0, 1.0], (3, d)))
            size = np.abs(turned)
            order = np.argpartition(-size, near, axis=1)[:, :near + 1]
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(size, order, 1), axis=1, kind="stable"), 1)
            value = np.take_along_axis(size, order, 1)
            axes.append(order * 2 + (np.take_along_axis(turned, order, 1) < 0))
            steps.append(value[:, :1] - value[:, 1:])
        place = [(2 * d) ** k for k in range(hashes)]
        own = sum(a[:, 0] * p for a, p in zip(axes, place, strict=True))
        other = np.concatenate([own[:, None] + (a[:, 1:] - a[:, :1]) * p for a, p in zip(axes, place, strict=True)], 1)
        # the smaller the step down from the nearest axis, the likelier a neighbour lies there
        best = np.argsort(np.concatenate(steps, 1), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = own
        out[:, t, 1:1 + best.shape[1]] = np.take_along_axis(other, best, 1)
        out[:, t, 1 + best.shape[1]:] = own[:, None]
    return out


def hashes_for(n: int, width: int) -> int:
    """Hashes per code, so that the buckets of a table are about as many as the vectors."""
    return max(2, int(np.ceil(np.log(max(2, n)) / np.log(2 * max(2, 1 << (width - 1).bit_length())))))


def tables_for(hashes: int) -> int:
    """Tables that keep the recall at the threshold, as longer codes meet more seldom (measured in tests/llm/test_llm_dedup.py)."""
    return max(8, 4 * (hashes - 1))


def _usable(column: pa.Array) -> np.ndarray:
    """Rows that are not null, hold only finite components and are not zero."""
    good = np.zeros(len(column), bool)
    for k, row in enumerate(column):
        if row.is_valid:
            v = np.array(row.as_py(), float) if row.values.null_count else row.values.to_numpy(zero_copy_only=False).astype(float)
            good[k] = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
    return good


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [row.values.to_numpy(zero_copy_only=False).astype(float) for row in column]


def _bodies(hashes: dict[int, int], tables: int, probes: int, seed: int):
    names = [x.split()[0] for x in _BODY.split(", ")]

    def run(batches):
        for batch in batches:
            vectors = _vectors(batch["v"])
            widths = np.array([len(v) for v in vectors])
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                x = _unit(np.stack([vectors[i] for i in at]))
                own = codes(x, hashes[width], tables, probes, seed)
                packed = [c.astype(_code_type(hashes[width], width)).tobytes() for c in own]
                columns = [batch[c].take(pa.array(at)) for c in ("rep", "times")]
                raw = [_narrow(vectors[i]).tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary()), pa.array(raw, pa.binary()), pa.array(np.full(len(at), width, np.int32))], names)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _narrow(v: np.ndarray) -> np.ndarray:
    """As 32-bit floats if they hold the same values."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return short if (short == v).all() else v


def _code_type(hashes: int, width: int) -> type:
    return np.int32 if (2 * max(2, 1 << (width - 1).bit_length())) ** hashes < 2**31 else np.int64


def _bucket(code: np.ndarray, table: int, width: int) -> np.ndarray:
    """Number of a bucket: exact for codes below 2^42, mixed beyond (verification then tells mixed buckets apart)."""
    return (code.astype(np.uint64) * np.uint64(64) + np.uint64(table)).view(np.int64) * 65536 + width


def _entries(hashes: dict[int, int], tables: int, probes: int):
    def run(batches):
        for batch in batches:
            rep, widths = batch["rep"].to_numpy(), batch["width"].to_numpy()
            packed = batch["codes"].to_pylist()
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                own = np.stack([np.frombuffer(packed[i], _code_type(hashes[width], width)) for i in at]).astype(np.int64).reshape(len(at), tables, 1 + probes)
                for t in range(tables):
                    for p in range(1 + probes):
                        ok = np.ones(len(at), bool) if p == 0 else own[:, t, p] != own[:, t, 0]
                        n = int(ok.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(_bucket(own[ok, t, p], t, width)), pa.array(rep[at[ok]]), pa.array(np.full(n, p == 0))], ["bucket", "rep", "main"])

    return run


def _first_meeting(ci: np.ndarray, cj: np.ndarray, table: int, bucket: int, width: int) -> np.ndarray:
    """Whether the bucket is the first place where each pair meets. ci, cj: [pairs, tables, 1 + probes]."""
    seen = np.zeros(len(ci), bool)
    for t in range(table + 1):
        i_asks, j_asks = (ci[:, t] == cj[:, t, :1]).any(1), (cj[:, t] == ci[:, t, :1]).any(1)
        if t < table:
            seen |= i_asks | j_asks
        else:  # the places in this table: j's own bucket if i asks there, i's own bucket if j does
            seen |= i_asks & (_bucket(cj[:, t, 0], t, width) < bucket) | j_asks & (_bucket(ci[:, t, 0], t, width) < bucket)
            seen |= ~(i_asks | j_asks)  # codes that only share the bucket's number
    return ~seen


def _links(group: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, other, links): sums of links per vector of one pair of blocks, and forest edges (links 0)."""
    rep, side, main = group["rep"], group["side"], group["main"]
    left = np.flatnonzero(side != 1)
    right = left if (side == 0).all() else np.flatnonzero(side == 1)
    x = group["x"]
    cos = x[left] @ x[right].T
    i, j = np.nonzero(cos >= threshold - 1e-12)
    i, j = left[i], right[j]
    ok = (main[i] | main[j]) & (rep[i] != rep[j])
    if right is left:
        ok &= i < j
    i, j = i[ok], j[ok]
    if len(i):
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[exact], j[exact]
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    c = group["codes"]
    first = _first_meeting(c[i], c[j], group["table"], group["bucket"], group["width"])
    i, j = i[first], j[first]
    total = np.zeros(len(rep))
    np.add.at(total, i, group["times"][j])
    np.add.at(total, j, group["times"][i])
    hit = np.flatnonzero(total)
    parent = np.arange(len(rep))
    for _ in range(len(rep)):  # label propagation to the smallest member
        low = parent.copy()
        np.minimum.at(low, i, parent[j])
        np.minimum.at(low, j, parent[i])
        low = low[low]
        if (low == parent).all():
            break
        parent = low
    joined = np.flatnonzero(parent != np.arange(len(rep)))
    return np.concatenate([rep[hit], rep[joined]]), np.concatenate([rep[hit], rep[parent[joined]]]), np.concatenate([total[hit], np.zeros(len(joined))]).astype(np.int64)


def _verify(threshold: float, hashes: dict[int, int], tables: int, probes: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            unit, bucket, side, rep, times, main = (table[c].to_numpy() for c in ("unit", "bucket", "side", "rep", "times", "main"))
            bounds = np.append(np.flatnonzero(np.diff(unit, prepend=unit[0] - 1)), len(unit))
            out = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                width, part = int(bucket[a] & 65535), table.slice(a, b - a)
                raw = part["v"].to_pylist()
                x = _unit(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * width else float).astype(float) for v in raw]))
                own = np.frombuffer(b"".join(part["codes"].to_pylist()), _code_type(hashes[width], width)).astype(np.int64).reshape(b - a, tables, 1 + probes)
                group = {"rep": rep[a:b], "side": side[a:b], "main": main[a:b], "times": times[a:b], "x": x, "codes": own, "table": int(bucket[a] >> 16) % 64, "bucket": int(bucket[a]), "width": width}
                out.append(_links(group, threshold))
            arrays = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["rep", "other", "links"])

        for batch in batches:  # sorted by unit: a unit's rows are kept until the next begins
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            unit = table["unit"].to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))
            if last:
                yield flush(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, tables: int | None = None, probes: int = 4, seed: int = 8,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing. Equal
    vectors link; vectors of different lengths never do. Rows that share an id are vectors each for itself: they
    link, and share a component, if their vectors do. A row without an id is compared like any other; a component
    is named by its smallest id that is not null, null if it has none. An empty table gives an empty table.
    """
    if tables is not None and not 1 <= tables <= 64:
        raise ValueError("1 to 64 tables")

    @F.arrow_udf("boolean")
    def usable(column: pa.Array) -> pa.Array:
        return pa.array(_usable(column))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", usable("v"))
    own = rows.where("good").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    own = written(own.select("v", F.xxhash64("v").alias("rep"), "id", "times"), "vectors")
    hashes = {r["width"]: hashes_for(r["n"], r["width"]) for r in own.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}  # a row per vector length
    tables = tables or min(64, tables_for(max(hashes.values(), default=2)))
    bodies = written(own.mapInArrow(_bodies(hashes, tables, probes, seed), _BODY), "bodies")
    entries = written(bodies.select("rep", "codes", "width").mapInArrow(_entries(hashes, tables, probes), _ENTRY), "buckets")
    size = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.max("main").alias("owned")).where("n > 1 and owned")
    # joined by a hash of the bucket: the sums are dealt out anew, so a hot bucket's rows can be split between tasks
    size = size.select(F.xxhash64("bucket").alias("key"), F.col("bucket").alias("b"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = entries.withColumn("key", F.xxhash64("bucket")).join(size, "key").where("bucket = b").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.select("bucket", "rep", "main", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    lo, hi = F.least("own", "with"), F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") == lo, 2).otherwise(1)
    units = placed.select("bucket", "rep", "main", side.alias("side"), F.xxhash64("bucket", lo, hi).alias("unit")).join(bodies.drop("width"), "rep")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "unit").sortWithinPartitions("unit")
    found = written(dealt.mapInArrow(_verify(threshold, hashes, tables, probes), "rep long, other long, links long"), "links")
    links = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("links = 0").select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("rep"), "component")
    of_rep = own.join(links, "rep", "left").join(joined, "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    low = of_rep.groupBy("group").agg(F.min("id").alias("component_id")).withColumn("key", F.xxhash64("group"))
    # joined by a hash of the group, dealt out anew, so that a large component's rows can be split
    of_rep = of_rep.withColumn("key", F.xxhash64("group")).join(low, ["key", "group"]).select(
        F.col("v").alias("rv"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = rows.where("good").join(of_rep, F.col("v") == F.col("rv")).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
