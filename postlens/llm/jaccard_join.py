"""Exact Jaccard join of word-shingle sets with set-relation skipping (operator 7).

1. One pass over the texts gives each document's set (64-bit hashes of its distinct 5-word
   shingles) as a digest and a size, and a bounded table of how many sets meet in each hash bucket.
2. A second pass orders every set rarest bucket first and posts its prefix (the first
   n - ceil(0.8 n) + 1 shingles: two sets that link share one of them). A shingle
   whose bucket was met once is in no other set and is not posted. Postings are dealt
   out by token once, and tokens that only one set has go no further; the few in
   crowded buckets skip that step, so no token gathers in one task. The table only
   orders and proves uniqueness, so results don't depend on its size.
   Short lists are paired there and then. All tokens that two prefixes share come before
   any other that the two sets share, so a pair's count and last positions bound its
   whole overlap; pairs that cannot reach the threshold are dropped, and with
   them most sets that only have a passage in common.
3. Lists are blocked: sets that share tokens come into blocks of bounded size, and a
   list is a list of blocks with their least size and most remaining positions. Block pairs
   that fail the size or position bound are skipped as a whole.
4. Within a pair of blocks, a set's overlaps with all others are derived from those of an earlier,
   highly similar set by the few shingles in which the two differ.
5. Only spanning edges leave a task. After a first round inside blocks and against each group's
   hub block, blocks whose sets are all in one component skip each other.

Equal sets are one set throughout. The full shingles of a set are sent only if it shares a posted token.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.columns import LOWER, distinct_words, slices, text_buffers, word_spans
from postlens.llm.components import components
from postlens.llm.files import as_rows, written
from postlens.llm.tally import Sparse, all_set, buckets_for, level_of, levels, merge, tally
from postlens.llm.worker import kept, trim

BLOCK_SETS, BLOCK_SHINGLES = 64, 50_000
BUCKETS_PER_TEXT = 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(column: pa.Array, width: int = 5):
    """The sorted distinct shingle hashes of each text, in order; empty without words.

    A-Z is lower-cased; a text with fewer than ``width`` words has its whole sequence as one shingle.
    """
    import xxhash

    data, offsets = text_buffers(column)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    index, words = distinct_words(data, starts, ends)
    code = xxhash.xxh3_64_intdigest
    h = np.fromiter((code(w) for w in words.to_pylist()), np.uint64, len(words))[index]
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        whole += h[k:len(h) - width + 1 + k] * _ODD[k % 5] + np.uint64(k // 5)
    whole = _mixed(whole)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= width:
            yield np.unique(whole[a:b - width + 1])
        elif b > a:
            few = (h[a:b] * _ODD[np.arange(b - a) % 5]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield _mixed(np.array([few], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_of(batches, width: int):
    """(doc_id, digest, set) of all rows; the digest of an empty set is 0."""
    kept("shingles", dict)  # what an earlier operator kept in this worker goes
    for batch in batches:
        for a, b in slices(batch["text"], 1 << 20):
            for key, s in zip(batch["doc_id"].slice(a, b - a).to_pylist(), shingle_sets(batch["text"].slice(a, b - a), width), strict=True):
                yield key, _digest(s) if len(s) else 0, s
        trim()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.int64()), ("range", pa.int32()), ("body", pa.binary())])


def _first_pass(width: int, log_m: int):
    def run(batches):
        sparse, seen, rows = Sparse(log_m, 1), set(), []

        def tables(parts):
            for part in parts:
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, part["range"], part["body"]], schema=_FIRST)

        def documents():
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema=_FIRST)

        for key, digest, s in _sets_of(batches, width):
            rows.append((key, len(s), digest))
            if len(s) and digest not in seen:
                seen.add(digest)
                yield from tables(sparse.add(s))
            if len(rows) >= 10_000:
                yield documents()
                rows = []
        yield documents()
        yield from tables(sparse.flush())

    return run


_POSTING = "token long, digest long, n int, pos int"


def _postings(width: int, percent: int, shared, log_m: int, crowded: int):
    names = ["token", "digest", "n", "pos", "sure"]

    def run(batches):
        seen, out, waiting = set(), [[], [], [], [], []], 0

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

        for _, digest, s in _sets_of(batches, width):
            if not len(s) or digest in seen:
                continue
            seen.add(digest)
            n = len(s)
            most = n - (percent * n + 99) // 100 + 1
            level = levels(shared.value, s, log_m)
            order = np.lexsort((s, level))[:most]
            pos = np.flatnonzero(level[order] != 1)
            if not len(pos):
                continue
            at = order[pos]
            for column, x in zip(out, (s[at].view(np.int64), np.full(len(pos), digest), np.full(len(pos), n, np.int32), pos.astype(np.int32), level[at] >= crowded), strict=True):
                column.append(x)
            waiting += len(pos)
            if waiting > 200_000:
                yield sent()
                out, waiting = [[], [], [], [], []], 0
        if waiting:
            yield sent()

    return run


SHORT = 16
_LISTED = "token long, digest long, n int, pos int, other long, other_n int, other_pos int"


def _repeated(percent: int):
    """From rows in order of (sure, token): lists of more than SHORT rows as they are (and sure rows, by themselves a
    list's part), shorter ones as pairs (digest < other) whose sizes allow a link; tokens of one set go no further."""
    names = [x.split()[0] for x in _LISTED.split(", ")]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def sent(parts: list):
            """One batch of (token, digest, n, pos, other, other_n, other_pos) columns; the last three are null in long lists."""
            arrays = []
            for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())):
                arrays.append(pa.concat_arrays([pa.array(x[k], kind) if k < len(x) else pa.nulls(len(x[0]), kind) for x in parts]))
            return pa.RecordBatch.from_arrays(arrays, names)

        def lists(table: pa.Table):
            token, digest, n, pos = (table[c].to_numpy() for c in ("token", "digest", "n", "pos"))
            order = np.lexsort((digest, token))  # a set that several tasks have posted stands once
            token, digest, n, pos = token[order], digest[order], n[order], pos[order]
            once = np.ones(len(token), bool)
            once[1:] = (np.diff(token) != 0) | (np.diff(digest) != 0)
            token, digest, n, pos = token[once], digest[once], n[once], pos[once]
            head = np.flatnonzero(np.diff(token, prepend=token[0] ^ 1))
            size = np.diff(head, append=len(token))
            long = np.repeat(size > SHORT, size)
            parts = [(token[long], digest[long], n[long], pos[long])]
            for k in range(2, SHORT + 1):
                at = head[size == k]
                for i in range(k if len(at) else 0):
                    for j in range(i + 1, k):
                        x, y = at + i, at + j
                        ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                        x, y = x[ok], y[ok]
                        parts.append((token[x], digest[x], n[x], pos[x], digest[y], n[y], pos[y]))
            yield sent(parts)

        waiting = 0
        for batch in batches:
            sure = batch["sure"].to_numpy(zero_copy_only=False)
            if sure.any():
                own = batch.filter(batch["sure"])
                yield sent([tuple(own[c].to_numpy() for c in ("token", "digest", "n", "pos"))])
                batch = batch.filter(pa.array(~sure))
            if not batch.num_rows:
                continue
            held.append(batch)
            waiting += batch.num_rows
            if waiting < 200_000:  # numpy's calls cost the same for few rows as for many
                continue
            table = pa.Table.from_batches(held)
            token = table["token"].to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            if last:
                yield from lists(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
            waiting = table.num_rows - last
        if held:
            yield from lists(pa.Table.from_batches(held))
        trim()

    return run


def _listed(posted: DataFrame, percent: int) -> DataFrame:
    """(token, digest, n, pos, lo): rows of the lists of two sets or more, ``lo`` the least digest of each.

    Long lists keep their tokens; a pair of sets that can still link is a list of its own.
    """
    long = posted.where("other is null")
    lists = long.groupBy("token").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    # joined by a hash of the token: the sums are dealt out anew, so a hot token's rows can be split between tasks
    lists = lists.select(F.xxhash64("token").alias("key"), F.col("token").alias("_token"), "lo")
    long = long.withColumn("key", F.xxhash64("token")).join(lists, "key").where("token = _token").select("token", "digest", "n", "pos", "lo")
    long = written(long.distinct(), "long-lists")
    in_long = long.groupBy("digest").agg(F.count("*").alias("more"))
    pairs = posted.where("other is not null").groupBy("digest", "other").agg(
        F.count("*").alias("c"), F.max("pos").alias("i"), F.max("other_pos").alias("j"), F.max("n").alias("n"), F.max("other_n").alias("m"))
    both = pairs.join(in_long, "digest", "left").join(in_long.select(F.col("digest").alias("other"), F.col("more").alias("other_more")), "other", "left")
    # of the shared tokens: those paired here, at most the fewer of the two sets' tokens in long lists, and what comes after
    most = F.col("c") + F.least(F.coalesce("more", F.lit(0)), F.coalesce("other_more", F.lit(0))) + F.least(F.col("n") - 1 - F.col("i"), F.col("m") - 1 - F.col("j"))
    able = both.where(most * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    token = F.xxhash64("digest", "other").alias("token")
    ends = F.explode(F.array(F.struct(F.col("digest").alias("d"), F.col("n").alias("n")), F.struct(F.col("other").alias("d"), F.col("m").alias("n")))).alias("x")
    short = able.select(token, ends, F.col("digest").alias("lo")).select("token", F.col("x.d").alias("digest"), F.col("x.n").alias("n"), F.lit(0).alias("pos"), "lo")
    return written(long.union(short), "lists")


def _bodies(width: int, shared, log_m: int):
    def run(batches):
        seen, held, size = set(), [], 0
        for key, digest, s in _sets_of(batches, width):
            if len(s) and digest not in seen and all_set(shared.value, np.array([(digest ^ (key or 0) << 21) & 0xFFFFFFFFFFFFFFFF], np.uint64), log_m, 2)[0]:
                seen.add(digest)
                held.append((digest, s.tobytes()))
                size += s.nbytes
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array([x[1] for x in held], pa.binary())], ["digest", "body"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held]), pa.array([x[1] for x in held], pa.binary())], ["digest", "body"])

    return run


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among a few sets.

    A set's overlaps with all others come from those of the most similar set done before (if their Jaccard
    similarity is 0.9 or more) by the shingles in which the two differ, else from all its shingles.
    """
    g = len(sets)
    size = np.array([len(s) for s in sets])
    universe, place = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(place, np.cumsum(size)[:-1])
    member = np.zeros((len(universe), g), np.uint8)
    for k, at in enumerate(own):
        member[at, k] = 1
    overlap = np.zeros((g, g), np.int64)
    root, edges = list(range(g)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    done: list[int] = []
    for s in np.argsort(size, kind="stable").tolist():
        near = max(done, key=lambda r: overlap[r, s] / (size[r] + size[s] - overlap[r, s]), default=None)
        if near is not None and 10 * overlap[near, s] >= 9 * (size[near] + size[s] - overlap[near, s]):
            more, less = own[s][member[own[s], near] == 0], own[near][member[own[near], s] == 0]
            overlap[s] = overlap[near] + member[more].sum(0, dtype=np.int64) - member[less].sum(0, dtype=np.int64)
        else:
            overlap[s] = member[own[s]].sum(0, dtype=np.int64)
        done.append(s)
        for y in np.flatnonzero(100 * overlap[s] >= percent * (size[s] + size - overlap[s])).tolist():
            a, b = find(s), find(y)
            if a != b:
                root[a] = b
                edges.append((int(ids[s]), int(ids[y])))
    return edges


def _verify(percent: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            unit, digest = table["unit"].to_numpy(), table["digest"].to_numpy()
            body = table["body"]
            bounds = np.append(np.flatnonzero(np.diff(unit, prepend=unit[0] - 1)), len(unit))
            edges = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                ids, at = np.unique(digest[a:b], return_index=True)
                if len(ids) > 1:
                    edges += linked_forest(ids, [np.frombuffer(body[int(a + k)].as_py(), np.uint64) for k in at], percent)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], ["a", "b"])

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


def _edges(bodies: DataFrame, members: DataFrame, percent: int, name: str) -> DataFrame:
    """Verified spanning edges (a, b) of all units, from members(unit, digest).

    Sets that no unit wants are left behind by a Bloom table before anything is shuffled.
    """
    spark = bodies.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = written(members.select("unit", "digest").distinct(), f"{name}-members")
    log_k = buckets_for(members.count(), 16, 1)
    wanted = spark.sparkContext.broadcast(tally(members, "digest", log_k, k=2))

    @F.arrow_udf("boolean")
    def maybe(digest: pa.Array) -> pa.Array:
        return pa.array(all_set(wanted.value, digest.to_numpy(zero_copy_only=False), log_k, 2))

    rows = bodies.where(maybe("digest")).join(members, "digest").select("unit", "digest", "body")
    dealt = rows.repartition(n, "unit").sortWithinPartitions("unit")
    return written(dealt.mapInArrow(_verify(percent), "a long, b long"), name)


def _sharing(listed: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(lo, hi, lo_one, hi_one): pairs of blocks that share a posted token and pass the size and position bounds."""
    at = listed.join(blocks, "digest").groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.first("one").alias("one"))
    a = at.select("token", *[F.col(c).alias(f"lo_{c}") for c in at.columns[1:]])
    b = at.select("token", *[F.col(c).alias(f"hi_{c}") for c in at.columns[1:]])
    fits = (F.col("lo_most") * 100 >= F.col("hi_least") * percent) & (F.col("hi_most") * 100 >= F.col("lo_least") * percent)
    far = F.least("lo_rest", "hi_rest") * (100 + percent) >= (F.col("lo_least") + F.col("hi_least")) * percent
    pairs = a.join(b, "token").where((F.col("lo_block") < F.col("hi_block")) & fits & far)
    pairs = pairs.where("lo_one is null or hi_one is null or lo_one <> hi_one")
    return pairs.select(F.col("lo_block").alias("lo"), F.col("hi_block").alias("hi")).distinct()


def _units(pairs: DataFrame) -> DataFrame:
    unit = F.xxhash64("lo", "hi").alias("unit")
    return pairs.select(unit, F.explode(F.array("lo", "hi")).alias("block"))


def _chunks(count, total):
    return F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _components_of_sets(listed: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    sets = listed.groupBy("digest").agg(F.min("lo").alias("label"), F.max("n").alias("n"))
    of_label = sets.groupBy("label").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks"))
    of_label = of_label.select(F.xxhash64("label").alias("key"), F.col("label").alias("_label"), "chunks")  # dealt out anew, so a hot label can be split
    blocks = sets.withColumn("key", F.xxhash64("label")).join(of_label, "key").where("label = _label").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    blocks = written(blocks.select("digest", "n", "label", "chunks", "chunk", F.xxhash64("label", "chunk").alias("block")), "blocks")
    every = blocks.select("label", "chunk", "block").distinct()
    hub = F.xxhash64("label", F.lit(0))
    first = every.select(F.col("block").alias("unit"), "block")
    first = first.union(_units(every.where("chunk > 0").select(hub.alias("lo"), F.col("block").alias("hi"))))
    edges = _edges(bodies, blocks.select("digest", "block").join(first, "block"), percent, "edges1")
    # second round: sets of a large component only meet sets of others
    comp = components(edges).select(F.col("node").alias("digest"), "component")
    comp = blocks.join(comp, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    comp = written(comp, "components1")
    large = comp.where("chunks > 1").groupBy("component").agg(F.count("*").alias("members"), _chunks(F.count("*"), F.sum("n")).alias("parts")).where(F.col("members") >= BLOCK_SETS // 4)
    large = large.select(F.col("component").alias("one"), "parts")
    again = comp.join(large, F.col("component") == F.col("one"), "left")
    rest = again.where("one is null and chunks > 1").groupBy("label").agg(_chunks(F.count("*"), F.sum("n")).alias("rest_parts"))
    # joined by a hash of the label, dealt out anew, so that a hot label's rows can be split
    again = again.withColumn("key", F.xxhash64("label")).join(rest.withColumn("key", F.xxhash64("label")), ["key", "label"], "left")
    block = (F.when(F.col("one").isNotNull(), F.xxhash64("one", F.pmod(F.xxhash64("digest"), F.col("parts")), F.lit(1)))
             .when(F.col("chunks") > 1, F.xxhash64("label", F.pmod(F.xxhash64("digest"), F.col("rest_parts")), F.lit(2))).otherwise(F.col("block")))
    again = written(again.select("digest", "one", "chunks", block.alias("block")), "blocks2")
    inside = again.where("one is null and chunks > 1").select(F.col("block").alias("unit"), "block").distinct()
    second = inside.union(_units(_sharing(listed, again, percent)))
    return components(edges.union(_edges(bodies, again.select("digest", "block").join(second, "block"), percent, "edges2")))


def components_of_documents(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that it reaches by links, its own included).

    Texts link when 100 * intersection >= ``percent`` * union. Null and empty texts and texts without words
    have an empty set and link with nothing; texts with equal sets link; rows that share an id are each for
    themselves; an empty table gives an empty table. Sets are told apart by a 64-bit digest.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    log_m = buckets_for(docs.count() * BUCKETS_PER_TEXT, 1, 4)
    first = written(texts.mapInArrow(_first_pass(width, log_m), "doc_id long, n long, digest long, range int, body binary"), "sets")
    own = first.where("range is null").select("doc_id", "n", "digest")
    rarity = spark.sparkContext.broadcast(merge(first.where("range is not null").select("range", "body"), log_m, bits_each=4))
    # buckets eight times as full as the mean, and those of 64 sets: their tokens are kept without a look at who else has them
    load = (own.agg(F.sum("n")).first()[0] or 0) / (1 << log_m)
    crowded = int(level_of(max(64.0, 8 * load))) + 1
    posted = texts.mapInArrow(_postings(width, percent, rarity, log_m, crowded), _POSTING + ", sure boolean")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = posted.repartition(n, F.when(F.col("sure"), F.xxhash64("token", "digest")).otherwise(F.col("token"))).sortWithinPartitions("sure", "token")
    listed = _listed(written(dealt.mapInArrow(_repeated(percent), _LISTED), "postings"), percent)
    # of the documents with an equal set the one with the least id sends it
    members = listed.select("digest").distinct().join(own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "digest")
    members = written(members.select(F.col("digest").bitwiseXOR(F.shiftleft(F.coalesce("doc_id", F.lit(0)), 21)).alias("mark")), "members")
    log_k = buckets_for(members.count(), 16, 1)
    wanted = spark.sparkContext.broadcast(tally(members, "mark", log_k, k=2))
    bodies = written(texts.mapInArrow(_bodies(width, wanted, log_k), "digest long, body binary"), "bodies")
    found = _components_of_sets(listed, bodies, percent).select(F.col("node").alias("digest"), "component")
    full = own.where("n > 0").join(found, "digest", "left").select("doc_id", "n", F.coalesce("component", "digest").alias("group"))
    low = full.groupBy("group").agg(F.min("doc_id").alias("component_id")).select(F.xxhash64("group").alias("key"), F.col("group").alias("_group"), "component_id")
    full = full.withColumn("key", F.xxhash64("group")).join(low, "key").where("group = _group").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(own.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id")))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` (all columns) with one document of each component: the one with the smallest id.

    Rows that share an id are one document. Only rows that a Bloom table of the dropped ids cannot rule out are shuffled.
    """
    spark = docs.sparkSession
    found = components_of_documents(docs, id_col=id_col, text_col=text_col, **options)
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    log_k = buckets_for(gone.count(), 16, 1)
    table = spark.sparkContext.broadcast(tally(gone, "doc_id", log_k, k=2))

    @F.arrow_udf("boolean")
    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(all_set(table.value, ids.fill_null(0).to_numpy(zero_copy_only=False), log_k, 2) & ids.is_valid().to_numpy(zero_copy_only=False))

    key = F.col("row")[id_col].cast("long")
    seen = as_rows(docs).select("row", key.alias("key"), maybe(key).alias("maybe"))
    stay = seen.where("maybe").join(gone.withColumnRenamed("doc_id", "key"), "key", "left_anti")
    return seen.where("not maybe").select("row.*").union(stay.select("row.*"))
