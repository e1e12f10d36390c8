"""Skill NLP: skill documents, TF-IDF, emerging skills, term similarity, clusters,
co-occurrence (E1-E9).

Identical skill documents are folded into one row with a multiplicity
``mult`` first; every later sum (document frequency, mean TF-IDF, Gram matrix,
pair counts) is weighted by it, so results are exact while the work follows
the number of distinct documents.

TF-IDF follows the common defaults: raw term counts, ``min_df``/``max_df``
document-frequency cuts, the ``max_features`` terms with the largest corpus
count (ties by term), smooth idf ``ln((1+n)/(1+df)) + 1``, rows scaled to unit
L2 norm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from postlens import vocab as V
from postlens.session import stored
from postlens.functions.numeric import py_round
from postlens.functions.text import py_strip


def skill_documents(df: DataFrame, col: str = "skills") -> DataFrame:
    """E1 input: (doc, mult, skills) -- comma split, strip, lower, blanks dropped.

    Rows with no skills are not documents. ``doc`` is the skills joined by a
    space; identical documents are one row with multiplicity ``mult``.
    """
    items = F.filter(F.transform(F.split(F.col(col), ","), lambda s: F.lower(py_strip(s))), lambda s: F.length(s) > 0)
    docs = df.where(F.col(col).isNotNull()).select(items.alias("skills")).where(F.size("skills") > 0)
    return docs.groupBy("skills").agg(F.count(F.lit(1)).alias("mult")).select(
        F.array_join("skills", " ").alias("doc"), "mult", "skills")


def skill_summary(docs: DataFrame, top: int = 20) -> DataFrame:
    """Total mentions, distinct skills, and the top-N skills by mentions."""
    mentions = docs.select(F.explode("skills").alias("skill"), "mult").groupBy("skill").agg(
        F.sum("mult").alias("count"))
    stats = mentions.agg(F.sum("count").alias("total_skill_mentions"), F.count(F.lit(1)).alias("unique_skills"))
    order = [F.col("count").desc(), F.col("skill")]
    topn = mentions.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return topn.crossJoin(F.broadcast(stats))


def skill_frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("skills").alias("skill"), "mult").groupBy("skill").agg(F.sum("mult").alias("frequency"))


def tfidf(docs: DataFrame, token_pattern: str = V.TFIDF_TOKEN_PATTERN, max_features: int = V.TFIDF_MAX_FEATURES,
          min_df: int = V.TFIDF_MIN_DF, max_df: float = V.TFIDF_MAX_DF, fold: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (weights, vocabulary, n_docs).

    weights: (doc, mult, term, w) -- unit-L2 rows over the kept vocabulary;
    vocabulary: (term, idx, df, idf) with idx in term order (at most
    ``max_features`` rows, so it is broadcast by construction);
    n_docs: one row (n).
    ``fold=False`` leaves equal texts of several rows apart, each with its own ``mult``: sums over
    the weights are the same, and no row is shuffled.
    """
    # A document's tokens stay in its row. What is shuffled are partial sums per term, and to fold equal texts a
    # 128-bit digest with the counts of the vocabulary's terms.
    keyed = docs.select(F.md5("doc").alias("doc"), "mult", F.regexp_extract_all(F.lower("doc"), F.lit(token_pattern), 0).alias("t"))
    n_docs = docs.agg(F.sum("mult").alias("n"))
    once = lambda t: F.struct(t.alias("term"), F.lit(1).alias("docs"), F.lit(0).alias("uses"))
    use = lambda t: F.struct(t.alias("term"), F.lit(0).alias("docs"), F.lit(1).alias("uses"))
    seen = keyed.select("mult", F.explode(F.concat(F.transform(F.array_distinct("t"), once), F.transform("t", use))).alias("x"))
    stats = seen.groupBy("x.term").agg(F.sum(F.col("x.docs") * F.col("mult")).alias("df"), F.sum(F.col("x.uses") * F.col("mult")).alias("total"))
    stats = stats.crossJoin(F.broadcast(n_docs)).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n")))
    order = [F.col("total").desc(), F.col("term")]
    vocab = stats.orderBy(*order).limit(max_features)
    vocab = vocab.select(
        "term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"), "df",
        (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    vocab = stored(vocab, "terms")  # read by each use below and by the caller
    terms = [r["term"] for r in vocab.orderBy("idx").collect()]  # at most ``max_features``
    if not terms:
        return keyed.select("doc", "mult").limit(0).crossJoin(F.broadcast(vocab.select("term", "idx", F.col("idf").alias("w")))), vocab, n_docs
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="t", outputCol="v")
    counts = counter.transform(keyed.where(F.col("doc").isNotNull())).select("doc", "mult", vector_to_array("v").alias("v"))
    pairs = F.transform("v", lambda c, i: F.when(c > 0, F.struct(i.alias("idx"), c.alias("tf"))))
    tf = counts.select("doc", "mult", F.array_compact(pairs).alias("e")).where(F.size("e") > 0)
    if fold:
        tf = tf.groupBy("doc").agg(F.sum("mult").alias("mult"), F.first("e").alias("e"))
    all_idf = vocab.agg(F.array_sort(F.collect_list(F.struct("idx", "idf", "term"))).alias("voc"))
    of = lambda x: F.get("voc", x["idx"])
    raw = tf.crossJoin(F.broadcast(all_idf)).select("doc", "mult", F.transform("e", lambda x: F.struct(
        of(x)["term"].alias("term"), x["idx"].alias("idx"), (x["tf"] * of(x)["idf"]).alias("raw"))).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["raw"] * x["raw"]))
    rows = raw.select("doc", "mult", norm.alias("norm"), F.explode("e").alias("x"))
    weights = rows.select("doc", "mult", "x.term", "x.idx", (F.col("x.raw") / F.col("norm")).alias("w"))
    return weights, vocab, n_docs


def mean_tfidf(weights: DataFrame, n_docs: DataFrame, top: int = 30) -> DataFrame:
    """Mean weight per term over all documents (zeros included), 4 decimals, top N."""
    s = weights.groupBy("term").agg(F.sum(F.col("w") * F.col("mult")).alias("s")).crossJoin(F.broadcast(n_docs))
    scores = s.select("term", py_round(F.col("s") / F.col("n"), 4).alias("score"))
    order = [F.col("score").desc(), F.col("term")]
    return scores.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def emerging_skills(docs: DataFrame, scores: DataFrame | None, known: list[str] | None = None,
                    top_freq: int = 100, top: int = 20) -> DataFrame:
    """Frequent skills (top 100) not in the vocabulary and longer than one
    character, with their top-30 mean TF-IDF score or 0; the first 20 by frequency.

    With fewer than two documents there is no TF-IDF (E5): pass ``scores=None``.
    """
    known = known if known is not None else V.VOCAB.known_skills()
    spark = docs.sparkSession
    known_df = spark.createDataFrame([(k,) for k in known], "skill string")
    order = [F.col("frequency").desc(), F.col("skill")]
    freq = skill_frequencies(docs).orderBy(*order).limit(top_freq)
    cand = freq.join(F.broadcast(known_df), "skill", "left_anti").where(F.length("skill") > 1)
    if scores is not None:
        n = docs.agg(F.sum("mult").alias("_n"))
        cand = cand.join(F.broadcast(scores.select(F.col("term").alias("skill"), "score")), "skill", "left") \
            .crossJoin(F.broadcast(n)) \
            .withColumn("tfidf_score", F.when(F.col("_n") >= 2, F.coalesce("score", F.lit(0.0))).otherwise(0.0)) \
            .drop("score", "_n")
    else:
        cand = cand.withColumn("tfidf_score", F.lit(0.0))
    return cand.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


_GRAM_SCHEMA = StructType([StructField("i", IntegerType()), StructField("j", IntegerType()),
                           StructField("g", DoubleType())])


def quadratic_cells(batches):
    """Cells of W' M W over a partition's documents: one matrix product per Arrow batch, sized by the terms met."""
    g = np.zeros((0, 0))
    for pdf in batches:
        if not len(pdf):
            continue
        n = pdf["idx"].map(len).to_numpy()
        idx = np.concatenate(pdf["idx"].to_list()).astype(np.int64)
        size = max(len(g), int(idx.max()) + 1 if len(idx) else 0)
        w = np.zeros((len(pdf), size))
        w[np.repeat(np.arange(len(pdf)), n), idx] = np.concatenate(pdf["w"].to_list())
        more = w.T @ (w * pdf["mult"].to_numpy(float)[:, None])
        more[:len(g), :len(g)] += g
        g = more
    i, j = np.nonzero(np.triu(g))
    if len(i):
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "g": g[i, j]})


def term_similarity(weights: DataFrame) -> DataFrame:
    """Cosine between term columns of the TF-IDF matrix, (i, j, sim) for i < j.

    Each partition adds its documents up to the upper triangle of one matrix over
    the vocabulary (bounded by ``max_features`` of the TF-IDF); a sum per cell finishes
    it. Norms are the cells' own diagonal, taken by window over that small frame,
    so the product runs once.
    """
    per_doc = weights.groupBy("doc", "mult").agg(F.collect_list(F.struct("idx", "w")).alias("e")).select(
        "mult", F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
    cells = per_doc.mapInPandas(quadratic_cells, _GRAM_SCHEMA).groupBy("i", "j").agg(F.sum("g").alias("g"))
    norm = F.when(F.col("i") == F.col("j"), F.sqrt("g"))
    cells = cells.select("*", F.max(norm).over(Window.partitionBy("i")).alias("ni"),
                         F.max(norm).over(Window.partitionBy("j")).alias("nj"))
    return cells.where(F.col("i") < F.col("j")).select("i", "j", (F.col("g") / (F.col("ni") * F.col("nj"))).alias("sim"))


def skill_clusters(sims: DataFrame, vocab: DataFrame, threshold: float = V.CLUSTER_THRESHOLD) -> DataFrame:
    """Greedy leader clusters in term order at cosine >= threshold; singletons dropped.

    A term joins the first earlier leader that it is similar to. The pass is
    a fold over one row: the adjacency lists of the vocabulary (bounded by the
    TF-IDF's ``max_features``), in term order. Fewer than 3 terms give no cluster.
    :func:`leader_clusters` does the same in rounds for larger vocabularies.
    """
    lists = sims.where(F.col("sim") >= threshold).groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("js"))
    one = lists.agg(F.array_sort(F.collect_list(F.struct("i", "js"))).alias("lists"))
    start = F.expr("named_struct('used', cast(array() as array<int>), 'out', cast(array() as array<array<int>>))")

    def step(acc, x):
        members = F.concat(F.array(x["i"]), F.filter(x["js"], lambda j: ~F.array_contains(acc["used"], j)))
        grown = F.struct(F.concat(acc["used"], members).alias("used"),
                         F.when(F.size(members) > 1, F.concat(acc["out"], F.array(members))).otherwise(acc["out"]).alias("out"))
        return F.when(F.array_contains(acc["used"], x["i"]), acc).otherwise(grown)

    clusters = one.select(F.explode(F.aggregate("lists", start, step, lambda acc: acc["out"])).alias("members"))
    rows = clusters.select(F.element_at("members", 1).alias("l"), F.posexplode("members").alias("member_order", "m"))
    terms = vocab.select("idx", "term")
    enough = vocab.agg((F.count(F.lit(1)) >= 3).alias("enough"))
    named = rows.join(terms.select(F.col("idx").alias("l"), F.col("term").alias("leader")), "l") \
        .join(terms.select(F.col("idx").alias("m"), F.col("term").alias("member")), "m")
    return named.crossJoin(F.broadcast(enough)).where("enough").select("leader", "member", "member_order")


def leader_clusters(edges: DataFrame) -> DataFrame:
    """E7 for vocabularies of any size: (leader, member, member_order) of the graph ``edges(i, j)``, i < j, in number order.

    The leaders of the fold in :func:`skill_clusters` are the lexicographically first independent set. Each round decides, all
    at once, the nodes whose smaller neighbours are all members (they lead) and those with a leading smaller
    neighbour (they are members), and drops their edges; a member joins its smallest leader. Rounds are few (they
    follow the longest chain of undecided neighbours) and each is stored in the shared folder.
    """
    every = stored(edges.select("i", "j").distinct(), "edges")
    nodes = every.select(F.explode(F.array("i", "j")).alias("v")).distinct()
    open_, waiting, leads = every, stored(nodes, "nodes"), []
    while waiting.limit(1).count():
        # no undecided smaller neighbour: a leader
        new = stored(waiting.join(open_.select(F.col("j").alias("v")).distinct(), "v", "left_anti"), "leaders")
        leads.append(new)
        members = open_.join(new.withColumnRenamed("v", "i"), "i", "left_semi").select(F.col("j").alias("v")).distinct()
        decided = stored(new.union(members), "decided")
        waiting = stored(waiting.join(decided, "v", "left_anti"), "waiting")
        for end in ("i", "j"):
            open_ = open_.join(decided.withColumnRenamed("v", end), end, "left_anti")
        open_ = stored(open_, "open")
    if not leads:
        return edges.select(F.col("i").alias("leader"), F.col("j").alias("member"), F.lit(0).alias("member_order")).limit(0)
    leaders = leads[0]
    for x in leads[1:]:
        leaders = leaders.union(x)
    joined = every.join(leaders.withColumnRenamed("v", "i"), "i", "left_semi").groupBy(F.col("j").alias("member")).agg(F.min("i").alias("leader"))
    own = joined.select(F.col("leader").alias("member"), "leader").distinct()
    rows = joined.select("member", "leader").union(own)
    nth = F.row_number().over(Window.partitionBy("leader").orderBy("member")) - 1
    return rows.select("leader", "member", nth.alias("member_order"))


def cooccurrence(docs: DataFrame, top: int = 15, mode: str = "token", seed_tokens: int = 64, block: int = 256) -> DataFrame:
    """The most frequent unordered pairs inside documents, with multiplicity.

    ``mode="token"`` pairs the space-split tokens of the joined skills (the
    reference's behaviour: multi-word skills split, a token can pair with
    itself); ``mode="skill"`` pairs whole skills.

    Exact top-N without counting every pair of every document:
    count(a, b) = sum_d c_a(d) c_b(d) <= F_a * M_max, with F the corpus count
    and M_max the largest per-document count of any token. Pairs among the
    ``seed_tokens`` most frequent tokens give a lower bound tau on the N-th
    largest count; only tokens with F * M_max >= tau can be in the answer, and
    pairs are counted among those tokens only. A document with more than ``block`` of
    them is cut into blocks, and its pairs of blocks are counted apart, so no row pairs a long
    document's tokens all by itself.
    """
    if mode == "token":
        by_doc = docs.groupBy("doc").agg(F.sum("mult").alias("mult"))
        toks = by_doc.select(F.md5("doc").alias("doc"), "mult", F.explode(F.split(F.trim("doc"), r"\s+")).alias("t"))
    elif mode == "skill":
        by_sk = docs.groupBy("skills").agg(F.sum("mult").alias("mult"))
        toks = by_sk.select(F.col("skills").alias("doc"), "mult", F.explode("skills").alias("t"))
    else:
        raise ValueError(mode)
    counts = toks.groupBy("doc", "mult", "t").agg(F.count(F.lit(1)).alias("c"))
    stats = counts.groupBy("t").agg(F.sum(F.col("c") * F.col("mult")).alias("f"), F.max("c").alias("m"))
    m_max = stats.agg(F.max("m").alias("m_max"))

    def pair_counts(keep: DataFrame) -> DataFrame:
        sub = counts.join(keep, "t")
        own = Window.partitionBy("doc", "mult")
        sub = sub.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(own) / block).cast("int"))
        sub = sub.withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
        blocked = sub.groupBy("doc", "mult", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("t", "c"))).alias("e"))
        short = blocked.where("blocks = 1").select("mult", "e", F.col("e").alias("f"), F.lit(True).alias("same"))
        # of a long document every pair of blocks is a row of its own, dealt out over the tasks
        meets = blocked.where("blocks > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        meets = meets.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        # (grouping alone would leave them where the document is)
        two = meets.repartition("doc", "lo", "hi").groupBy("doc", "mult", "lo", "hi").agg(
            F.first(F.when(F.col("block") <= F.col("other"), F.col("e")), ignorenulls=True).alias("e"),
            F.first(F.when(F.col("block") >= F.col("other"), F.col("e")), ignorenulls=True).alias("f"))
        both = short.union(two.select("mult", "e", "f", (F.col("lo") == F.col("hi")).alias("same")))
        one = both.select("mult", "f", "same", F.posexplode("e").alias("p", "a"))
        one = one.select("mult", "a", F.explode(F.when(F.col("same"), F.slice("f", F.col("p") + 1, F.size("f"))).otherwise(F.col("f"))).alias("b"))
        a, b = F.least("a.t", "b.t"), F.greatest("a.t", "b.t")
        n = F.when(F.col("a.t") == F.col("b.t"), F.col("a.c") * (F.col("a.c") - 1) / 2).otherwise(F.col("a.c") * F.col("b.c"))
        return (one.select(a.alias("a"), b.alias("b"), (n * F.col("mult")).cast("bigint").alias("n"))
                .where(F.col("n") > 0).groupBy("a", "b").agg(F.sum("n").alias("count")))

    order = [F.col("count").desc(), F.col("a"), F.col("b")]
    seeds = stats.orderBy(F.col("f").desc(), F.col("t")).limit(seed_tokens).select("t")
    seed_top = pair_counts(seeds).orderBy(*order).limit(top)
    tau = seed_top.agg(F.when(F.count(F.lit(1)) >= top, F.min("count")).otherwise(F.lit(0)).alias("tau"))
    eligible = stats.crossJoin(F.broadcast(m_max)).crossJoin(F.broadcast(tau)) \
        .where(F.col("f") * F.col("m_max") >= F.col("tau")).select("t")
    result = pair_counts(eligible).orderBy(*order).limit(top)
    return result.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def known_vocabulary(vocab: V.Vocab = V.VOCAB) -> list[str]:
    """Every skill named in any list of the config, lower-cased and distinct."""
    return vocab.known_skills()
