"""Registered queries: skill NLP."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.operators import nlp as N
from postlens.plans import sqlgen as Q
from postlens.plans.registry import query
from postlens.sources import fixtures

_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)"
_DOCS = (
    "docs0 AS (SELECT list_filter(list_transform(string_split(skills, ','), lambda x: lower(" + Q.strip("x") + ")), "
    "lambda x: length(x) > 0) AS sk FROM postings WHERE skills IS NOT NULL), "
    "docs AS (SELECT array_to_string(sk, ' ') AS doc, count(*) AS mult, sk FROM docs0 WHERE len(sk) > 0 GROUP BY sk)")
_TFIDF = (
    "n AS (SELECT sum(mult) AS n FROM docs), dd AS (SELECT doc, sum(mult) AS mult FROM docs GROUP BY doc), "
    f"toks AS (SELECT doc, mult, unnest(regexp_extract_all(lower(doc), {Q.s(V.TFIDF_TOKEN_PATTERN)})) AS term FROM dd), "
    "tf AS (SELECT doc, mult, term, count(*) AS tf FROM toks GROUP BY ALL), "
    "st AS (SELECT term, sum(mult) AS df, sum(tf * mult) AS total FROM tf GROUP BY term), "
    f"voc0 AS (SELECT term, df, n FROM st, n WHERE df >= {V.TFIDF_MIN_DF} AND df <= {V.TFIDF_MAX_DF} * n "
    f"ORDER BY total DESC, term LIMIT {V.TFIDF_MAX_FEATURES}), "
    "voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM voc0), "
    "raw AS (SELECT tf.doc, tf.mult, tf.term, voc.idx, tf.tf * voc.idf AS raw FROM tf JOIN voc USING (term)), "
    "w AS (SELECT doc, mult, term, idx, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w FROM raw), "
    "mean AS (SELECT term, round(sum(w * mult) / (SELECT n FROM n) * 10000) / 10000 AS score FROM w GROUP BY term), "
    "top30 AS (SELECT term, score, CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER) AS rank FROM mean "
    "ORDER BY score DESC, term LIMIT 30)")


def _docs(spark, sf_dir):
    return N.skill_documents(fixtures.postings(spark, sf_dir))


@query("skill_summary", "E1", oracle=_P + ", " + _DOCS + (
    ", m AS (SELECT s AS skill, sum(mult) AS count FROM (SELECT unnest(sk) AS s, mult FROM docs) GROUP BY s), "
    "st AS (SELECT sum(count) AS total_skill_mentions, count(*) AS unique_skills FROM m) "
    "SELECT skill, count, CAST(row_number() OVER (ORDER BY count DESC, skill) AS INTEGER) AS rank, total_skill_mentions, unique_skills "
    "FROM m, st ORDER BY count DESC, skill LIMIT 20"))
def q_skill_summary(spark, sf_dir):
    return N.skill_summary(_docs(spark, sf_dir))


@query("tfidf_vocabulary", "E2", oracle=_P + ", " + _DOCS + ", " + _TFIDF + (
    " SELECT term, idx, df, round(idf * 1000000) / 1000000 AS idf FROM voc"))
def q_tfidf_vocabulary(spark, sf_dir):
    _, vocab, _ = N.tfidf(_docs(spark, sf_dir))
    return vocab.select("term", "idx", "df", (F.round(F.col("idf") * 1e6, 0) / 1e6).alias("idf"))


@query("tfidf_weights", "E2", oracle=_P + ", " + _DOCS + ", " + _TFIDF + (
    " SELECT md5(doc) AS doc, mult, term, round(w * 1000000) / 1000000 AS w FROM w"))
def q_tfidf_weights(spark, sf_dir):
    weights, _, _ = N.tfidf(_docs(spark, sf_dir))
    return weights.select("doc", "mult", "term", (F.round(F.col("w") * 1e6, 0) / 1e6).alias("w"))


@query("mean_tfidf", "E3", oracle=_P + ", " + _DOCS + ", " + _TFIDF + " SELECT term, score, rank FROM top30")
def q_mean_tfidf(spark, sf_dir):
    weights, _, n = N.tfidf(_docs(spark, sf_dir))
    return N.mean_tfidf(weights, n).select("term", "score", F.col("rank").cast("int").alias("rank"))


@query("emerging_skills", "E4 E5 E9", oracle=_P + ", " + _DOCS + ", " + _TFIDF + (
    ", fr AS (SELECT s AS skill, sum(mult) AS frequency FROM (SELECT unnest(sk) AS s, mult FROM docs) GROUP BY s "
    "ORDER BY frequency DESC, skill LIMIT 100), "
    f"cand AS (SELECT * FROM fr WHERE skill NOT IN (SELECT unnest({Q.str_list(V.VOCAB.known_skills())})) AND length(skill) > 1) "
    "SELECT c.skill, c.frequency, CASE WHEN (SELECT n FROM n) >= 2 THEN coalesce(t.score, 0.0) ELSE 0.0 END AS tfidf_score, "
    "CAST(row_number() OVER (ORDER BY c.frequency DESC, c.skill) AS INTEGER) AS rank "
    "FROM cand c LEFT JOIN top30 t ON t.term = c.skill ORDER BY c.frequency DESC, c.skill LIMIT 20"))
def q_emerging_skills(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    weights, _, n = N.tfidf(docs)
    out = N.emerging_skills(docs, N.mean_tfidf(weights, n))
    return out.select("skill", "frequency", "tfidf_score", F.col("rank").cast("int").alias("rank"))


@query("emerging_skills_fallback", "E5", oracle=_P + ", " + _DOCS + (
    ", fr AS (SELECT s AS skill, sum(mult) AS frequency FROM (SELECT unnest(sk) AS s, mult FROM docs) GROUP BY s "
    "ORDER BY frequency DESC, skill LIMIT 100) SELECT skill, CAST(frequency AS BIGINT) AS frequency, 0.0::DOUBLE AS tfidf_score, "
    "CAST(row_number() OVER (ORDER BY frequency DESC, skill) AS INTEGER) AS rank FROM fr "
    f"WHERE skill NOT IN (SELECT unnest({Q.str_list(V.VOCAB.known_skills())})) AND length(skill) > 1 ORDER BY frequency DESC, skill LIMIT 20"))
def q_emerging_skills_fallback(spark, sf_dir):
    out = N.emerging_skills(_docs(spark, sf_dir), None)
    return out.select("skill", "frequency", "tfidf_score", F.col("rank").cast("int").alias("rank"))


@query("term_similarity", "E6", oracle=_P + ", " + _DOCS + ", " + _TFIDF + (
    ", g AS (SELECT a.idx AS i, b.idx AS j, sum(a.w * b.w * a.mult) AS g FROM w a JOIN w b ON a.doc = b.doc AND a.idx <= b.idx "
    "GROUP BY 1, 2), d AS (SELECT i AS k, sqrt(g) AS norm FROM g WHERE i = j) "
    "SELECT va.term AS term_a, vb.term AS term_b, round(g.g / (d1.norm * d2.norm) * 1000000) / 1000000 AS sim "
    "FROM g JOIN d d1 ON d1.k = g.i JOIN d d2 ON d2.k = g.j JOIN voc va ON va.idx = g.i JOIN voc vb ON vb.idx = g.j "
    "WHERE g.i < g.j AND g.g <> 0"))
def q_term_similarity(spark, sf_dir):
    weights, vocab, _ = N.tfidf(_docs(spark, sf_dir))
    sims = N.term_similarity(weights)
    va = F.broadcast(vocab.select(F.col("idx").alias("i"), F.col("term").alias("term_a")))
    vb = F.broadcast(vocab.select(F.col("idx").alias("j"), F.col("term").alias("term_b")))
    return sims.join(va, "i").join(vb, "j").select("term_a", "term_b", (F.round(F.col("sim") * 1e6, 0) / 1e6).alias("sim"))


_CLUSTERS = (
    ", g AS (SELECT a.idx AS i, b.idx AS j, sum(a.w * b.w * a.mult) AS g FROM w a JOIN w b ON a.doc = b.doc AND a.idx <= b.idx "
    "GROUP BY 1, 2), d AS (SELECT i AS k, sqrt(g) AS norm FROM g WHERE i = j), "
    "e AS (SELECT g.i, g.j FROM g JOIN d d1 ON d1.k = g.i JOIN d d2 ON d2.k = g.j "
    f"WHERE g.i < g.j AND g.g / (d1.norm * d2.norm) >= {V.CLUSTER_THRESHOLD}), "
    "adj AS (SELECT i, list(j ORDER BY j) AS js, row_number() OVER (ORDER BY i) AS r FROM e GROUP BY i), "
    "fold AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS INTEGER[]) AS used, CAST([] AS INTEGER[]) AS members UNION ALL "
    "SELECT a.r, CASE WHEN list_contains(f.used, a.i) THEN f.used ELSE list_concat(list_concat(f.used, [a.i]), "
    "list_filter(a.js, lambda x: NOT list_contains(f.used, x))) END, CASE WHEN list_contains(f.used, a.i) THEN CAST([] AS INTEGER[]) "
    "ELSE list_concat([a.i], list_filter(a.js, lambda x: NOT list_contains(f.used, x))) END FROM fold f JOIN adj a ON a.r = f.r + 1), "
    "m AS (SELECT members[1] AS l, unnest(members) AS m, unnest(range(len(members))) AS o FROM fold WHERE len(members) > 1) "
    "SELECT vl.term AS leader, vm.term AS member, CAST(o AS INTEGER) AS member_order FROM m JOIN voc vl ON vl.idx = m.l "
    "JOIN voc vm ON vm.idx = m.m WHERE (SELECT count(*) FROM voc) >= 3")


@query("skill_clusters", "E7", oracle=(_P + ", " + _DOCS + ", " + _TFIDF + _CLUSTERS).replace("WITH postings", "WITH RECURSIVE postings", 1))
def q_skill_clusters(spark, sf_dir):
    weights, vocab, _ = N.tfidf(_docs(spark, sf_dir))
    return N.skill_clusters(N.term_similarity(weights), vocab)


_PAIRS_TOKEN = (
    ", tk AS (SELECT doc, mult, unnest(string_split_regex(trim(doc), '\\s+')) AS t, "
    "unnest(range(len(string_split_regex(trim(doc), '\\s+')))) AS p FROM (SELECT doc, sum(mult) AS mult FROM docs GROUP BY doc)), "
    "pr AS (SELECT least(a.t, b.t) AS a, greatest(a.t, b.t) AS b, sum(a.mult) AS count FROM tk a JOIN tk b ON a.doc = b.doc AND a.p < b.p "
    "GROUP BY 1, 2) "
    "SELECT a, b, CAST(count AS BIGINT) AS count, CAST(row_number() OVER (ORDER BY count DESC, a, b) AS INTEGER) AS rank FROM pr "
    "ORDER BY count DESC, a, b LIMIT 15")


@query("skill_cooccurrence", "E8", oracle=_P + ", " + _DOCS + _PAIRS_TOKEN)
def q_skill_cooccurrence(spark, sf_dir):
    out = N.cooccurrence(_docs(spark, sf_dir), mode="token")
    return out.select("a", "b", F.col("count").cast("bigint").alias("count"), F.col("rank").cast("int").alias("rank"))


@query("skill_cooccurrence_whole", "E8", oracle=_P + ", " + _DOCS + (
    ", tk AS (SELECT sk, mult, unnest(sk) AS t, unnest(range(len(sk))) AS p FROM (SELECT sk, sum(mult) AS mult FROM docs GROUP BY sk)), "
    "pr AS (SELECT least(a.t, b.t) AS a, greatest(a.t, b.t) AS b, sum(a.mult) AS count FROM tk a JOIN tk b ON a.sk = b.sk AND a.p < b.p "
    "GROUP BY 1, 2) "
    "SELECT a, b, CAST(count AS BIGINT) AS count, CAST(row_number() OVER (ORDER BY count DESC, a, b) AS INTEGER) AS rank FROM pr "
    "ORDER BY count DESC, a, b LIMIT 15"))
def q_skill_cooccurrence_whole(spark, sf_dir):
    out = N.cooccurrence(_docs(spark, sf_dir), mode="skill")
    return out.select("a", "b", F.col("count").cast("bigint").alias("count"), F.col("rank").cast("int").alias("rank"))


@query("document_term_scores", "E2 E3", oracle=(
    "WITH docs AS (SELECT text AS doc, count(*) AS mult FROM documents WHERE text IS NOT NULL GROUP BY text), "
    + _TFIDF + " SELECT term, score, rank FROM top30"))
def q_document_term_scores(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    weights, _, n = N.tfidf(d.select(F.col("text").alias("doc"), F.lit(1).cast("long").alias("mult")), fold=False)
    return N.mean_tfidf(weights, n).select("term", "score", F.col("rank").cast("int").alias("rank"))
