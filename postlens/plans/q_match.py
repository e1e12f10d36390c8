"""Registered queries: matching, gaps, learning plan, texts, semantic top-k.

The oracle SQL scores every pair of a distinct profile and a distinct job by brute force;
the Spark plans only build pairs of signatures that share a word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.operators import extract as X
from postlens.operators import match as M
from postlens.operators.semantic import semantic_top_k
from postlens.plans import sqlgen as Q
from postlens.plans.q_extract import stored_profiles
from postlens.plans.registry import query
from postlens.sources import fixtures

_PP = ("WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n), profiles AS (\n"
       + fixtures.duckdb_view("profiles") + "\n)")


def _split_keep(c: str, lower: bool) -> str:
    inner = "lower(trim(x))" if lower else "trim(x)"
    return (f"list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: {inner}), "
            "lambda x: length(x) > 0)")


_PROF = ("prof AS (SELECT profile_id, " + _split_keep("skills", True) + " AS sk, "
         "list_filter(string_split_regex(lower(coalesce(title, '')), '\\s+'), lambda x: length(x) > 0) AS tw, "
         + _split_keep("preferred_locations", False) + " AS pl, " + _split_keep("preferred_companies", False) + " AS pc, "
         + _split_keep("job_types", False) + " AS jt FROM profiles)")
_JOBS = ("jobs AS (SELECT title, company, location, description, count(*) AS n FROM postings GROUP BY ALL), "
         "kinds AS (SELECT sk, tw, pl, pc, jt, count(*) AS members FROM prof GROUP BY ALL)")
_PAIRS = (
    "pairs AS (SELECT p.sk, p.tw, p.pl, p.pc, p.jt, j.*, "
    "len(p.sk) AS n_sk, len(p.tw) AS n_tw, "
    "list_filter(p.sk, lambda s: contains(lower(coalesce(j.description, '')), lower(s)) "
    "OR contains(lower(coalesce(j.title, '')), lower(s))) AS msk, "
    "len(list_filter(p.tw, lambda w: contains(lower(coalesce(j.title, '')), w))) AS m_tw, "
    "len(p.pl) > 0 AND len(list_filter(p.pl, lambda l: contains(lower(coalesce(j.location, '')), lower(l)))) > 0 AS m_pl, "
    "len(p.pc) > 0 AND len(list_filter(p.pc, lambda c: contains(lower(coalesce(j.company, '')), lower(c)))) > 0 AS m_pc, "
    "len(p.jt) > 0 AND len(list_filter(p.jt, lambda t: contains(lower(coalesce(j.description, '')), lower(t)))) > 0 AS m_jt "
    "FROM kinds p CROSS JOIN jobs j)")
_SCORED = (
    "scored AS (SELECT *, ((((0.0 + CASE WHEN n_sk > 0 THEN len(msk) / n_sk * 40.0 ELSE 0.0 END) "
    "+ CASE WHEN n_tw > 0 THEN m_tw / n_tw * 25.0 ELSE 0.0 END) + CASE WHEN m_pl THEN 15.0 ELSE 0.0 END "
    "+ CASE WHEN m_pc THEN 10.0 ELSE 0.0 END) + CASE WHEN m_jt THEN 10.0 ELSE 0.0 END) / 100.0 * 100 AS score FROM pairs)")


_SAME = "p.sk = k.sk AND p.tw = k.tw AND p.pl = k.pl AND p.pc = k.pc AND p.jt = k.jt"


@query("match_score_summary", "G1", oracle=_PP + ", " + ", ".join([_PROF, _JOBS, _PAIRS, _SCORED]) + (
    ", k AS (SELECT sk, tw, pl, pc, jt, CAST(sum(n) AS BIGINT) AS pairs, round(max(score), 4) AS max_score, "
    "round(sum(score * n) / sum(n), 4) AS avg_score, CAST(sum(CASE WHEN score >= 40 THEN n ELSE 0 END) AS BIGINT) AS at_least_40 "
    "FROM scored WHERE score > 0 GROUP BY ALL) "
    f"SELECT profile_id, pairs, max_score, avg_score, at_least_40 FROM prof p JOIN k ON {_SAME}"))
def q_match_score_summary(spark, sf_dir):
    out = M.score_summary(fixtures.postings(spark, sf_dir), stored_profiles(spark, sf_dir), at_least=40)
    return out.select("profile_id", F.col("pairs").cast("bigint").alias("pairs"), F.round("max_score", 4).alias("max_score"),
                      F.round("avg_score", 4).alias("avg_score"), F.col("at_least").cast("bigint").alias("at_least_40"))


@query("profile_matches", "G2 G3", oracle=_PP + ", " + ", ".join([_PROF, _JOBS, _PAIRS, _SCORED]) + (
    ", rows AS (SELECT s.*, j.job_id FROM scored s JOIN postings j ON s.title IS NOT DISTINCT FROM j.title "
    "AND s.company IS NOT DISTINCT FROM j.company AND s.location IS NOT DISTINCT FROM j.location "
    "AND s.description IS NOT DISTINCT FROM j.description WHERE score >= 40), "
    "k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sk, tw, pl, pc, jt ORDER BY score DESC, job_id NULLS FIRST, "
    "title NULLS FIRST, company NULLS FIRST, location NULLS FIRST, description NULLS FIRST) AS BIGINT) AS rank FROM rows) WHERE rank <= 15) "
    "SELECT profile_id, rank, round(score * 10) / 10 AS score, job_id, title, company, location, array_to_string(msk, ', ') AS matched_skills "
    f"FROM prof p JOIN k ON {_SAME}"))
def q_profile_matches(spark, sf_dir):
    return M.match_report(M.find_matches(fixtures.postings(spark, sf_dir), stored_profiles(spark, sf_dir), min_score=40, limit=15))


_CATS = sorted({s for _, m in V.VOCAB.categories for s in m})
_MULT = ", ".join(f"({Q.s(s)}, {sum(1 for _, m in V.VOCAB.categories if s in m)})" for s in _CATS)
_MARKET = (
    f"mk AS (SELECT s AS skill, count(*) AS postings FROM postings, (SELECT unnest({Q.str_list(_CATS)}) AS s) "
    "WHERE contains(lower(coalesce(description, '') || ' ' || coalesce(title, '')), s) GROUP BY s), "
    f"market AS (SELECT mk.skill, postings * mult AS demand FROM mk JOIN (VALUES {_MULT}) AS m(skill, mult) USING (skill) "
    "ORDER BY demand DESC, skill LIMIT 30), "
    "ranked AS (SELECT *, row_number() OVER (ORDER BY demand DESC, skill) AS market_rank FROM market)")


@query("market_skill_demand", "G4", oracle=_PP + ", " + _MARKET + " SELECT skill, demand, market_rank FROM ranked")
def q_market_skill_demand(spark, sf_dir):
    return M.market_skill_demand(fixtures.postings(spark, sf_dir))


def _first_cat_sql(expr: str) -> str:
    whens = " ".join(f"WHEN list_contains({Q.str_list(list(m))}, {expr}) THEN {Q.s(c)}" for c, m in V.VOCAB.categories)
    return f"CASE {whens} END"


@query("skill_gaps", "G5", oracle=_PP + ", " + _PROF + ", " + _MARKET + (
    ", g AS (SELECT p.profile_id, r.skill, r.demand, r.market_rank, "
    "len(list_filter(p.sk, lambda us: us = r.skill OR contains(us, r.skill))) > 0 AS have FROM prof p CROSS JOIN ranked r) "
    "SELECT profile_id, skill, demand, market_rank, CASE WHEN have THEN 'have' ELSE 'learn' END AS status, "
    "CAST(row_number() OVER (PARTITION BY profile_id, have ORDER BY market_rank) AS BIGINT) AS status_rank, "
    f"CASE WHEN NOT have THEN {_first_cat_sql('skill')} END AS category, "
    "round(sum(CAST(have AS INTEGER)) OVER (PARTITION BY profile_id) * 100.0 / count(*) OVER (PARTITION BY profile_id) * 10) / 10 "
    "AS coverage_percent FROM g"))
def q_skill_gaps(spark, sf_dir):
    market = M.market_skill_demand(fixtures.postings(spark, sf_dir))
    return M.skill_gaps(stored_profiles(spark, sf_dir), market)


def _cert_sql(expr: str) -> str:
    whens = " ".join(f"WHEN contains(lower({expr}), {Q.s(k)}) THEN {Q.s(n)}" for k, n in V.CERTIFICATIONS)
    return f"CASE {whens} END"


@query("learning_plan", "G6 G7", oracle=_PP + ", " + _PROF + (
    f", t AS (SELECT unnest({Q.str_list(V.VOCAB.tech_skills)}) AS skill), "
    "mc AS (SELECT skill, count(*) AS count FROM postings, t WHERE description IS NOT NULL AND contains(lower(description), skill) GROUP BY skill), "
    "miss AS (SELECT p.profile_id, m.skill, m.count, row_number() OVER (PARTITION BY p.profile_id ORDER BY m.count DESC, m.skill) AS r "
    "FROM prof p CROSS JOIN mc m WHERE NOT list_contains(p.sk, lower(m.skill))), "
    f"top AS (SELECT *, {_cert_sql('skill')} AS cert FROM miss WHERE r <= 10), "
    "certs AS (SELECT profile_id, cert, row_number() OVER (PARTITION BY profile_id ORDER BY r) AS cr FROM top WHERE cert IS NOT NULL) "
    "SELECT p.profile_id, coalesce((SELECT string_agg(skill || ':' || count, ',' ORDER BY r) FROM top WHERE top.profile_id = p.profile_id), '') AS to_learn, "
    "coalesce((SELECT string_agg(cert, ' | ' ORDER BY cr) FROM certs WHERE certs.profile_id = p.profile_id AND cr <= 3), '') AS certifications "
    "FROM prof p"))
def q_learning_plan(spark, sf_dir):
    counts = X.substring_skill_counts(fixtures.postings(spark, sf_dir))
    plan = M.learning_plan(stored_profiles(spark, sf_dir), counts)
    return plan.select(
        "profile_id",
        F.array_join(F.transform("to_learn", lambda m: F.concat(m["skill"], F.lit(":"), m["demand"].cast("string"))), ",")
        .alias("to_learn"),
        F.array_join("certifications", " | ").alias("certifications"))


@query("profile_texts", "G8", oracle=_PP + ", " + _PROF + (
    ", st AS (SELECT p.profile_id, pr.title, pr.experience_years, p.sk, p.pl FROM prof p JOIN profiles pr USING (profile_id)) "
    "SELECT profile_id, CASE WHEN t = '' THEN 'software engineer' ELSE t END AS text FROM (SELECT profile_id, "
    "array_to_string(list_filter([CASE WHEN length(coalesce(title, '')) > 0 THEN 'Job title: ' || title END, "
    "CASE WHEN len(sk) > 0 THEN 'Skills: ' || array_to_string(sk, ', ') END, "
    "CASE WHEN len(pl) > 0 THEN 'Location: ' || array_to_string(pl, ', ') END, "
    "CASE WHEN coalesce(experience_years, 0) <> 0 THEN CAST(experience_years AS VARCHAR) || ' years of experience' END], "
    "lambda x: x IS NOT NULL), '. ') AS t FROM st)"))
def q_profile_texts(spark, sf_dir):
    p = stored_profiles(spark, sf_dir)
    return p.select("profile_id", M.profile_text(p).alias("text"))


@query("job_texts", "G8", oracle=_PP + (
    " SELECT job_id, array_to_string(list_filter([CASE WHEN length(coalesce(title, '')) > 0 THEN title END, "
    "CASE WHEN length(coalesce(company, '')) > 0 THEN 'at ' || company END, "
    "CASE WHEN length(coalesce(location, '')) > 0 THEN 'in ' || location END, "
    "CASE WHEN length(coalesce(description, '')) > 0 THEN substr(description, 1, 500) "
    "WHEN length(coalesce(skills, '')) > 0 THEN 'Skills: ' || skills END], lambda x: x IS NOT NULL), ' ') AS text FROM postings"))
def q_job_texts(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir)
    return df.select("job_id", M.job_text(df).alias("text"))


@query("semantic_matches", "G9", oracle=(
    "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0), "
    "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS ev FROM embeddings), "
    "s AS (SELECT query_id, vec_id, label, list_reduce(list_transform(list_zip(ev, qv), lambda z: z[1] * z[2]), lambda a, b: a + b) / "
    "((sqrt(list_reduce(list_transform(ev, lambda x: x * x), lambda a, b: a + b)) + 1e-10) * "
    "(sqrt(list_reduce(list_transform(qv, lambda x: x * x), lambda a, b: a + b)) + 1e-10)) AS sim FROM v, q WHERE vec_id <> query_id) "
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS BIGINT) AS rank, vec_id, label, "
    "round(greatest(0.0, least(100.0, sim * 100)) * 10) / 10 AS score FROM s QUALIFY rank <= 15"))
def q_semantic_matches(spark, sf_dir):
    emb = fixtures.table(spark, sf_dir, "embeddings")
    asked = emb.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return semantic_top_k(emb, asked, query_id="query_id", exclude_self=True)
