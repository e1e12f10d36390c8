"""Registered queries: text extraction and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.text import split_list
from postlens.operators import extract as X
from postlens.plans import sqlgen as Q
from postlens.plans.registry import query
from postlens.sources import fixtures

AS_OF_YEAR = 2026  # fixed "current year" so results are reproducible
_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)"
_R = "WITH resumes AS (\n" + fixtures.duckdb_view("resumes") + "\n)"
_LOW = "lower(coalesce(description, ''))"


def _terms_sql(mode: str, variants: bool) -> str:
    return Q.dictionary_terms(_LOW, X.skill_terms(V.VOCAB, True, variants), mode)


@query("skills_in_descriptions", "C1", oracle=_P + (
    f", t AS (SELECT unnest({Q.str_list(V.VOCAB.tech_skills)}) AS skill) "
    "SELECT skill, count(*) AS count FROM postings, t WHERE description IS NOT NULL "
    "AND contains(lower(description), skill) GROUP BY skill"))
def q_skills_in_descriptions(spark, sf_dir):
    return X.substring_skill_counts(fixtures.postings(spark, sf_dir))


@query("extract_skills_boundary", "C2", oracle=_P + (
    f" SELECT job_id, array_to_string({_terms_sql('boundary', False)}, ',') AS skills FROM postings"))
def q_extract_skills_boundary(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir)
    return df.select("job_id", F.array_join(X.extract_skills_col(F.col("description"), "boundary"), ",").alias("skills"))


@query("extract_skills_lookaround", "C3", oracle=_P + (
    f" SELECT job_id, array_to_string({_terms_sql('lookaround', True)}, ',') AS skills FROM postings"))
def q_extract_skills_lookaround(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir)
    return df.select("job_id", F.array_join(X.extract_skills_col(F.col("description"), "lookaround"), ",").alias("skills"))


def _categorize_sql() -> str:
    parts = []
    for cat, members in V.VOCAB.categories:
        parts.append(f"SELECT job_id, {Q.s(cat)} AS category, list_filter(sk, lambda x: list_contains({Q.str_list(list(members))}, x)) AS m FROM b")
    return (_P + f", b AS (SELECT job_id, {_terms_sql('boundary', False)} AS sk FROM postings) "
            "SELECT job_id, category, array_to_string(m, ',') AS skills FROM (" + " UNION ALL ".join(parts) + ") WHERE len(m) > 0")


@query("categorize_skills", "C4", oracle=_categorize_sql())
def q_categorize_skills(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir).select(
        "job_id", X.extract_skills_col(F.col("description"), "boundary").alias("sk"))
    out = X.categorize_skills(df, "sk", ["job_id"])
    return out.select("job_id", "category", F.array_join("skills", ",").alias("skills"))


_SAL = "(?i)" + V.SALARY_TEXT_PATTERN


@query("salary_mentions", "C5", oracle=_P + (
    f", m AS (SELECT job_id, description AS _t, regexp_extract_all(description, {Q.s(_SAL)}, 0) AS ms FROM postings "
    "WHERE description IS NOT NULL), "
    "spans AS (SELECT job_id, _t, unnest(ms) AS span, unnest(range(len(ms))) AS pos FROM m), "
    "firsts AS (SELECT * FROM spans ORDER BY job_id NULLS FIRST, _t, pos LIMIT 20) "
    "SELECT (SELECT count(*) FROM spans) AS total_mentions, "
    "(SELECT string_agg(span, ' | ' ORDER BY job_id NULLS FIRST, _t, pos) FROM firsts) AS samples"))
def q_salary_mentions(spark, sf_dir):
    return X.salary_mentions(fixtures.postings(spark, sf_dir))


@query("salary_coverage", "C6", oracle=_P + (
    " SELECT 'salary_min' AS column, count(salary_min) AS total_with_salary, "
    "round(count(salary_min) * 100.0 / count(*), 1) AS percentage_with_salary FROM postings"))
def q_salary_coverage(spark, sf_dir):
    return X.salary_coverage(fixtures.postings(spark, sf_dir), ("salary", "salary_range", "compensation", "salary_min"))


@query("salary_lpa", "C7", oracle=_P + (
    f" SELECT job_id, CASE WHEN regexp_extract(lower(description), {Q.s(V.LPA_PATTERN)}, 1) <> '' "
    f"THEN CAST(regexp_extract(lower(description), {Q.s(V.LPA_PATTERN)}, 1) AS DOUBLE) END AS salary_lpa FROM postings"))
def q_salary_lpa(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir)
    return df.select("job_id", X.salary_lpa_col(F.col("description")).alias("salary_lpa"))


def _classes_sql(label_expr: str, labels, where: str = "") -> str:
    vals = ", ".join(f"({i}, {Q.s(l)})" for i, l in enumerate(labels))
    return (_P + f", lab AS (SELECT {label_expr} AS level FROM postings {where}), "
            f"cls AS (SELECT * FROM (VALUES {vals}) AS t(ordinal, level)) "
            "SELECT cls.ordinal, cls.level, CAST(count(lab.level) AS BIGINT) AS count FROM cls LEFT JOIN lab "
            "ON lab.level = cls.level GROUP BY cls.ordinal, cls.level")


@query("experience_levels", "C8", oracle=_classes_sql(
    Q.regex_chain("lower(description)", [(p, l) for l, p in V.EXPERIENCE_PATTERNS], "NULL"),
    [l for l, _ in V.EXPERIENCE_PATTERNS], "WHERE description IS NOT NULL"))
def q_experience_levels(spark, sf_dir):
    return X.experience_levels(fixtures.postings(spark, sf_dir))


@query("job_types_from_text", "C9", oracle=_P + " SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {Q.s(l)}, (SELECT count(*) FROM postings WHERE description IS NOT NULL AND regexp_matches(lower(description), {Q.s(p)})))"
    for i, (l, p) in enumerate(V.JOB_TYPE_PATTERNS)) + ") AS t(ordinal, job_type, count)")
def q_job_types_from_text(spark, sf_dir):
    return X.job_types_from_text(fixtures.postings(spark, sf_dir))


@query("job_types", "C9", oracle=_P + " SELECT job_type AS value, count(*) AS count FROM postings WHERE job_type IS NOT NULL GROUP BY 1")
def q_job_types(spark, sf_dir):
    from postlens.operators.demand import value_counts

    return value_counts(fixtures.postings(spark, sf_dir), "job_type")


@query("market_role_counts", "C10", oracle=_P + (
    f", lab AS (SELECT {Q.contains_chain('lower(title)', [(kw, c) for c, kw in V.MARKET_ROLE_CATEGORIES], 'NULL')} AS category "
    "FROM postings WHERE title IS NOT NULL AND title <> '') "
    "SELECT category, count(*) AS count FROM lab WHERE category IS NOT NULL GROUP BY category"))
def q_market_role_counts(spark, sf_dir):
    return X.market_role_counts(fixtures.postings(spark, sf_dir))


@query("experience_demand", "C11", oracle=_classes_sql(
    Q.contains_chain("lower(coalesce(description, '') || ' ' || coalesce(title, ''))",
                     [(kw, l) for l, kw in V.EXPERIENCE_DEMAND_KEYWORDS], "NULL"),
    [l for l, _ in V.EXPERIENCE_DEMAND_KEYWORDS]))
def q_experience_demand(spark, sf_dir):
    return X.experience_demand(fixtures.postings(spark, sf_dir))


# ---------------------------------------------------------------- résumés (DuckDB forms)

def _grad_sql(low: str) -> str:
    picks = []
    for p in V.RESUME_GRADUATION_PATTERNS:
        y = f"TRY_CAST(nullif(regexp_extract({low}, {Q.s(p)}, 1), '') AS INTEGER)"
        picks.append(f"CASE WHEN {y} BETWEEN 2000 AND {AS_OF_YEAR} THEN greatest(0, {AS_OF_YEAR} - {y}) END")
    return f"coalesce({', '.join(picks)}, 0)"


def _years_sql(low: str) -> str:
    whens = " ".join(
        f"WHEN regexp_extract({low}, {Q.s(p)}, 1) <> '' THEN CAST(regexp_extract({low}, {Q.s(p)}, 1) AS INTEGER)"
        for p in V.RESUME_EXPERIENCE_PATTERNS)
    g = _grad_sql(low)
    return (f"CAST(CASE WHEN regexp_matches({low}, {Q.s(V.RESUME_FRESHER_PATTERN)}) THEN 0 {whens} "
            f"WHEN {g} > 0 THEN {g} ELSE 0 END AS INTEGER)")


def _title_sql(low: str) -> str:
    by_len = sorted(V.RESUME_TITLES, key=len, reverse=True)
    known = " ".join(f"WHEN contains({low}, {Q.s(t)}) THEN {Q.s(t.title())}" for t in by_len)
    obj = f"regexp_extract({low}, {Q.s(V.RESUME_OBJECTIVE_PATTERN)}, 1)"
    fb = " ".join(f"WHEN contains({low}, {Q.s(k)}) THEN {Q.s(t)}" for k, t in V.RESUME_SKILL_TITLES)
    return f"CASE {known} WHEN {obj} <> '' THEN {Q.title_case(Q.strip(obj))} {fb} ELSE '' END"


def _locations_sql(low: str) -> str:
    items = [f"CASE WHEN contains({low}, {Q.s(c)}) THEN {Q.s(c.title())} END" for c in V.RESUME_CITIES]
    items.append(f"CASE WHEN contains({low}, 'remote') THEN 'Remote' END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _parsed_sql() -> str:
    low = "lower(text)"
    terms = Q.dictionary_terms(low, X.skill_terms(V.VOCAB, True, True), "lookaround")
    return (f"parsed AS (SELECT resume_id AS profile_id, {_title_sql(low)} AS title, {_years_sql(low)} AS experience_years, "
            f"{terms} AS skills, {_locations_sql(low)} AS preferred_locations FROM resumes)")


@query("parse_resumes", "C12 C13 C14 C15 C16", oracle=_R + ", " + _parsed_sql() + (
    " SELECT profile_id, title, experience_years, array_to_string(skills, ',') AS skills, "
    "array_to_string(preferred_locations, ',') AS preferred_locations FROM parsed"))
def q_parse_resumes(spark, sf_dir):
    p = X.parse_resumes(fixtures.resumes(spark, sf_dir), as_of_year=AS_OF_YEAR)
    return p.select("profile_id", "title", "experience_years", F.array_join("skills", ",").alias("skills"),
                    F.array_join("preferred_locations", ",").alias("preferred_locations"))


def stored_profiles(spark, sf_dir):
    """The ``profiles`` fixture with its comma lists split (C18 defaults applied)."""
    p = fixtures.profiles(spark, sf_dir)
    keep_case = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: F.trim(s)),
                                   lambda s: F.length(s) > 0)
    out = p.select(
        "profile_id", F.lit("").alias("name"), "title", "experience_years",
        split_list("skills").alias("skills"),
        keep_case(F.col("preferred_locations")).alias("preferred_locations"),
        keep_case(F.col("preferred_companies")).alias("preferred_companies"),
        keep_case(F.col("job_types")).alias("job_types"))
    return X.profile_defaults(out)


_STORED = ("stored AS (SELECT profile_id, title, experience_years, "
           "list_filter(list_transform(string_split(coalesce(skills, ''), ','), lambda x: lower(trim(x))), lambda x: length(x) > 0) AS skills, "
           "list_filter(list_transform(string_split(coalesce(preferred_locations, ''), ','), lambda x: trim(x)), lambda x: length(x) > 0) AS preferred_locations "
           "FROM profiles)")


@query("merge_profiles", "C17 C18", oracle=(
    "WITH resumes AS (\n" + fixtures.duckdb_view("resumes") + "\n), profiles AS (\n" + fixtures.duckdb_view("profiles")
    + "\n), " + _parsed_sql() + ", " + _STORED + (
        " SELECT coalesce(s.profile_id, p.profile_id) AS profile_id, "
        "CASE WHEN length(p.title) > 0 THEN p.title ELSE s.title END AS title, "
        "CASE WHEN p.experience_years > 0 THEN p.experience_years ELSE s.experience_years END AS experience_years, "
        "array_to_string(CASE WHEN len(p.skills) > 0 THEN p.skills ELSE s.skills END, ',') AS skills, "
        "array_to_string(CASE WHEN len(p.preferred_locations) > 0 THEN p.preferred_locations ELSE s.preferred_locations END, ',') "
        "AS preferred_locations FROM stored s FULL OUTER JOIN parsed p ON s.profile_id = p.profile_id")))
def q_merge_profiles(spark, sf_dir):
    parsed = X.parse_resumes(fixtures.resumes(spark, sf_dir), as_of_year=AS_OF_YEAR)
    merged = X.merge_profiles(stored_profiles(spark, sf_dir), parsed)
    return merged.select("profile_id", "title", "experience_years", F.array_join("skills", ",").alias("skills"),
                         F.array_join("preferred_locations", ",").alias("preferred_locations"))
