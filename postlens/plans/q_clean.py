"""Registered queries: cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators import clean as C
from postlens.plans import sqlgen as Q
from postlens.plans.registry import query
from postlens.sources import fixtures

POSTING_COLUMNS = Q.POSTING_COLUMNS


def cleaned(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """B9 over the fixture postings; duplicates resolved by every input column. ``columns``: all that the caller reads (default: everything)."""
    return C.clean_postings(fixtures.postings(spark, sf_dir), order_by=POSTING_COLUMNS, columns=columns or None)


def skills_text(col: str = "skills_normalized"):
    return F.array_join(col, ",")


_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)\n"


@query("standardize_title", "B1", oracle=_P + f"SELECT job_id, title, {Q.title_std('title')} AS title_standardized FROM postings")
def q_standardize_title(spark, sf_dir):
    return C.standardize_title(fixtures.postings(spark, sf_dir)).select("job_id", "title", "title_standardized")


@query("parse_skills", "B2 B3", oracle=_P + (
    f"SELECT job_id, skills, array_to_string({Q.parse_skills('skills')}, ',') AS skills_normalized FROM postings"))
def q_parse_skills(spark, sf_dir):
    df = C.parse_skills(fixtures.postings(spark, sf_dir))
    return df.select("job_id", "skills", skills_text().alias("skills_normalized"))


_CITY, _STATE = Q.location_cols("location")


@query("standardize_location", "B4", oracle=_P + (
    f"SELECT job_id, location, {_CITY} AS city_standardized, {_STATE} AS state_standardized FROM postings"))
def q_standardize_location(spark, sf_dir):
    df = C.standardize_location(fixtures.postings(spark, sf_dir))
    return df.select("job_id", "location", "city_standardized", "state_standardized")


@query("role_category", "B7", oracle=_P + (
    f"SELECT job_id, title_standardized, "
    f"{Q.contains_chain('lower(title_standardized)', C.V.ROLE_RULES, Q.s(C.V.ROLE_DEFAULT))} AS role_category "
    f"FROM (SELECT job_id, {Q.title_std('title')} AS title_standardized FROM postings)"))
def q_role_category(spark, sf_dir):
    df = C.standardize_title(fixtures.postings(spark, sf_dir))
    return df.select("job_id", "title_standardized", C.role_category_col(F.col("title_standardized")).alias("role_category"))


_CLEAN_COLS = ("job_id, title_standardized, company, city_standardized, state_standardized, role_category, "
               "skill_count, array_to_string(skills_normalized, ',') AS skills_normalized")


@query("clean_postings", "B5 B6 B8 B9", oracle=Q.with_cleaned() + f"SELECT {_CLEAN_COLS} FROM cleaned")
def q_clean_postings(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "job_id", "title_standardized", "company", "city_standardized", "state_standardized",
        "role_category", "skill_count", skills_text().alias("skills_normalized"))


_PLAIN = POSTING_COLUMNS + ["title_standardized", "city_standardized", "state_standardized",
                            "role_category", "skill_count"]


@query("data_quality_report", "B10", oracle=Q.with_cleaned() + (
    "SELECT count(*) AS total_records, count(DISTINCT title_standardized) AS unique_titles, "
    "count(DISTINCT company) AS unique_companies, count(DISTINCT city_standardized) AS unique_cities, "
    "round(avg(skill_count), 6) AS avg_skills_per_job, count(*) FILTER (WHERE skill_count = 0) AS jobs_with_no_skills, "
    f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_PLAIN)} FROM cleaned)) AS duplicate_count "
    "FROM cleaned"))
def q_data_quality_report(spark, sf_dir):
    out = C.data_quality_report(cleaned(spark, sf_dir))
    return out.withColumn("avg_skills_per_job", F.round("avg_skills_per_job", 6))


@query("cleaned_summary", "B11", oracle=Q.with_cleaned(
    "modes AS (SELECT role_category, count(*) AS c FROM cleaned WHERE role_category IS NOT NULL GROUP BY role_category)") + (
    "SELECT * FROM (VALUES "
    "('Total Jobs', (SELECT CAST(count(*) AS VARCHAR) FROM cleaned)), "
    "('Unique Companies', (SELECT CAST(count(DISTINCT company) AS VARCHAR) FROM cleaned)), "
    "('Unique Cities', (SELECT CAST(count(DISTINCT city_standardized) AS VARCHAR) FROM cleaned)), "
    "('Unique Job Titles', (SELECT CAST(count(DISTINCT title_standardized) AS VARCHAR) FROM cleaned)), "
    "('Average Skills per Job', (SELECT CAST(round(avg(skill_count), 2) AS VARCHAR) FROM cleaned)), "
    "('Most Common Role Category', (SELECT role_category FROM modes ORDER BY c DESC, role_category ASC LIMIT 1))"
    ") AS t(metric, value)"))
def q_cleaned_summary(spark, sf_dir):
    return C.cleaned_summary(cleaned(spark, sf_dir))


@query("content_job_ids", "A6", oracle=_P + (
    " SELECT job_id, substr(md5(coalesce(title, 'None') || '_' || coalesce(company, 'None') || '_' || "
    "coalesce(location, 'None') || '_' || strftime(posted_at, '%Y%m%d')), 1, 12) AS content_id FROM postings"))
def q_content_job_ids(spark, sf_dir):
    from postlens.sources.io import content_job_id

    df = fixtures.postings(spark, sf_dir)
    return df.select("job_id", content_job_id(day="posted_at").alias("content_id"))


_ALL = ", ".join(f"{c} ASC NULLS FIRST" for c in POSTING_COLUMNS)


@query("collect_sources", "A7", oracle=_P + (
    ", u AS (SELECT job_id, title, company, location, description, skills, posted_at, NULL::VARCHAR AS job_type, 0 AS _src "
    "FROM postings WHERE source = 'api_a' UNION ALL SELECT job_id, title, company, location, description, skills, posted_at, "
    "job_type, 1 FROM postings WHERE source = 'api_b' UNION ALL SELECT job_id, title, NULL, location, NULL, skills, posted_at, "
    "job_type, 2 FROM postings WHERE source = 'sample') "
    "SELECT job_id, title, company, location, description, skills, posted_at, job_type FROM (SELECT *, row_number() OVER "
    "(PARTITION BY job_id ORDER BY _src, posted_at NULLS FIRST, title NULLS FIRST, company NULLS FIRST, location NULLS FIRST, "
    "description NULLS FIRST, skills NULLS FIRST, job_type NULLS FIRST) AS rn FROM u) WHERE rn = 1"))
def q_collect_sources(spark, sf_dir):
    from postlens.sources.io import collect_sources

    p = fixtures.postings(spark, sf_dir)
    a = p.where(F.col("source") == "api_a").select("job_id", "title", "company", "location", "description", "skills",
                                                   "posted_at")
    b = p.where(F.col("source") == "api_b").select("job_id", "title", "company", "location", "description", "skills",
                                                   "posted_at", "job_type")
    c = p.where(F.col("source") == "sample").select("job_id", "title", "location", "skills", "posted_at", "job_type")
    out = collect_sources([a, b, c], ["posted_at", "title", "company", "location", "description", "skills", "job_type"])
    return out.select("job_id", "title", "company", "location", "description", "skills", "posted_at", "job_type")


@query("upsert_postings", "A12", oracle=_P + (
    ", u AS (SELECT *, 0 AS _gen FROM postings WHERE posted_at < TIMESTAMP '1998-01-01' "
    "UNION ALL SELECT *, 1 FROM postings WHERE posted_at >= TIMESTAMP '1998-01-01') "
    "SELECT job_id, title, company, location, posted_at, source FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY "
    "posted_at DESC NULLS LAST, _gen DESC, " + ", ".join(f"{c} DESC NULLS LAST" for c in POSTING_COLUMNS if c not in ("job_id", "posted_at"))
    + ") AS rn FROM u) WHERE rn = 1"))
def q_upsert_postings(spark, sf_dir):
    from postlens.session import shared_path
    from postlens.sources.warehouse import Warehouse

    p = fixtures.postings(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    rest = [c for c in POSTING_COLUMNS if c not in ("job_id", "posted_at")]
    warehouse = Warehouse(shared_path(spark, "warehouse"), "job_id", ["posted_at", "_gen", *rest], parts=32)
    warehouse.upsert(p.where(F.col("posted_at") < cut), "old")
    warehouse.upsert(p.where(F.col("posted_at") >= cut), "new")
    return warehouse.read(spark).select("job_id", "title", "company", "location", "posted_at", "source")


@query("job_skill_bridge", "A14", oracle=_P + (
    f" SELECT DISTINCT job_id, unnest({Q.parse_skills('skills')}) AS skill FROM postings"))
def q_job_skill_bridge(spark, sf_dir):
    from postlens.sources.io import job_skill_bridge

    return job_skill_bridge(C.parse_skills(fixtures.postings(spark, sf_dir)))
