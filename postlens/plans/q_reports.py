"""Registered queries: full analysis, insights, reports, digest, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.operators import alerts as A
from postlens.operators import extract as X
from postlens.operators import reports as R
from postlens.operators import search as H
from postlens.operators import trends as T
from postlens.plans import sqlgen as Q
from postlens.plans.q_alerts import _EVAL, _alerts_sql
from postlens.plans.q_clean import cleaned
from postlens.plans.q_trends import _FC
from postlens.plans import q_nlp  # noqa: F401 - its oracles are parts of ours
from postlens.plans.registry import ORACLES, query
from postlens.sources import fixtures

_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)"

_EXP_CHAIN = Q.regex_chain("lower(description)", [(p, l) for l, p in V.EXPERIENCE_PATTERNS], "NULL")
_SAL = "(?i)" + V.SALARY_TEXT_PATTERN
_EXP_VALUES = ", ".join(f"({i + 1}, {Q.s(l)})" for i, (l, _) in enumerate(V.EXPERIENCE_PATTERNS))

_ANALYSIS = (
    f"x AS (SELECT title, company, location, job_type, CASE WHEN description IS NOT NULL THEN {_EXP_CHAIN} END AS experience, "
    f"len(regexp_extract_all(coalesce(description, ''), {Q.s(_SAL)})) AS _sal, description FROM postings), "
    "bk AS (SELECT 'top_titles' AS section, title AS key, count(*) AS value FROM x WHERE title IS NOT NULL GROUP BY title "
    "UNION ALL SELECT 'top_companies', company, count(*) FROM x WHERE company IS NOT NULL GROUP BY company "
    "UNION ALL SELECT 'top_locations', location, count(*) FROM x WHERE location IS NOT NULL GROUP BY location "
    "UNION ALL SELECT 'job_types', job_type, count(*) FROM x WHERE job_type IS NOT NULL GROUP BY job_type "
    "UNION ALL SELECT 'experience_levels', experience, count(*) FROM x WHERE experience IS NOT NULL GROUP BY experience), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY value DESC, key) AS rank FROM bk), "
    f"ts AS (SELECT unnest({Q.str_list(V.VOCAB.tech_skills)}) AS skill), "
    "skc AS (SELECT skill AS key, count(*) AS value FROM postings, ts WHERE description IS NOT NULL "
    "AND contains(lower(description), skill) GROUP BY skill), "
    "analysis AS ("
    "SELECT section, rank, key, value FROM rk WHERE section = 'job_types' "
    "OR (section IN ('top_titles', 'top_companies', 'top_locations') AND rank <= 15) "
    f"UNION ALL SELECT 'experience_levels', c.rank, c.key, coalesce(r.value, 0) FROM (VALUES {_EXP_VALUES}) AS c(rank, key) "
    "LEFT JOIN rk r ON r.section = 'experience_levels' AND r.key = c.key "
    "UNION ALL SELECT 'unique', NULL, regexp_replace(section, '^top_', ''), count(*) FROM bk "
    "WHERE section IN ('top_titles', 'top_companies', 'top_locations') GROUP BY section "
    "UNION ALL SELECT 'metadata', NULL, 'total_jobs', count(*) FROM x "
    "UNION ALL SELECT 'salary', NULL, 'total_mentions', CAST(coalesce(sum(_sal), 0) AS BIGINT) FROM x "
    "UNION ALL SELECT 'skills', row_number() OVER (ORDER BY value DESC, key), key, value FROM skc)")


def _analysis(spark, sf_dir):
    return R.full_analysis(fixtures.postings(spark, sf_dir))


@query("full_analysis", "D22 H5", oracle=_P + ", " + _ANALYSIS + (
    " SELECT section, CAST(rank AS BIGINT) AS rank, key, CAST(value AS BIGINT) AS value FROM analysis "
    "UNION ALL SELECT 'salary_samples', row_number() OVER (ORDER BY job_id NULLS FIRST, description, pos), span, NULL FROM (SELECT * FROM ("
    f"SELECT job_id, description, unnest(regexp_extract_all(description, {Q.s(_SAL)}, 0)) AS span, "
    f"unnest(range(len(regexp_extract_all(description, {Q.s(_SAL)}, 0)))) AS pos FROM postings WHERE description IS NOT NULL) "
    "ORDER BY job_id NULLS FIRST, description, pos LIMIT 20) "
    f"UNION ALL SELECT 'emerging', rank, skill, CAST(frequency AS BIGINT) FROM ({ORACLES['emerging_skills']}) "
    "UNION ALL SELECT 'clusters', row_number() OVER (ORDER BY leader, member_order), leader || ' > ' || member, member_order "
    f"FROM ({ORACLES['skill_clusters']}) "
    f"UNION ALL SELECT 'cooccurrence', rank, a || ' + ' || b, count FROM ({ORACLES['skill_cooccurrence']})"))
def q_full_analysis(spark, sf_dir):
    return R.full_analysis(fixtures.postings(spark, sf_dir), discover=True)


@query("analysis_overview", "H5", oracle=_P + ", " + _ANALYSIS + (
    " SELECT 'overview' AS section, key, CAST(value AS BIGINT) AS value FROM analysis WHERE section = 'metadata' "
    "OR (section = 'unique' AND key IN ('companies', 'locations')) "
    "UNION ALL SELECT 'overview', 'skills_identified', count(*) FROM analysis WHERE section = 'skills' "
    "UNION ALL SELECT section, key, CAST(value AS BIGINT) FROM analysis WHERE section IN ('experience_levels', 'job_types')"))
def q_analysis_overview(spark, sf_dir):
    return R.analysis_overview(_analysis(spark, sf_dir))


@query("analysis_top_skills", "H5", oracle=_P + ", " + _ANALYSIS + (
    " SELECT section, CAST(rank AS BIGINT) AS rank, key, CAST(value AS BIGINT) AS value FROM analysis WHERE section = 'skills' AND rank <= 10"))
def q_analysis_top_skills(spark, sf_dir):
    return H.section(_analysis(spark, sf_dir), "skills", 10)


@query("analysis_companies", "H5", oracle=_P + ", " + _ANALYSIS + (
    " SELECT section, CAST(rank AS BIGINT) AS rank, key, CAST(value AS BIGINT) AS value FROM analysis WHERE section = 'top_companies'"))
def q_analysis_companies(spark, sf_dir):
    return H.section(_analysis(spark, sf_dir), "top_companies")


@query("analysis_locations", "H5", oracle=_P + ", " + _ANALYSIS + (
    " SELECT section, CAST(rank AS BIGINT) AS rank, key, CAST(value AS BIGINT) AS value FROM analysis WHERE section = 'top_locations'"))
def q_analysis_locations(spark, sf_dir):
    return H.section(_analysis(spark, sf_dir), "top_locations")


@query("analysis_salary_column", "D22", oracle=_P + (
    " SELECT 'salary' AS section, 'total_with_salary' AS key, count(salary_min) AS value FROM postings "
    "UNION ALL SELECT 'salary_percentage', CAST(round(count(salary_min) * 100.0 / count(*), 1) AS VARCHAR), NULL FROM postings"))
def q_analysis_salary_column(spark, sf_dir):
    paid = fixtures.postings(spark, sf_dir).withColumn("salary", F.col("salary_min").cast("string"))
    return R.full_analysis(paid).where(F.col("section").startswith("salary")).select("section", "key", "value")


@query("report_rows", "J3", oracle=_P + ", " + _ANALYSIS + (
    " SELECT section, CAST(rank AS BIGINT) AS rank, CASE WHEN section = 'skills' THEN upper(key) ELSE key END AS key, "
    "CAST(value AS BIGINT) AS value FROM analysis WHERE section IN ('top_titles', 'top_companies', 'top_locations', "
    "'experience_levels', 'metadata', 'unique', 'salary') OR (section = 'skills' AND rank <= 10) "
    "OR (section = 'job_types' AND value > 0)"))
def q_report_rows(spark, sf_dir):
    return R.report_rows(_analysis(spark, sf_dir))


def _joined_sql(section: str, n: int, upper: bool = False) -> str:
    k = "upper(key)" if upper else "key"
    return (f"coalesce((SELECT string_agg({k}, ', ' ORDER BY rank) FROM analysis WHERE section = '{section}' "
            f"AND rank <= {n}), '')")


def _at(section: str, col: str) -> str:
    return f"(SELECT {col} FROM analysis WHERE section = '{section}' AND rank = 1)"


_ROLES = Q.contains_chain("lower(title)", [(kw, c) for c, kw in V.MARKET_ROLE_CATEGORIES], "NULL")
_EXPD = Q.contains_chain("lower(coalesce(description, '') || ' ' || coalesce(title, ''))",
                         [(kw, l) for l, kw in V.EXPERIENCE_DEMAND_KEYWORDS], "NULL")
_EXPD_VALUES = ", ".join(f"({i}, {Q.s(l)})" for i, (l, _) in enumerate(V.EXPERIENCE_DEMAND_KEYWORDS))


@query("market_insights", "J1", oracle=_P + ", " + _ANALYSIS + (
    f", roles AS (SELECT category, count(*) AS count FROM (SELECT {_ROLES} AS category FROM postings "
    "WHERE title IS NOT NULL AND title <> '') WHERE category IS NOT NULL GROUP BY category), "
    f"ed AS (SELECT c.ordinal, c.level, count(l.level) AS count FROM (VALUES {_EXPD_VALUES}) AS c(ordinal, level) "
    f"LEFT JOIN (SELECT {_EXPD} AS level FROM postings) l ON l.level = c.level GROUP BY c.ordinal, c.level), "
    "best AS (SELECT level, count FROM ed ORDER BY count DESC, ordinal LIMIT 1), "
    "tr AS (SELECT category, count FROM roles ORDER BY count DESC, category LIMIT 1), "
    f"v AS (SELECT {_joined_sql('skills', 5, True)} AS skills5, {_at('skills', 'value')} AS skill1, "
    f"{_joined_sql('top_locations', 3)} AS places3, {_at('top_locations', 'key')} AS place1, "
    f"{_at('top_locations', 'value')} AS place1n, (SELECT value FROM analysis WHERE section = 'unique' AND key = 'companies') AS ncomp, "
    f"{_joined_sql('top_companies', 3)} AS comp3) "
    "SELECT * FROM ("
    f"SELECT 1 AS ordinal, 'Skills' AS category, replace({Q.s(R.SKILLS_INSIGHT)}, '{{skills}}', skills5) || ' ' || "
    f"replace({Q.s(R.SKILLS_INSIGHT_2)}, '{{count}}', CAST(skill1 AS VARCHAR)) AS insight, 'high' AS importance FROM v WHERE length(skills5) > 0 "
    f"UNION ALL SELECT 2, 'Geography', replace({Q.s(R.LOCATIONS_INSIGHT)}, '{{places}}', places3) || ' ' || "
    f"replace(replace({Q.s(R.LOCATIONS_INSIGHT_2)}, '{{place}}', place1), '{{count}}', CAST(place1n AS VARCHAR)), 'medium' FROM v "
    "WHERE length(places3) > 0 "
    f"UNION ALL SELECT 3, 'Companies', replace({Q.s(R.COMPANIES_INSIGHT)}, '{{count}}', CAST(coalesce(ncomp, 0) AS VARCHAR)) || "
    f"CASE WHEN length(comp3) > 0 THEN ' ' || replace({Q.s(R.COMPANIES_INSIGHT_2)}, '{{companies}}', comp3) ELSE '' END, 'medium' FROM v "
    f"UNION ALL SELECT 4, 'Roles', replace(replace({Q.s(R.ROLES_INSIGHT)}, '{{role}}', category), '{{count}}', CAST(count AS VARCHAR)), "
    "'high' FROM tr "
    f"UNION ALL SELECT 5, 'Experience', replace(replace(replace({Q.s(R.EXPERIENCE_INSIGHT)}, '{{level}}', b.level), '{{count}}', "
    "CAST(b.count AS VARCHAR)), '{entry}', CAST((SELECT count FROM ed WHERE ordinal = 0) AS VARCHAR)), 'medium' FROM best b)"))
def q_market_insights(spark, sf_dir):
    return R.market_insights(R.full_analysis(fixtures.postings(spark, sf_dir), extras=True))


@query("recommendations", "J2", oracle=_P + ", " + _ANALYSIS + (
    f" SELECT 'Skill Development' AS title, replace({Q.s(R.SKILL_RECOMMENDATION)}, '{{skills}}', "
    f"{_joined_sql('skills', 3, True)}) AS recommendation, 'high' AS priority"))
def q_recommendations(spark, sf_dir):
    return R.recommendations(_analysis(spark, sf_dir))


@query("trend_report", "J4", oracle="WITH " + _FC + (
    ", r AS (SELECT s.*, d.date_rank FROM tops s JOIN dates d USING (snapshot_date) WHERE d.date_rank <= 2), "
    "k AS (SELECT coalesce(c.key, p.key) AS key, coalesce(c.count, 0) - coalesce(p.count, 0) AS change "
    "FROM (SELECT * FROM r WHERE date_rank = 1) c FULL OUTER JOIN (SELECT * FROM r WHERE date_rank = 2) p ON c.key = p.key), "
    "fl AS (SELECT key, arg_min(count, snapshot_date) AS f, arg_max(count, snapshot_date) AS l FROM ser GROUP BY key HAVING count(*) >= 2) "
    "SELECT 'change' AS part, key, CAST(change AS DOUBLE) AS value, CASE WHEN change > 0 THEN 'up' ELSE 'down' END AS detail FROM "
    "(SELECT * FROM k WHERE change <> 0 ORDER BY abs(change) DESC, key LIMIT 10) "
    "UNION ALL SELECT 'first_last', key, CAST(l - f AS DOUBLE), CAST(f AS VARCHAR) || ' -> ' || CAST(l AS VARCHAR) FROM fl "
    "UNION ALL SELECT 'forecast', key, predicted_count, printf('%.4f', growth_rate) FROM fc "
    "UNION ALL SELECT 'growth', key, growth_rate, CASE WHEN growth_rate > 0.1 THEN 'rising' WHEN growth_rate < -0.1 "
    "THEN 'declining' ELSE 'stable' END FROM fc"))
def q_trend_report(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string"))
    return R.trend_report(T.daily_snapshots(events, "ts", "user"))


@query("daily_digest", "J5", oracle=_P + ", " + _ANALYSIS + ", " + _alerts_sql() + ", " + _EVAL + (
    ", cnt AS (SELECT a.alert_order, a.alert_name, count(o.job_id) AS n FROM alerts a LEFT JOIN ok o USING (alert_name) "
    "GROUP BY a.alert_order, a.alert_name) "
    "SELECT section, CAST(rank AS BIGINT) AS rank, CASE WHEN section = 'skills' THEN upper(key) ELSE key END AS key, "
    "CAST(value AS BIGINT) AS value FROM analysis WHERE (section = 'metadata' AND key = 'total_jobs') "
    "OR (section = 'unique' AND key = 'companies') OR (section = 'skills' AND rank <= 5) "
    "UNION ALL SELECT 'alerts', CAST(alert_order AS BIGINT), alert_name, CAST(n AS BIGINT) FROM cnt WHERE n > 0"))
def q_daily_digest(spark, sf_dir):
    post = fixtures.postings(spark, sf_dir)
    counts = A.check_alerts(post, A.sample_alerts()).select("alert_order", "alert_name", "match_count")
    return R.digest_rows(R.full_analysis(post), counts)


@query("summary_statistics", "D21", oracle=Q.with_cleaned(
    "sk AS (SELECT unnest(skills_normalized) AS skill FROM cleaned)") + (
    "SELECT 'totals' AS section, k AS key, v AS value, NULL::DOUBLE AS pct FROM (VALUES "
    "('total_jobs', (SELECT count(*) FROM cleaned)), ('cities', (SELECT count(DISTINCT city_standardized) FROM cleaned)), "
    "('companies', (SELECT count(DISTINCT company) FROM cleaned)), ('unique_titles', (SELECT count(DISTINCT title) FROM cleaned)), "
    "('unique_skills', (SELECT count(DISTINCT skill) FROM sk))) AS t(k, v) "
    "UNION ALL SELECT 'jobs_per_city', city_standardized, count(*), round(count(*) * 100.0 / (SELECT count(*) FROM cleaned), 4) "
    "FROM cleaned WHERE city_standardized IS NOT NULL GROUP BY city_standardized "
    "UNION ALL SELECT * FROM (SELECT 'top_titles', title, count(*), NULL::DOUBLE FROM cleaned WHERE title IS NOT NULL "
    "GROUP BY title ORDER BY count(*) DESC, title LIMIT 10) "
    "UNION ALL SELECT * FROM (SELECT 'top_skills', skill, count(*), NULL::DOUBLE FROM sk GROUP BY skill "
    "ORDER BY count(*) DESC, skill LIMIT 10)"))
def q_summary_statistics(spark, sf_dir):
    return R.summary_statistics(cleaned(spark, sf_dir, "title", "company", "city_standardized", "skills_normalized"))


@query("export_summary", "D23", oracle=_P + (
    " SELECT count(*) AS total_jobs, count(DISTINCT coalesce(company, chr(0) || 'null')) AS unique_companies, "
    "count(DISTINCT coalesce(location, chr(0) || 'null')) AS unique_locations FROM postings"))
def q_export_summary(spark, sf_dir):
    post = fixtures.postings(spark, sf_dir)
    return R.export_sheets(post)["summary"]


@query("export_jobs", "D23", oracle=_P + " SELECT title, company, location, job_type FROM postings")
def q_export_jobs(spark, sf_dir):
    return R.export_sheets(fixtures.postings(spark, sf_dir))["jobs"]


@query("export_top_locations", "D23", oracle=_P + (
    " SELECT location AS key, count(*) AS count FROM postings GROUP BY location ORDER BY count DESC, key NULLS FIRST LIMIT 20"))
def q_export_top_locations(spark, sf_dir):
    return R.export_sheets(fixtures.postings(spark, sf_dir))["locations"]


@query("export_top_companies", "D23", oracle=_P + (
    " SELECT company AS key, count(*) AS count FROM postings GROUP BY company ORDER BY count DESC, key NULLS FIRST LIMIT 20"))
def q_export_top_companies(spark, sf_dir):
    post = fixtures.postings(spark, sf_dir)
    return R.export_sheets(post)["companies"]
