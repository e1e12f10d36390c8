"""Registered queries: alert matching."""

from __future__ import annotations

from postlens import vocab as V
from postlens.operators import alerts as A
from postlens.plans import sqlgen as Q
from postlens.plans.registry import query
from postlens.sources import fixtures

_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)"


def _lst(v):
    return "NULL::VARCHAR[]" if v is None else Q.str_list(list(v))


def _alerts_sql() -> str:
    rows = ", ".join(
        f"({i}, {Q.s(n)}, {_lst(t)}, {_lst(s)}, {Q.s(loc)}, {Q.s(comp)}, "
        f"{'NULL::DOUBLE' if sal is None else f'CAST({sal!r} AS DOUBLE)'}, {Q.s(jt)})"
        for i, (n, t, s, loc, comp, sal, jt) in enumerate(V.SAMPLE_ALERTS))
    return (f"alerts AS (SELECT * FROM (VALUES {rows}) AS a(alert_order, alert_name, title_keywords, skills, "
            "location_c, company_c, min_salary, job_type_c))")


_EV = (
    "ev AS (SELECT a.alert_order, a.alert_name, p.job_id, p.title, p.company, p.location, p.description, "
    "list_filter(a.title_keywords, lambda k: contains(lower(coalesce(p.title, '')), k)) AS tk, "
    "list_filter(a.skills, lambda k: contains(lower(coalesce(p.description, '')), k)) AS sk, "
    f"CASE WHEN regexp_extract(lower(p.description), {Q.s(V.LPA_PATTERN)}, 1) <> '' "
    f"THEN CAST(regexp_extract(lower(p.description), {Q.s(V.LPA_PATTERN)}, 1) AS DOUBLE) END AS lpa, "
    "a.title_keywords, a.skills AS skills_c, a.location_c, a.company_c, a.min_salary, a.job_type_c, p.job_type "
    "FROM postings p CROSS JOIN alerts a), ")
_OK = (
    "ok AS (SELECT *, array_to_string(list_filter(["
    "CASE WHEN title_keywords IS NOT NULL THEN 'Title contains: ' || array_to_string(tk, ', ') END, "
    "CASE WHEN skills_c IS NOT NULL THEN 'Skills found: ' || array_to_string(sk, ', ') END, "
    "CASE WHEN location_c IS NOT NULL THEN 'Location: ' || coalesce(location, 'None') END, "
    "CASE WHEN company_c IS NOT NULL THEN 'Company: ' || coalesce(company, 'None') END, "
    "CASE WHEN job_type_c IS NOT NULL THEN 'Job type: ' || job_type_c END, "
    "CASE WHEN min_salary IS NOT NULL AND lpa IS NOT NULL AND lpa <> 0 THEN 'Salary: ' || CAST(lpa AS VARCHAR) || ' LPA' END"
    "], lambda x: x IS NOT NULL), '; ') AS reasons FROM ev WHERE "
    "(title_keywords IS NULL OR len(tk) > 0) AND (skills_c IS NULL OR len(sk) > 0) "
    "AND (location_c IS NULL OR contains(lower(coalesce(location, '')), location_c)) "
    "AND (company_c IS NULL OR contains(lower(coalesce(company, '')), company_c)) "
    "AND (job_type_c IS NULL OR contains(lower(coalesce(description, '')), job_type_c) "
    "OR contains(lower(coalesce(job_type, '')), job_type_c)) "
    "AND (min_salary IS NULL OR lpa IS NULL OR lpa = 0 OR lpa >= min_salary))")

_EVAL = _EV + _OK


@query("alert_matches", "G10", oracle=_P + ", " + _alerts_sql() + ", " + _EVAL + (
    " SELECT alert_name, job_id, title, company, location, reasons FROM ok"))
def q_alert_matches(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir).select("job_id", "title", "company", "location", "description", "job_type")
    return A.match_alerts(df, A.sample_alerts(), keep=["job_id", "title", "company", "location", "description",
                                                         "job_type"]).select(
        "alert_name", "job_id", "title", "company", "location", "reasons")


@query("check_alerts", "G11", oracle=_P + ", " + _alerts_sql() + ", " + _EVAL + (
    ", cnt AS (SELECT alert_name, count(*) AS match_count FROM ok GROUP BY alert_name), "
    "firsts AS (SELECT * FROM (SELECT alert_name, job_id, reasons, CAST(row_number() OVER (PARTITION BY alert_name ORDER BY "
    "job_id NULLS FIRST, title NULLS FIRST, company NULLS FIRST, location NULLS FIRST, description NULLS FIRST) AS BIGINT) AS match_rank "
    "FROM ok) WHERE match_rank <= 20) "
    "SELECT a.alert_order, a.alert_name, CAST(coalesce(c.match_count, 0) AS BIGINT) AS match_count, f.match_rank, f.job_id, f.reasons "
    "FROM alerts a LEFT JOIN cnt c USING (alert_name) LEFT JOIN firsts f USING (alert_name)"))
def q_check_alerts(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir)
    return A.check_alerts(df, A.sample_alerts())


# The alert table: every alert names a company, so the oracle tests alerts on the distinct companies first.
_T = (
    _P + ", stored AS (" + fixtures.duckdb_view("alerts") + "), "
    "alerts AS (SELECT DISTINCT alert_name, list_transform(title_keywords, lambda k: lower(k)) AS title_keywords, "
    "list_transform(skills, lambda k: lower(k)) AS skills, lower(location) AS location_c, lower(company) AS company_c, "
    "min_salary_lpa AS min_salary, lower(job_type) AS job_type_c, 0 AS alert_order FROM stored), "
    "firms AS (SELECT DISTINCT company FROM postings), "
    "near AS (SELECT f.company AS firm, a.* FROM firms f JOIN alerts a ON contains(lower(coalesce(f.company, '')), a.company_c)), "
    + _EV.replace("FROM postings p CROSS JOIN alerts a", "FROM postings p JOIN near a ON a.firm = p.company") + _OK)


@query("alert_table_matches", "G10", oracle=_T + " SELECT alert_name, job_id, title, company, location, reasons FROM ok")
def q_alert_table_matches(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir).select("job_id", "title", "company", "location", "description", "job_type")
    return A.match_alert_table(df, fixtures.alerts(spark, sf_dir), keep=["job_id", "title", "company", "location"])


@query("alert_table_checks", "G11", oracle=_T + (
    ", cnt AS (SELECT alert_name, count(*) AS match_count FROM ok GROUP BY alert_name), "
    "firsts AS (SELECT * FROM (SELECT alert_name, job_id, reasons, CAST(row_number() OVER (PARTITION BY alert_name ORDER BY "
    "job_id NULLS FIRST, title NULLS FIRST, company NULLS FIRST, location NULLS FIRST, description NULLS FIRST, reasons) AS BIGINT) AS match_rank "
    "FROM ok) WHERE match_rank <= 5) "
    "SELECT a.alert_name, CAST(coalesce(c.match_count, 0) AS BIGINT) AS match_count, f.match_rank, f.job_id, f.reasons "
    "FROM (SELECT DISTINCT alert_name FROM alerts) a LEFT JOIN cnt c USING (alert_name) LEFT JOIN firsts f USING (alert_name)"))
def q_alert_table_checks(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir).select("job_id", "title", "company", "location", "description", "job_type")
    return A.check_alert_table(df, fixtures.alerts(spark, sf_dir), first=5)
