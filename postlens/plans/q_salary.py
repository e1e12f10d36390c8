"""Registered queries: salary roles, features, heuristic, model, market."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.operators import salary as S
from postlens.plans import sqlgen as Q
from postlens.plans.registry import query
from postlens.sources import fixtures

_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)"


def _role_sql(title: str = "title") -> str:
    low = f"lower(trim(coalesce({title}, '')))"
    rules = [((r,), r) for r, _, _ in V.SALARY_BASE] + [(tuple(k), r) for k, r in V.SALARY_ROLE_FALLBACKS]
    return Q.contains_chain(low, rules, Q.s(V.SALARY_ROLE_DEFAULT), all_of=True)


def _level_sql(title: str = "title") -> str:
    low = f"lower(coalesce({title}, ''))"
    whens = " ".join(f"WHEN {Q.any_contains(low, keys)} THEN {lvl}" for lvl, keys in V.EXPERIENCE_LEVEL_KEYWORDS)
    return f"CASE {whens} ELSE {V.EXPERIENCE_LEVEL_DEFAULT} END"


_INPUTS = (
    f"inp AS (SELECT *, {_role_sql()} AS role, trim(split_part(lower(coalesce(location, '')), ',', 1)) AS city_key, "
    f"company_size AS size_key, {Q.split_list('skills')} AS skill_list, {_level_sql()} AS experience_level FROM postings)")

_PREMIUM = f"len(list_filter(skill_list, lambda x: list_contains({Q.str_list(V.PREMIUM_SKILLS)}, x)))"


def _heuristic_ctes() -> str:
    lo = Q.lookup("role", [(r, float(a)) for r, a, _ in V.SALARY_BASE], "CAST(6.0 AS DOUBLE)")
    hi = Q.lookup("role", [(r, float(b)) for r, _, b in V.SALARY_BASE], "CAST(15.0 AS DOUBLE)")
    loc = Q.lookup("city_key", V.LOCATION_MULTIPLIERS, "CAST(1.0 AS DOUBLE)")
    size = Q.lookup("size_key", V.COMPANY_SIZE_MULTIPLIERS, "CAST(1.0 AS DOUBLE)")
    exp = ("CASE experience_level " + " ".join(f"WHEN {k} THEN CAST({m!r} AS DOUBLE)" for k, m in V.EXPERIENCE_MULTIPLIERS)
           + " ELSE CAST(1.0 AS DOUBLE) END")
    bonus = f"(CAST(1.0 AS DOUBLE) + {_PREMIUM} * CAST({V.SKILL_PREMIUM_PER_SKILL!r} AS DOUBLE))"
    return (_INPUTS + ", "
            f"fac AS (SELECT *, {lo} AS b_lo, {hi} AS b_hi, {loc} AS m_loc, {size} AS m_size, {bonus} AS m_bonus, "
            f"{exp} AS m_exp FROM inp), "
            "heur AS (SELECT *, round(b_lo * m_loc * m_size * m_exp, 2) AS salary_min_pred, "
            "round(b_hi * m_loc * m_size * m_bonus * m_exp, 2) AS salary_max_pred, "
            "round((b_lo + b_hi) / 2 * m_loc * m_size * m_bonus * m_exp, 2) AS salary_avg_pred FROM fac)")


@query("salary_role", "B12 B13 B15", oracle=_P + ", " + _INPUTS + " SELECT job_id, title, role, city_key, experience_level FROM inp")
def q_salary_role(spark, sf_dir):
    df = S.with_salary_inputs(fixtures.postings(spark, sf_dir))
    return df.select("job_id", "title", "role", "city_key", "experience_level")


@query("salary_training_set", "B14 B16 B18", oracle=_P + (
    ", t AS (SELECT *, CAST(CASE WHEN coalesce(salary_min, 0) <> 0 AND coalesce(salary_max, 0) <> 0 THEN (salary_min + salary_max) / 2 "
    "WHEN coalesce(salary_min, 0) <> 0 THEN salary_min WHEN coalesce(salary_max, 0) <> 0 THEN salary_max END AS DOUBLE) AS target FROM postings) "
    f"SELECT job_id, target, array_to_string({Q.split_list('skills')}, ',') AS skill_list FROM t WHERE target > 0"))
def q_salary_training_set(spark, sf_dir):
    df = S.training_rows(fixtures.postings(spark, sf_dir))
    return df.select("job_id", "target", F.array_join(S.plain_skills_col(F.col("skills")), ",").alias("skill_list"))


def _enc_sql(key: str, out: str) -> str:
    return (f"LEFT JOIN (SELECT {key} AS k, CAST(dense_rank() OVER (ORDER BY {key}) - 1 AS INTEGER) AS pos "
            f"FROM (SELECT DISTINCT {key} FROM tr WHERE {key} IS NOT NULL)) {out} ON {out}.k IS NOT DISTINCT FROM i.{key}")


@query("salary_features", "B17 F2", oracle=_P + ", " + _INPUTS + (
    ", tr AS (SELECT * FROM inp WHERE CASE WHEN coalesce(salary_min, 0) <> 0 AND coalesce(salary_max, 0) <> 0 "
    "THEN (salary_min + salary_max) / 2 WHEN coalesce(salary_min, 0) <> 0 THEN salary_min "
    "WHEN coalesce(salary_max, 0) <> 0 THEN salary_max END > 0) "
    "SELECT i.job_id, coalesce(te.pos, -1) AS title_encoded, coalesce(le.pos, -1) AS location_encoded, "
    "coalesce(se.pos, -1) AS company_size_encoded, CAST(len(i.skill_list) AS INTEGER) AS skill_count, "
    f"CAST(len(list_filter(i.skill_list, lambda x: list_contains({Q.str_list(V.PREMIUM_SKILLS)}, x))) AS INTEGER) AS premium_skill_count, "
    "i.experience_level FROM inp i " + _enc_sql("role", "te") + " " + _enc_sql("city_key", "le") + " "
    + _enc_sql("size_key", "se")))
def q_salary_features(spark, sf_dir):
    post = fixtures.postings(spark, sf_dir)
    train = S.training_rows(post)
    feats = S.build_features(post, train)
    return feats.select("job_id", *S.FEATURES)


@query("heuristic_salary", "F1 F6", oracle=_P + ", " + _heuristic_ctes() + (
    " SELECT job_id, role, salary_min_pred, salary_max_pred, salary_avg_pred, 'heuristic' AS method FROM heur"))
def q_heuristic_salary(spark, sf_dir):
    out = S.predict(fixtures.postings(spark, sf_dir))
    return out.select("job_id", "role", "salary_min_pred", "salary_max_pred", "salary_avg_pred", "method")


@query("salary_market", "D24", oracle=_P + ", " + _heuristic_ctes() + (
    " SELECT CASE WHEN grouping(role, city_key) = 1 THEN 'role' WHEN grouping(role, city_key) = 2 THEN 'location' "
    "ELSE 'overall' END AS level, role, city_key, round(avg(salary_avg_pred), 2) AS avg, round(min(salary_avg_pred), 2) AS min, "
    "round(max(salary_avg_pred), 2) AS max, count(*) AS count FROM heur GROUP BY GROUPING SETS ((role), (city_key), ())"))
def q_salary_market(spark, sf_dir):
    return S.salary_market(S.predict(fixtures.postings(spark, sf_dir)))


@query("salary_model_predictions", "F3 F4 F5 F7")
def q_salary_model_predictions(spark, sf_dir):
    """GBT trained on the labelled postings, predictions for every posting (rows-only check)."""
    post = fixtures.postings(spark, sf_dir)
    model, train, _ = S.train_model(post)
    return S.predict(post, model, train).select("job_id", "role", "salary_min_pred", "salary_max_pred",
                                                "salary_avg_pred", "confidence", "method")


@query("salary_synthetic_labels", "F3", oracle=_P + ", " + _heuristic_ctes() + (
    " SELECT job_id, round(salary_avg_pred * (0.9 + CAST(('0x' || substr(md5(concat_ws('|', '42', coalesce(job_id, ''), coalesce(title, ''), "
    "coalesce(company, ''), coalesce(location, ''))), 1, 8)) AS UBIGINT) / 4294967296.0 * 0.2), 2) AS target FROM heur"))
def q_salary_synthetic_labels(spark, sf_dir):
    return S.synthetic_labels(fixtures.postings(spark, sf_dir)).select("job_id", "target")


@query("salary_prediction_columns", "F5", oracle=_P + (
    ", t AS (SELECT job_id, (salary_min - 9.0) / 3 AS raw FROM postings WHERE salary_min IS NOT NULL), "
    "a AS (SELECT job_id, greatest(raw, 1.0) AS avg, greatest(greatest(raw, 1.0) * 0.15, 2.0) AS spread FROM t) "
    "SELECT job_id, round(avg - spread, 2) AS salary_min_pred, round(avg + spread, 2) AS salary_max_pred, round(avg, 2) AS salary_avg_pred, "
    "CASE WHEN avg > 3 THEN 'high' ELSE 'medium' END AS confidence, 'ml_model' AS method FROM a"))
def q_salary_prediction_columns(spark, sf_dir):
    """What is made of a raw prediction (here a line through the salaries, from below 1 to over 3)."""
    raw = fixtures.postings(spark, sf_dir).where(F.col("salary_min").isNotNull()).select("job_id", ((F.col("salary_min") - 9.0) / 3).alias("raw"))
    return raw.select("job_id", *S.prediction_columns(F.col("raw")))


@query("salary_model_summary", "F4", oracle=_P + (
    " SELECT 'ml' AS mode, count(*) AS samples, true AS better_than_mean FROM postings WHERE CASE WHEN coalesce(salary_min, 0) <> 0 "
    "AND coalesce(salary_max, 0) <> 0 THEN (salary_min + salary_max) / 2 WHEN coalesce(salary_min, 0) <> 0 THEN salary_min "
    "WHEN coalesce(salary_max, 0) <> 0 THEN salary_max END > 0"))
def q_salary_model_summary(spark, sf_dir):
    """The trained model in one row: rows used, and whether its error is below that of the mean."""
    _, _, m = S.train_model(fixtures.postings(spark, sf_dir))
    return spark.createDataFrame([(m["mode"], m["samples"], m["mae_lpa"] < m["mae_of_mean"])], "mode string, samples long, better_than_mean boolean")
