"""Registered queries: aggregations, top-k, shares, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.operators import demand as D
from postlens.plans import sqlgen as Q
from postlens.plans.q_clean import cleaned
from postlens.plans.registry import query
from postlens.sources import fixtures

_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)"


def _top_sql(src_cte: str, expr: str, n: int, keep_null: bool = False) -> str:
    where = "" if keep_null else f"WHERE {expr} IS NOT NULL"
    return (f", c AS (SELECT {expr} AS value, count(*) AS count FROM {src_cte} {where} GROUP BY 1)\n"
            f"SELECT CAST(row_number() OVER (ORDER BY count DESC, value ASC NULLS FIRST) AS BIGINT) AS rank, value, count, "
            f"(SELECT count(value) FROM c) AS total_unique FROM c ORDER BY count DESC, value ASC NULLS FIRST LIMIT {n}")


def _register_top(name: str, op: str, column: str, n: int = 15):
    @query(name, op, oracle=_P + _top_sql("postings", column, n))
    def fn(spark, sf_dir):
        return D.top_values(fixtures.postings(spark, sf_dir), column, n)

    return fn


_register_top("top_titles", "D1", "title")
_register_top("top_companies", "D2", "company")
_register_top("top_locations", "D3", "location")


@query("top_companies_with_null", "D18", oracle=_P + _top_sql("postings", "company", 10, keep_null=True))
def q_top_companies_with_null(spark, sf_dir):
    return D.top_values(fixtures.postings(spark, sf_dir), "company", 10, keep_null=True)


_SK = "sk AS (SELECT unnest(skills_normalized) AS skill FROM cleaned), skc AS (SELECT skill, count(*) AS count FROM sk GROUP BY skill)"


@query("top_skills", "D4", oracle=Q.with_cleaned(_SK) + (
    "SELECT CAST(row_number() OVER (ORDER BY count DESC, skill) AS BIGINT) AS rank, skill, count FROM skc "
    "ORDER BY count DESC, skill LIMIT 20"))
def q_top_skills(spark, sf_dir):
    return D.top_skills(cleaned(spark, sf_dir), n=20)


_RAW = ("rs AS (SELECT unnest(list_filter(list_transform(string_split(skills, ','), lambda x: lower("
        + Q.strip("x") + ")), lambda x: length(x) > 1)) AS skill FROM postings WHERE skills IS NOT NULL), "
        "rsc AS (SELECT skill, count(*) AS count FROM rs GROUP BY skill)")


@query("top_raw_skills", "D4", oracle=_P + ", " + _RAW + (
    " SELECT CAST(row_number() OVER (ORDER BY count DESC, skill) AS BIGINT) AS rank, skill, count FROM rsc "
    "ORDER BY count DESC, skill LIMIT 100"))
def q_top_raw_skills(spark, sf_dir):
    return D.top_raw_skills(fixtures.postings(spark, sf_dir), "skills", 100)


@query("skill_share", "D5", oracle=Q.with_cleaned(_SK) + (
    "SELECT CAST(row_number() OVER (ORDER BY count DESC, skill) AS BIGINT) AS rank, skill, count, "
    "round(count * 100.0 / (SELECT count(*) FROM cleaned), 2) AS percentage FROM skc ORDER BY count DESC, skill LIMIT 30"))
def q_skill_share(spark, sf_dir):
    return D.skill_share(cleaned(spark, sf_dir), n=30)


def _share_sql(col: str) -> str:
    return (f"SELECT {col} AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM cleaned), 2) "
            f"AS percentage FROM cleaned WHERE {col} IS NOT NULL GROUP BY {col}")


@query("city_share", "D6", oracle=Q.with_cleaned() + _share_sql("city_standardized"))
def q_city_share(spark, sf_dir):
    return D.share_of_total(cleaned(spark, sf_dir), "city_standardized")


@query("role_share", "D12", oracle=Q.with_cleaned() + _share_sql("role_category"))
def q_role_share(spark, sf_dir):
    return D.share_of_total(cleaned(spark, sf_dir), "role_category")


_TOPK = ("tops AS (SELECT skill, CAST(row_number() OVER (ORDER BY count DESC, skill) AS BIGINT) AS key_rank "
         "FROM skc ORDER BY count DESC, skill LIMIT {n})")


@query("skill_city_matrix", "D7", oracle=Q.with_cleaned(_SK, _TOPK.format(n=10), (
    "pairs AS (SELECT city_standardized AS grp, s AS skill, count(*) AS count FROM "
    "(SELECT city_standardized, unnest(skills_normalized) AS s FROM cleaned) WHERE s IN (SELECT skill FROM tops) GROUP BY 1, 2)")) + (
    "SELECT t.skill, g.grp, CAST(coalesce(p.count, 0) AS BIGINT) AS count FROM (SELECT DISTINCT city_standardized AS grp FROM cleaned) g "
    "CROSS JOIN tops t LEFT JOIN pairs p ON p.grp IS NOT DISTINCT FROM g.grp AND p.skill = t.skill"))
def q_skill_city_matrix(spark, sf_dir):
    return D.skill_group_matrix(cleaned(spark, sf_dir), "city_standardized", top_n_skills=10)


@query("title_city_pivot", "D8", oracle=Q.with_cleaned(
    "tc AS (SELECT title AS value, count(*) AS count FROM cleaned WHERE title IS NOT NULL GROUP BY 1), "
    "tt AS (SELECT value FROM tc ORDER BY count DESC, value LIMIT 8), "
    "f AS (SELECT city_standardized AS grp, title FROM cleaned WHERE title IN (SELECT value FROM tt)), "
    "pairs AS (SELECT grp, title, count(*) AS count FROM f GROUP BY 1, 2)") + (
    "SELECT g.grp, t.title, CAST(coalesce(p.count, 0) AS BIGINT) AS count FROM (SELECT DISTINCT grp FROM f) g "
    "CROSS JOIN (SELECT DISTINCT title FROM pairs) t LEFT JOIN pairs p ON p.grp IS NOT DISTINCT FROM g.grp AND p.title = t.title"))
def q_title_city_pivot(spark, sf_dir):
    return D.title_group_pivot(cleaned(spark, sf_dir, "title", "city_standardized"), "title", "city_standardized", 8)


def _pct_sql(group_col: str, top_groups: int | None) -> list[str]:
    lim = f" ORDER BY grp_size DESC, grp LIMIT {top_groups}" if top_groups else ""
    return [
        _SK, _TOPK.format(n=12),
        f"sizes AS (SELECT {group_col} AS grp, count(*) AS grp_size FROM cleaned WHERE {group_col} IS NOT NULL GROUP BY 1{lim})",
        f"pairs AS (SELECT {group_col} AS grp, s AS skill, count(*) AS count FROM "
        f"(SELECT {group_col}, unnest(skills_normalized) AS s FROM cleaned) WHERE s IN (SELECT skill FROM tops) GROUP BY 1, 2)",
        "grid AS (SELECT z.grp, t.skill, t.key_rank, z.grp_size, CAST(coalesce(p.count, 0) AS BIGINT) AS count, "
        "round(coalesce(p.count, 0) * 100.0 / z.grp_size, 4) AS percentage FROM sizes z CROSS JOIN tops t "
        "LEFT JOIN pairs p ON p.grp = z.grp AND p.skill = t.skill)",
    ]


@query("skill_pct_by_city", "D9", oracle=Q.with_cleaned(*_pct_sql("city_standardized", 8)) + "SELECT * FROM grid")
def q_skill_pct_by_city(spark, sf_dir):
    return D.skill_pct_by_group(cleaned(spark, sf_dir), "city_standardized", top_groups=8, top_skills_n=12)


@query("skill_pct_by_role", "D10", oracle=Q.with_cleaned(*_pct_sql("role_category", None)) + "SELECT * FROM grid")
def q_skill_pct_by_role(spark, sf_dir):
    return D.skill_pct_by_group(cleaned(spark, sf_dir), "role_category", top_groups=None, top_skills_n=12)


def _top5_sql(group_col: str, top_groups: int | None) -> str:
    return Q.with_cleaned(*_pct_sql(group_col, top_groups)) + (
        "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY percentage DESC, key_rank) AS BIGINT) "
        "AS rank FROM grid) WHERE rank <= 5")


@query("top_skills_per_city", "D11", oracle=_top5_sql("city_standardized", 8))
def q_top_skills_per_city(spark, sf_dir):
    grid = D.skill_pct_by_group(cleaned(spark, sf_dir), "city_standardized", top_groups=8, top_skills_n=12)
    return D.top_k_per_group(grid, "grp", [F.col("percentage").desc(), F.col("key_rank")], 5)


@query("top_skills_per_role", "D11", oracle=_top5_sql("role_category", None))
def q_top_skills_per_role(spark, sf_dir):
    grid = D.skill_pct_by_group(cleaned(spark, sf_dir), "role_category", top_groups=None, top_skills_n=12)
    return D.top_k_per_group(grid, "grp", [F.col("percentage").desc(), F.col("key_rank")], 5)


@query("skills_per_posting", "D13", oracle=Q.with_cleaned(
    "st AS (SELECT avg(skill_count) AS mean, median(skill_count) AS median, "
    "CASE WHEN min(skill_count) = max(skill_count) THEN min(skill_count) - 0.5 ELSE min(skill_count) END AS lo, "
    "CASE WHEN min(skill_count) = max(skill_count) THEN max(skill_count) + 0.5 ELSE max(skill_count) END AS hi FROM cleaned)",
    "b AS (SELECT CAST(least(floor((skill_count - lo) * 15 / (hi - lo)) + 1, 15) AS BIGINT) AS bin, mean, median, lo, hi "
    "FROM cleaned CROSS JOIN st)") + (
    "SELECT bin, round(CAST(lo AS DOUBLE) + (bin - 1) * (hi - lo) / 15, 6) AS bin_start, "
    "round(CAST(lo AS DOUBLE) + bin * (hi - lo) / 15, 6) AS bin_end, count(*) AS count, round(mean, 6) AS mean, "
    "CAST(median AS DOUBLE) AS median FROM b GROUP BY bin, mean, median, lo, hi"))
def q_skills_per_posting(spark, sf_dir):
    return D.skills_per_posting(cleaned(spark, sf_dir))


def _cat_values() -> str:
    return ", ".join(f"({Q.s(c)}, {Q.s(sk)})" for c, members in V.VOCAB.categories for sk in members)


@query("category_mentions", "D14", oracle=_P + ", " + _RAW + (
    ", top AS (SELECT skill, count FROM rsc ORDER BY count DESC, skill LIMIT 100), "
    f"dim AS (SELECT * FROM (VALUES {_cat_values()}) AS t(category, skill)) "
    "SELECT category, CAST(sum(count) AS BIGINT) AS mentions FROM top JOIN dim USING (skill) GROUP BY category HAVING sum(count) > 0"))
def q_category_mentions(spark, sf_dir):
    top = D.top_raw_skills(fixtures.postings(spark, sf_dir), "skills", 100)
    return D.category_mentions(top, V.VOCAB.categories)


@query("top_company_share", "D15", oracle=_P + (
    ", c AS (SELECT company AS value, count(*) AS count FROM postings WHERE company IS NOT NULL GROUP BY 1), "
    "t AS (SELECT * FROM c ORDER BY count DESC, value LIMIT 5) "
    "SELECT CAST(row_number() OVER (ORDER BY count DESC, value) AS BIGINT) AS rank, value, count, "
    "round(count * 100.0 / (SELECT sum(count) FROM t), 4) AS share FROM t"))
def q_top_company_share(spark, sf_dir):
    return D.top_share(fixtures.postings(spark, sf_dir), "company", 5)


@query("title_bars", "D16 D17", oracle=_P + (
    ", c AS (SELECT title AS value, count(*) AS count FROM postings WHERE title IS NOT NULL GROUP BY 1), "
    "t AS (SELECT * FROM c ORDER BY count DESC, value LIMIT 8) "
    "SELECT CAST(row_number() OVER (ORDER BY count DESC, value) AS BIGINT) AS rank, value, count, "
    "round(count * 100.0 / (SELECT max(count) FROM t), 4) AS bar_pct FROM t"))
def q_title_bars(spark, sf_dir):
    return D.scaled_to_max(fixtures.postings(spark, sf_dir), "title", 8)


@query("postings_per_day", "D19", oracle=_P + (
    " SELECT CAST(posted_at AS DATE) AS day, count(*) AS count FROM postings GROUP BY 1 ORDER BY day DESC NULLS LAST LIMIT 7"))
def q_postings_per_day(spark, sf_dir):
    return D.per_day(fixtures.postings(spark, sf_dir), "posted_at", 7)


@query("job_type_distribution", "D20", oracle=_P + (
    " SELECT job_type AS value, count(*) AS count FROM postings WHERE job_type IS NOT NULL AND length(trim(job_type)) > 0 GROUP BY 1"))
def q_job_type_distribution(spark, sf_dir):
    return D.distribution(fixtures.postings(spark, sf_dir), "job_type")


@query("skill_demand_by_city", "D11 (flagship)", oracle=Q.with_cleaned(
    "sizes AS (SELECT city_standardized AS city, count(*) AS city_postings FROM cleaned GROUP BY 1)",
    "pairs AS (SELECT city_standardized AS city, s AS skill, count(*) AS count FROM "
    "(SELECT city_standardized, unnest(skills_normalized) AS s FROM cleaned) GROUP BY 1, 2)") + (
    "SELECT city, skill, count, city_postings, round(count * 100.0 / city_postings, 4) AS percentage, rank FROM ("
    "SELECT p.*, z.city_postings, CAST(row_number() OVER (PARTITION BY p.city ORDER BY p.count DESC, p.skill) AS BIGINT) AS rank "
    "FROM pairs p JOIN sizes z USING (city)) WHERE rank <= 5"))
def q_skill_demand_by_city(spark, sf_dir):
    from postlens.plans.flagship import skill_demand_by_city

    return skill_demand_by_city(cleaned(spark, sf_dir))


@query("warehouse_stats", "D18 D19", oracle=_P + (
    " SELECT 'totals' AS section, NULL::BIGINT AS rank, k AS key, v AS value FROM (VALUES "
    "('total_jobs', (SELECT count(*) FROM postings)), ('unique_companies', (SELECT count(DISTINCT company) FROM postings)), "
    "('unique_locations', (SELECT count(DISTINCT location) FROM postings))) AS t(k, v) "
    "UNION ALL SELECT * FROM (SELECT 'top_companies', CAST(row_number() OVER (ORDER BY count(*) DESC, company ASC NULLS FIRST) AS BIGINT), "
    "company, count(*) FROM postings GROUP BY company ORDER BY count(*) DESC, company ASC NULLS FIRST LIMIT 10) "
    "UNION ALL SELECT * FROM (SELECT 'top_locations', CAST(row_number() OVER (ORDER BY count(*) DESC, location ASC NULLS FIRST) AS BIGINT), "
    "location, count(*) FROM postings GROUP BY location ORDER BY count(*) DESC, location ASC NULLS FIRST LIMIT 10) "
    "UNION ALL SELECT * FROM (SELECT 'jobs_by_date', CAST(row_number() OVER (ORDER BY d DESC) AS BIGINT), CAST(d AS VARCHAR), n "
    "FROM (SELECT CAST(posted_at AS DATE) AS d, count(*) AS n FROM postings GROUP BY 1 ORDER BY d DESC NULLS LAST LIMIT 7))"))
def q_warehouse_stats(spark, sf_dir):
    return D.warehouse_stats(fixtures.postings(spark, sf_dir))
