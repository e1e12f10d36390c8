"""Composite analysis and report tables.

The full analysis (D22) is one long frame ``(section, rank, key, value)``.
Its sections come from two aggregates, each over the columns that it reads alone:
one row of counts for what is found in descriptions (experience classes, skills,
salaries) and the totals, and counts by (section, key) for titles, companies,
locations and job types. Every report below is a filter or a small top-k over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.dictionary import MAX_CONTAINS
from postlens.functions.text import UNICODE, anchored_pattern, first_contains_label, first_regex_label, literal_array
from postlens.functions.numeric import py_round
from postlens.operators import nlp as N
from postlens.operators import trends as T
from postlens.operators.extract import substring_skill_counts, substring_skills_col
from postlens.session import cut_lineage, stored

# Report sentence templates, as worded in the reference.
SKILLS_INSIGHT = "The most in-demand skills are: {skills}."
SKILLS_INSIGHT_2 = "Python and SQL continue to dominate the market, appearing in over {count} job listings."
LOCATIONS_INSIGHT = "Top hiring locations: {places}."
LOCATIONS_INSIGHT_2 = "{place} leads with {count} open positions."
COMPANIES_INSIGHT = "{count} companies are actively hiring."
COMPANIES_INSIGHT_2 = "Top recruiters: {companies}."
ROLES_INSIGHT = "{role} roles are most in demand with {count} openings. Data and ML roles are growing rapidly."
EXPERIENCE_INSIGHT = "Most openings are for {level} ({count} jobs). Entry-level positions make up {entry} openings."
SKILL_RECOMMENDATION = "Focus on learning {skills} as these are the most sought-after skills."

SECTIONS = {"title": "top_titles", "company": "top_companies", "location": "top_locations",
            "job_type": "job_types", "experience": "experience_levels"}


EXTRA_SECTIONS = {"market_role": "market_roles", "exp_demand": "experience_demand"}


def full_analysis(postings: DataFrame, top_n: int = 15, terms: Sequence[str] = V.VOCAB.tech_skills,
                  extras: bool = False, discover: bool = False) -> DataFrame:
    """The whole analysis as (section, rank, key, value).

    Sections: top_titles / top_companies / top_locations (top N, nulls
    skipped), unique (distinct counts), job_types (all), experience_levels
    (all four classes, zeros kept), skills (all found terms), salary and metadata (total_jobs).
    Salary is total_with_salary and the percentage (as text, 1 decimal) where one of SALARY_COLUMNS is
    there, else total_mentions in descriptions. ``discover`` adds the first 20 salary samples and, from the
    ``skills`` column, emerging skills, clusters ("leader > member") and co-occurrences ("a + b").
    """
    exp_rules = [(p, l) for l, p in V.EXPERIENCE_PATTERNS]
    text_job_types = "job_type" not in postings.columns
    if text_job_types:  # no column: the six description classes, multi-label (C9)
        postings = postings.withColumn("job_type", F.lit(None).cast("string"))
    salary_col = next((c for c in SALARY_COLUMNS if c in postings.columns), None)
    staged = postings.select("title", "description",
                             (F.col(salary_col).isNotNull().cast("int") if salary_col else F.lit(0)).alias("_paid"),
                             F.lower("description").alias("_low"),
                             F.lower(F.concat(F.coalesce("description", F.lit("")), F.lit(" "),
                                              F.coalesce("title", F.lit("")))).alias("_dt"))
    x = staged.select(
        "_low", F.when(F.col("description").isNotNull(), first_regex_label(F.col("_low"), exp_rules, None)).alias("experience"),
        (F.col("_paid") if salary_col else
         F.size(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit("(?i)" + UNICODE + anchored_pattern(V.SALARY_TEXT_PATTERN)), 0)))
        .alias("_sal"),
        (first_contains_label(F.col("_dt"), [(kw, l) for l, kw in V.EXPERIENCE_DEMAND_KEYWORDS], None) if extras else F.lit(None)).alias("exp_demand"))
    # What is found in texts falls into classes known beforehand: one count per class, no row per class and posting.
    closed = [("_jobs", "", F.count(F.lit(1))), ("_salary", "", F.sum("_sal"))]
    closed += [(SECTIONS["experience"], l, F.count_if(F.col("experience") == l)) for _, l in exp_rules]
    closed += [(EXTRA_SECTIONS["exp_demand"], l, F.count_if(F.col("exp_demand") == l)) for l, _ in V.EXPERIENCE_DEMAND_KEYWORDS] if extras else []
    short = len(terms) <= MAX_CONTAINS
    closed += [("skills", t, F.count_if(F.col("_low").contains(t.lower()))) for t in sorted({t for t in terms if t})] if short else []
    cells = [F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), F.col(f"_{i}").cast("bigint").alias("value")) for i, (section, key, _) in enumerate(closed)]
    counts = x.agg(*[c.alias(f"_{i}") for i, (_, _, c) in enumerate(closed)]).select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    g = counts.where((F.col("value") > 0) | F.col("section").isin("_jobs", "_salary"))
    if not short:
        found = postings.select(F.explode(substring_skills_col(F.col("description"), terms)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("value"))
        g = g.unionByName(found.select(F.lit("skills").alias("section"), "key", "value"))
    # The fields' own values are open-ended: one narrow row per posting and field, partial sums before the shuffle.
    fields = {name: F.col(c) for c, name in SECTIONS.items() if c != "experience"}
    if extras:  # C10 market roles and C11 experience demand in the same passes (market insights)
        fields[EXTRA_SECTIONS["market_role"]] = F.when(F.col("title").isNotNull() & (F.col("title") != ""), first_contains_label(
            F.lower("title"), [(kw, c) for c, kw in V.MARKET_ROLE_CATEGORIES], None))
    rows = postings.select(F.posexplode(F.array(*[c.cast("string") for c in fields.values()])).alias("nth", "key")).where(F.col("key").isNotNull())
    own = rows.groupBy("nth", "key").agg(F.count(F.lit(1)).alias("value"))
    g = g.unionByName(own.select(F.element_at(literal_array(list(fields)), F.col("nth") + 1).alias("section"), "key", "value"))
    sections = dict(SECTIONS, **(EXTRA_SECTIONS if extras else {}))
    # Kept once in the shared folder (a row per distinct key): every section below reads it.
    g = cut_lineage(g)
    by_key = g.where(F.col("section").isin(list(sections.values()))).select("section", "key", "value")
    # Per-section rank over aggregated keys. The open-ended sections (titles,
    # companies, locations: millions of keys at scale) use a plain rank <= N
    # filter, which plans as a partial WindowGroupLimit before the shuffle; the
    # closed sections (job types, experience classes) are small by definition.
    order = Window.partitionBy("section").orderBy(F.col("value").desc(), F.col("key"))
    open_ended = ["top_titles", "top_companies", "top_locations"]
    tops_open = (by_key.where(F.col("section").isin(open_ended))
                 .withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top_n))
    ranked = (by_key.where(~F.col("section").isin(open_ended))
              .withColumn("rank", F.row_number().over(order).cast("bigint")))
    tops = tops_open.unionByName(ranked)
    exp_classes = postings.sparkSession.createDataFrame(
        [(i + 1, l) for i, (l, _) in enumerate(V.EXPERIENCE_PATTERNS)], "rank bigint, key string")
    exp = (F.broadcast(exp_classes).join(
        ranked.where(F.col("section") == "experience_levels").select("key", "value"), "key", "left")
        .select(F.lit("experience_levels").alias("section"), "rank", "key",
                F.coalesce("value", F.lit(0)).cast("bigint").alias("value")))
    tops = tops.where(F.col("section") != "experience_levels")
    uniq = by_key.where(F.col("section").isin("top_titles", "top_companies", "top_locations")).groupBy("section").agg(
        F.count(F.lit(1)).alias("value")).select(
        F.lit("unique").alias("section"), F.lit(None).cast("bigint").alias("rank"),
        F.regexp_replace("section", "^top_", "").alias("key"), "value")
    total = g.where(F.col("section").isin("_jobs", "_salary")).agg(
        F.coalesce(F.sum(F.when(F.col("section") == "_jobs", F.col("value"))), F.lit(0)).alias("value"),
        F.coalesce(F.sum(F.when(F.col("section") == "_salary", F.col("value"))), F.lit(0)).alias("_sal"))
    totals = total.select(
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("section"), F.lit("total_jobs").alias("key"), F.col("value").alias("value")),
            F.struct(F.lit("salary").alias("section"), F.lit("total_with_salary" if salary_col else "total_mentions").alias("key"),
                     F.col("_sal").alias("value")),
            *([F.struct(F.lit("salary_percentage").alias("section"),
                        py_round(F.try_divide(F.col("_sal") * 100.0, F.col("value")), 1).cast("string").alias("key"),
                        F.lit(None).cast("bigint").alias("value"))] if salary_col else []))).alias("t")).select(
        "t.section", F.lit(None).cast("bigint").alias("rank"), "t.key", "t.value")
    skills = g.where(F.col("section") == "skills").select(
        "section", F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("key"))).cast("bigint").alias("rank"), "key", "value")
    cols_out = ["section", "rank", "key", "value"]
    if text_job_types:
        from postlens.operators.extract import job_types_from_text

        jt = job_types_from_text(postings).select(
            F.lit("job_types").alias("section"), (F.col("ordinal") + 1).cast("bigint").alias("rank"),
            F.col("job_type").alias("key"), F.col("count").cast("bigint").alias("value"))
        tops = tops.where(F.col("section") != "job_types").select(*cols_out).unionByName(jt)
    out = (tops.select(*cols_out).unionByName(exp.select(*cols_out)).unionByName(uniq.select(*cols_out))
           .unionByName(totals.select(*cols_out)).unionByName(skills.select(*cols_out)))
    if discover:
        if not salary_col:
            out = out.unionByName(_salary_samples(postings))
        if "skills" in postings.columns:
            out = out.unionByName(_discovered(postings))
    return out


SALARY_COLUMNS = ("salary", "salary_range", "compensation")


def _salary_samples(postings: DataFrame) -> DataFrame:
    """The first 20 salary mentions of descriptions, by job id and place."""
    pattern = F.lit("(?i)" + UNICODE + anchored_pattern(V.SALARY_TEXT_PATTERN))
    job = F.col("job_id") if "job_id" in postings.columns else F.lit(None).cast("string")
    spans = postings.where(F.col("description").isNotNull()).select(
        job.alias("j"), F.col("description").alias("d"), F.posexplode(F.regexp_extract_all("description", pattern, 0)).alias("pos", "key"))
    order = [F.col("j").asc_nulls_first(), F.col("d"), F.col("pos")]
    first = spans.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return first.select(F.lit("salary_samples").alias("section"), "rank", "key", F.lit(None).cast("bigint").alias("value"))


def _discovered(postings: DataFrame) -> DataFrame:
    """Emerging skills, clusters and co-occurrences of the ``skills`` column; its folded lists are read once."""
    docs = stored(N.skill_documents(postings), "skills")
    weights, vocab, n = N.tfidf(docs)
    weights = stored(weights, "weights")
    emerging = N.emerging_skills(docs, N.mean_tfidf(weights, n)).select(
        F.lit("emerging").alias("section"), F.col("rank").cast("bigint").alias("rank"), F.col("skill").alias("key"), F.col("frequency").cast("bigint").alias("value"))
    clusters = N.skill_clusters(N.term_similarity(weights), vocab)
    nth = F.row_number().over(Window.orderBy("leader", "member_order")).cast("bigint")  # at most the vocabulary
    clusters = clusters.select(F.lit("clusters").alias("section"), nth.alias("rank"), F.concat_ws(" > ", "leader", "member").alias("key"),
                               F.col("member_order").cast("bigint").alias("value"))
    pairs = N.cooccurrence(docs).select(F.lit("cooccurrence").alias("section"), F.col("rank").cast("bigint").alias("rank"),
                                        F.concat_ws(" + ", "a", "b").alias("key"), F.col("count").cast("bigint").alias("value"))
    return emerging.unionByName(clusters).unionByName(pairs)


def analysis_overview(analysis: DataFrame) -> DataFrame:
    """H5: (section, key, value): totals, distinct companies and locations, skills found, experience levels and job types."""
    totals = analysis.where((F.col("section") == "metadata") | ((F.col("section") == "unique") & F.col("key").isin("companies", "locations")))
    found = analysis.where(F.col("section") == "skills").agg(F.count(F.lit(1)).alias("value"))
    rest = analysis.where(F.col("section").isin("experience_levels", "job_types"))
    return (totals.select(F.lit("overview").alias("section"), "key", "value")
            .unionByName(found.select(F.lit("overview").alias("section"), F.lit("skills_identified").alias("key"), "value"))
            .unionByName(rest.select("section", "key", "value")))


def _scalar(analysis: DataFrame, section: str, key: str) -> Column:
    return F.max(F.when((F.col("section") == section) & (F.col("key") == key), F.col("value")))


def _joined_top(analysis: DataFrame, section: str, n: int, upper: bool = False, sep: str = ", ") -> Column:
    k = F.upper(F.col("key")) if upper else F.col("key")
    cell = F.when((F.col("section") == section) & (F.col("rank") <= n), F.struct(F.col("rank"), k.alias("k")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda s: s["k"]), sep)


def _value_at(section: str, rank: int) -> Column:
    return F.max(F.when((F.col("section") == section) & (F.col("rank") == rank), F.col("value")))


def _key_at(section: str, rank: int) -> Column:
    return F.max(F.when((F.col("section") == section) & (F.col("rank") == rank), F.col("key")))


def market_insights(analysis: DataFrame, roles: DataFrame | None = None,
                    experience: DataFrame | None = None) -> DataFrame:
    """Insight rows (category, insight, importance) from the analysis frame.

    ``roles``: C10 counts; ``experience``: C11 class counts (ordinal, level, count).
    Both default to the sections of ``full_analysis(..., extras=True)``, so
    the whole report is one scan of the postings.
    """
    if roles is None:
        roles = analysis.where(F.col("section") == "market_roles").select(
            F.col("key").alias("category"), F.col("value").alias("count"))
    if experience is None:
        classes = analysis.sparkSession.createDataFrame(
            [(i, l) for i, (l, _) in enumerate(V.EXPERIENCE_DEMAND_KEYWORDS)], "ordinal int, level string")
        got = analysis.where(F.col("section") == "experience_demand").select(
            F.col("key").alias("level"), F.col("value").alias("count"))
        experience = F.broadcast(classes).join(got, "level", "left").select(
            "ordinal", "level", F.coalesce("count", F.lit(0)).alias("count"))
    a = analysis.agg(
        _joined_top(analysis, "skills", 5, upper=True).alias("skills5"), _value_at("skills", 1).alias("skill1"),
        _joined_top(analysis, "top_locations", 3).alias("places3"), _key_at("top_locations", 1).alias("place1"),
        _value_at("top_locations", 1).alias("place1n"), _scalar(analysis, "unique", "companies").alias("ncomp"),
        _joined_top(analysis, "top_companies", 3).alias("comp3"))
    top_role = roles.orderBy(F.col("count").desc(), F.col("category")).limit(1).select(
        F.col("category").alias("role"), F.col("count").alias("role_n"))
    exp_best = experience.orderBy(F.col("count").desc(), F.col("ordinal")).limit(1).select(
        F.col("level").alias("exp_level"), F.col("count").alias("exp_n"))
    entry = experience.where(F.col("ordinal") == 0).select(F.col("count").alias("entry_n"))
    row = a.crossJoin(F.broadcast(exp_best)).crossJoin(F.broadcast(entry)).join(F.broadcast(top_role), how="left")

    def fmt(template: str, **kw: Column) -> Column:
        out = F.lit(template)
        for k, v in kw.items():
            out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
        return out

    def cell(ordinal: int, category: str, insight: Column, importance: str) -> Column:
        return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(category).alias("category"),
                        insight.alias("insight"), F.lit(importance).alias("importance"))

    cells = [
        F.when(F.length("skills5") > 0, cell(
            1, "Skills", F.concat_ws(" ", fmt(SKILLS_INSIGHT, skills=F.col("skills5")),
                                     fmt(SKILLS_INSIGHT_2, count=F.col("skill1"))), "high")),
        F.when(F.length("places3") > 0, cell(
            2, "Geography", F.concat_ws(" ", fmt(LOCATIONS_INSIGHT, places=F.col("places3")),
                                        fmt(LOCATIONS_INSIGHT_2, place=F.col("place1"), count=F.col("place1n"))),
            "medium")),
        cell(3, "Companies", F.concat_ws(" ", fmt(COMPANIES_INSIGHT, count=F.coalesce("ncomp", F.lit(0))),
                                         F.when(F.length("comp3") > 0, fmt(COMPANIES_INSIGHT_2, companies=F.col("comp3")))),
             "medium"),
        F.when(F.col("role").isNotNull(), cell(
            4, "Roles", fmt(ROLES_INSIGHT, role=F.col("role"), count=F.col("role_n")), "high")),
        cell(5, "Experience", fmt(EXPERIENCE_INSIGHT, level=F.col("exp_level"), count=F.col("exp_n"),
                                  entry=F.col("entry_n")), "medium"),
    ]
    return row.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")


def recommendations(analysis: DataFrame) -> DataFrame:
    """The skill recommendation built from the top 3 skills (upper-cased)."""
    a = analysis.agg(_joined_top(analysis, "skills", 3, upper=True).alias("s"))
    return a.select(F.lit("Skill Development").alias("title"),
                    F.replace(F.lit(SKILL_RECOMMENDATION), F.lit("{skills}"), F.col("s")).alias("recommendation"),
                    F.lit("high").alias("priority"))


def report_rows(analysis: DataFrame) -> DataFrame:
    """The sections of the written report; job types only when > 0; top-10 skills."""
    keep = ((F.col("section").isin("top_titles", "top_companies", "top_locations", "experience_levels",
                                   "metadata", "unique", "salary"))
            | ((F.col("section") == "skills") & (F.col("rank") <= 10))
            | ((F.col("section") == "job_types") & (F.col("value") > 0)))
    return analysis.where(keep).withColumn(
        "key", F.when(F.col("section") == "skills", F.upper("key")).otherwise(F.col("key")))


def trend_report(snap: DataFrame) -> DataFrame:
    """(part, key, value, detail): period changes, first-last changes, forecasts and growth classes of a snapshot table."""
    ser = T.series(snap)
    fc = T.forecast(ser)
    changes = T.compare_periods(snap).where(F.col("kind") == "key").select(
        F.lit("change").alias("part"), "key", F.col("change").cast("double").alias("value"), F.col("trend").alias("detail"))
    spans = T.first_last_change(ser).select(
        F.lit("first_last").alias("part"), "key", F.col("change").cast("double").alias("value"),
        F.concat(F.col("first").cast("string"), F.lit(" -> "), F.col("last").cast("string")).alias("detail"))
    forecasts = fc.select(F.lit("forecast").alias("part"), "key", F.col("predicted_count").alias("value"),
                          F.format_string("%.4f", F.col("growth_rate")).alias("detail"))
    growth = T.growth_classes(fc).select(F.lit("growth").alias("part"), "key", F.col("growth_rate").alias("value"),
                                         F.col("growth_class").alias("detail"))
    return changes.unionByName(spans).unionByName(forecasts).unionByName(growth)


def digest_rows(analysis: DataFrame, alert_counts: DataFrame) -> DataFrame:
    """Totals, companies hiring, top-5 skills, alerts with at least one match."""
    head = analysis.where(
        ((F.col("section") == "metadata") & (F.col("key") == "total_jobs"))
        | ((F.col("section") == "unique") & (F.col("key") == "companies"))
        | ((F.col("section") == "skills") & (F.col("rank") <= 5))).select(
        "section", "rank", F.when(F.col("section") == "skills", F.upper("key")).otherwise(F.col("key")).alias("key"),
        "value")
    alerts = alert_counts.where(F.col("match_count") > 0).select(
        F.lit("alerts").alias("section"), F.col("alert_order").cast("bigint").alias("rank"),
        F.col("alert_name").alias("key"), F.col("match_count").alias("value")).distinct()
    return head.unionByName(alerts)


def summary_statistics(cleaned: DataFrame, city_col: str = "city_standardized") -> DataFrame:
    """Totals and distincts, jobs per city with %, top-10 titles and skills (section, key, value, pct).

    One pass: every posting gives a row for itself, its city, company and title and each of its skills, counted
    by (kind, key); all sections come from that frame, which is as large as the distinct keys.
    """
    item = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    fixed = F.array(item("row", F.lit(None)), item("cities", F.col(city_col)), item("companies", F.col("company")), item("unique_titles", F.col("title")))
    skills = F.transform(F.coalesce("skills_normalized", F.array().cast("array<string>")), lambda x: item("unique_skills", x))
    counts = cleaned.select(F.explode(F.concat(fixed, skills)).alias("x")).select("x.*").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("value"))
    counts = stored(counts.where((F.col("kind") == "row") | F.col("key").isNotNull()), "statistics")
    none = F.lit(None).cast("double").alias("pct")
    n = counts.where(F.col("kind") == "row").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("_n"))
    distinct = counts.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("cities", "companies", "unique_titles", "unique_skills")])
    totals = n.crossJoin(F.broadcast(distinct)).select(F.explode(F.array(*[
        F.struct(F.lit("totals").alias("section"), F.lit("total_jobs" if k == "_n" else k).alias("key"), F.col(k).cast("bigint").alias("value"))
        for k in ("_n", "cities", "companies", "unique_titles", "unique_skills")])).alias("t")).select("t.*", none)
    cities = counts.where(F.col("kind") == "cities").crossJoin(F.broadcast(n)).select(
        F.lit("jobs_per_city").alias("section"), "key", "value", F.round(F.col("value") * 100.0 / F.col("_n"), 4).alias("pct"))
    order = [F.col("value").desc(), F.col("key")]

    def top10(kind: str, section: str) -> DataFrame:
        return counts.where(F.col("kind") == kind).orderBy(*order).limit(10).select(F.lit(section).alias("section"), "key", "value", none)

    return totals.unionByName(cities).unionByName(top10("unique_titles", "top_titles")).unionByName(top10("unique_skills", "top_skills"))


def export_sheets(postings: DataFrame) -> dict[str, DataFrame]:
    """The export sheets (jobs, summary, top-10 skills, top-20 companies, top-20 locations); each runs on its own.

    Company and location counts keep null as a group, as the export does.
    """
    cols = [c for c in ("title", "company", "location", "job_type", "salary", "url") if c in postings.columns]
    order = [F.col("count").desc(), F.col("key").asc_nulls_first()]

    def top20(c):
        return (postings.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("count"))
                .orderBy(*order).limit(20))

    summary = postings.agg(F.count(F.lit(1)).alias("total_jobs"),
                           F.count_distinct(F.coalesce(F.col("company"), F.lit("\u0000null"))).alias("unique_companies"),
                           F.count_distinct(F.coalesce(F.col("location"), F.lit("\u0000null"))).alias("unique_locations"))
    by_count = [F.col("count").desc(), F.col("skill")]
    top_sk = substring_skill_counts(postings).orderBy(*by_count).limit(10)
    top_sk = top_sk.select(F.upper("skill").alias("skill"), "count", F.row_number().over(Window.orderBy(*by_count)).cast("bigint").alias("rank"))
    return {"jobs": postings.select(*cols), "summary": summary, "top_skills": top_sk,
            "companies": top20("company"), "locations": top20("location")}


def write_sections(frames: dict[str, DataFrame], path: str) -> None:
    """Each section as its own parquet folder under ``path``."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
