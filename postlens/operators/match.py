"""Profile-to-job matching, skill gaps, learning suggestions (G1-G8; G9 is in semantic.py).

A score depends only on what a profile lists and on which of those words the job's fields
contain. So work is done per distinct value, not per row:

1. profiles with equal lists are one signature;
2. every distinct field value is looked up once, by :mod:`postlens.functions.needles`. The
   words are a stored table, broadcast only if its bytes are below Spark's threshold;
3. jobs whose fields contain the same words are one signature with a count;
4. signatures that share a word are scored once;
5. for the best ``limit`` jobs, a profile signature keeps the job signatures down to the
   score at which the counts reach ``limit`` (ties kept), and only those meet the jobs' rows.

Pairs without a shared word score 0 and are added only where ``min_score`` allows 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.dictionary import match_terms
from postlens.functions.needles import found_needles, lowered
from postlens.functions.numeric import py_round
from postlens.functions.text import literal_array
from postlens.session import stored

JOB_FIELDS = ("title", "description", "location", "company")
JOB_COLS = ("job_id", "title", "company", "location", "description", "job_type")
TIE_COLS = ("job_id", "title", "company", "location", "description")
# Score part -> posting fields its needles are looked up in.
PART_FIELDS = {
    "skills": ("description", "title"),
    "title": ("title",),
    "location": ("location",),
    "company": ("company",),
    "job_type": ("description",),
}


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def profile_signatures(profiles: DataFrame) -> DataFrame:
    """profile_id, ps and the lists that a score depends on (``ps`` is a digest of them)."""
    words = F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) > 0)
    out = profiles.select("profile_id", _list("skills").alias("skills"), words.alias("words"),
                          _list("preferred_locations").alias("locations"), _list("preferred_companies").alias("companies"),
                          _list("job_types").alias("types"))
    lists = ("skills", "words", "locations", "companies", "types")
    return out.withColumn("ps", F.md5(F.to_json(F.struct(*lists))))


_PARTS = {"skills": "skills", "title": "words", "location": "locations", "company": "companies", "job_type": "types"}


def _needles(signatures: DataFrame) -> DataFrame:
    """(ps, part, needle, field): every non-empty list item, lower-cased, per field that it is looked up in."""
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("items"), literal_array(list(PART_FIELDS[p])).alias("fields"))
                      for p, c in _PARTS.items()])
    per = signatures.select("ps", F.explode(parts).alias("p")).select("ps", "p.part", "p.fields", F.explode("p.items").alias("item"))
    return per.select("ps", "part", F.lower("item").alias("needle"), F.explode("fields").alias("field")).where(F.length("needle") > 0)


def job_signatures(postings: DataFrame, needles: DataFrame, job_cols: Sequence[str] = JOB_COLS) -> tuple[DataFrame, DataFrame]:
    """(js and the job columns) of every job, and (js, n, in_<field>...) of every signature: its jobs and the needles found in each field.

    Lists of needles are digested once per distinct value; a job carries the digest ``js`` of its four digests.
    """
    job_cols = [c for c in job_cols if c in postings.columns]
    found = stored(found_needles(postings, JOB_FIELDS, needles).withColumn("list", F.md5(F.to_json("found"))), "evidence")
    out = postings.select(*job_cols, *[F.md5(lowered(f)).alias(f"_key_{f}") for f in JOB_FIELDS])
    for f in JOB_FIELDS:
        own = found.where(F.col("field") == f).select(F.col("vkey").alias("_k"), F.col("list").alias(f"_list_{f}"))
        out = out.join(own, F.col(f"_key_{f}") == F.col("_k"), "left").drop(f"_key_{f}", "_k").withColumn(f"_list_{f}", F.coalesce(f"_list_{f}", F.lit("")))
    lists = [f"_list_{f}" for f in JOB_FIELDS]
    jobs = stored(out.select(*job_cols, *lists, F.md5(F.concat_ws("|", *lists)).alias("js")), "jobs")
    sets = jobs.groupBy("js", *lists).agg(F.count(F.lit(1)).alias("n"))
    known = found.select("field", "list", "found").distinct()
    for f in JOB_FIELDS:
        own = known.where(F.col("field") == f).select(F.col("list").alias(f"_list_{f}"), F.col("found").alias(f"in_{f}"))
        sets = sets.join(own, f"_list_{f}", "left").withColumn(f"in_{f}", F.coalesce(f"in_{f}", F.array().cast("array<string>")))
    return jobs.drop(*lists), stored(sets.drop(*lists), "sets")


def _scored(signatures: DataFrame, sets: DataFrame, needles: DataFrame, weights) -> DataFrame:
    """(ps, js, score, parts, matched skills) of all pairs of signatures that share a needle."""
    per_set = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"in_{f}").alias("needles")) for f in JOB_FIELDS]))
    in_sets = sets.select("js", per_set.alias("x")).select("js", "x.field", F.explode("x.needles").alias("needle"))
    pairs = in_sets.join(needles.select("ps", "needle", "field").distinct(), ["needle", "field"]).select("ps", "js").distinct()
    j = pairs.join(signatures, "ps").join(sets.drop("n"), "js")

    def hits(items: str, *fields: str) -> Column:
        def within(x):
            cond = F.lit(False)
            for f in fields:
                cond = cond | F.array_contains(F.col(f"in_{f}"), F.lower(x))
            return cond
        return F.filter(items, within)

    w_sk, w_ti, w_lo, w_co, w_jt = weights
    matched = hits("skills", "description", "title")
    share = lambda found, items, w: F.when(F.size(items) > 0, F.size(found) / F.size(items) * w).otherwise(0.0)
    flag = lambda found, w: F.when(F.size(found) > 0, F.lit(w)).otherwise(0.0)
    s = j.select("ps", "js", share(matched, "skills", w_sk).alias("skills_score"), share(hits("words", "title"), "words", w_ti).alias("title_score"),
                 flag(hits("locations", "location"), w_lo).alias("location_score"), flag(hits("companies", "company"), w_co).alias("company_score"),
                 flag(hits("types", "description"), w_jt).alias("job_type_score"), matched.alias("matched_skills"))
    total = (((F.lit(0.0) + F.col("skills_score")) + F.col("title_score")) + F.col("location_score") + F.col("company_score")) + F.col("job_type_score")
    return s.withColumn("score", total / float(sum(weights)) * 100)


class Scores:
    """Signatures of profiles and jobs, and the scores of those pairs that share a word."""

    def __init__(self, postings: DataFrame, profiles: DataFrame, weights=V.MATCH_WEIGHTS, job_cols: Sequence[str] = JOB_COLS):
        self.job_cols = [c for c in job_cols if c in postings.columns]
        self.profiles = stored(profile_signatures(profiles), "profiles")
        self.signatures = self.profiles.drop("profile_id").dropDuplicates(["ps"])
        needles = stored(_needles(self.signatures), "words")
        self.jobs, self.sets = job_signatures(postings, needles, self.job_cols)
        self.scored = _scored(self.signatures, self.sets, needles, weights).join(self.sets.select("js", "n"), "js")

    def rows(self) -> DataFrame:
        """G1: (profile_id, job columns, score, parts, matched skills) of every pair that shares a word."""
        out = self.scored.drop("n").join(self.profiles.select("profile_id", "ps"), "ps").join(self.jobs.select("js", *self.job_cols), "js")
        return out.select("profile_id", *self.job_cols, *[c for c in self.scored.columns if c not in ("ps", "js", "n")])


def match_scores(postings: DataFrame, profiles: DataFrame, weights=V.MATCH_WEIGHTS, job_cols: Sequence[str] = JOB_COLS) -> DataFrame:
    """G1: the scored pairs as rows (see :class:`Scores`). Top lists should use :func:`find_matches`."""
    return Scores(postings, profiles, weights, job_cols).rows()


def score_summary(postings: DataFrame, profiles: DataFrame, at_least: float = 40.0, weights=V.MATCH_WEIGHTS) -> DataFrame:
    """G1 per profile: pairs above 0, largest and mean score, pairs of ``at_least`` or more; from signatures alone."""
    s = Scores(postings, profiles, weights)
    own = s.scored.where(F.col("score") > 0).groupBy("ps").agg(
        F.sum("n").alias("pairs"), F.max("score").alias("max_score"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("avg_score"),
        F.sum(F.when(F.col("score") >= at_least, F.col("n")).otherwise(0)).alias("at_least"))
    return s.profiles.select("profile_id", "ps").join(own, "ps").drop("ps")


def find_matches(postings: DataFrame, profiles: DataFrame, min_score: float = 50.0, limit: int = 20, weights=V.MATCH_WEIGHTS,
                 job_cols: Sequence[str] = JOB_COLS, tie_cols: Sequence[str] = TIE_COLS) -> DataFrame:
    """Jobs with score >= min_score, best first, ties by ``tie_cols``, at most ``limit`` per profile.

    A ``min_score`` of 0 or less also admits pairs that share nothing. They rank last, so only a profile with
    fewer than ``limit`` scored jobs takes them, from the first 2 * limit jobs in tie order.
    """
    s = Scores(postings, profiles, weights, job_cols)
    ties = [F.col(c).asc_nulls_first() for c in tie_cols if c in s.job_cols]
    # job signatures that can reach the list: those above which fewer than ``limit`` jobs stand
    better = Window.partitionBy("ps").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ok = s.scored.where(F.col("score") >= min_score)
    ok = ok.withColumn("upto", F.sum("n").over(better)).withColumn("above", F.col("upto") - F.sum("n").over(Window.partitionBy("ps", "score")))
    ok = stored(ok.where(F.col("above") < limit).drop("upto", "above", "n"), "best")
    first = s.jobs.join(ok.select("js").distinct(), "js", "left_semi").select("js", *s.job_cols, F.row_number().over(Window.partitionBy("js").orderBy(*ties)).alias("nth")).where(F.col("nth") <= limit).drop("nth")
    rows = ok.join(first, "js").drop("js")
    if min_score <= 0:
        scored = s.scored.where(F.col("score") > 0).groupBy("ps").agg(F.sum("n").alias("scored"))
        few = s.signatures.select("ps").join(scored, "ps", "left").where(F.coalesce("scored", F.lit(0)) < limit).select("ps")
        grid = few.crossJoin(F.broadcast(s.jobs.select("js", *s.job_cols).orderBy(*ties).limit(2 * limit)))
        nothing = grid.join(s.scored.select("ps", "js"), ["ps", "js"], "left_anti").drop("js")
        zero = {c: F.lit(0.0) for c in rows.columns if c.endswith("score")} | {"matched_skills": F.array().cast("array<string>")}
        rows = rows.unionByName(nothing.withColumns(zero))
    w = Window.partitionBy("ps").orderBy(F.col("score").desc(), *ties)
    best = rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)
    return s.profiles.select("profile_id", "ps").join(best, "ps").drop("ps")


def match_report(matches: DataFrame) -> DataFrame:
    """Rank, score (1 decimal), job fields and matched skills."""
    return matches.select("profile_id", "rank", py_round(F.col("score"), 1).alias("score"), "job_id", "title",
                          "company", "location", F.array_join("matched_skills", ", ").alias("matched_skills"))


def market_skill_demand(postings: DataFrame, categories=V.VOCAB.categories, distinct_skills: bool = False,
                        top: int = 30) -> DataFrame:
    """Postings whose description + title contains each category skill.

    A skill counts once per category that lists it (the reference's double
    count); ``distinct_skills=True`` counts it once.
    """
    spark = postings.sparkSession
    dim = spark.createDataFrame([(c, s) for c, members in categories for s in members], "category string, skill string")
    mult = dim.groupBy("skill").agg(F.count(F.lit(1)).alias("mult"))
    skills = sorted({s for _, members in categories for s in members})
    text = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    found = postings.select(F.explode(match_terms(text, [(s, s) for s in skills], "substring")).alias("skill"))
    counts = found.groupBy("skill").agg(F.count(F.lit(1)).alias("postings"))
    demand = counts.join(F.broadcast(mult), "skill").select(
        "skill", (F.col("postings") * (F.lit(1) if distinct_skills else F.col("mult"))).alias("demand"))
    order = [F.col("demand").desc(), F.col("skill")]
    return demand.orderBy(*order).limit(top).withColumn("market_rank", F.row_number().over(Window.orderBy(*order)))


def skill_gaps(profiles: DataFrame, market: DataFrame, categories=V.VOCAB.categories) -> DataFrame:
    """Per profile and market skill: have (equal to or inside a user skill) or learn.

    The market list is at most ``top`` rows (G4); it is attached to each profile
    as one array, so no profile x skill pairs are joined. Gaps carry their first
    category in category order. Also the coverage % of the market list.
    """
    arr = market.agg(F.array_sort(F.collect_list(F.struct("market_rank", "skill", "demand"))).alias("market"))
    user = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.lower(s))
    cat_rules = [(members, cat) for cat, members in categories]

    def category_of(skill: Column) -> Column:
        expr = None
        for members, cat in cat_rules:
            cond = F.array_contains(literal_array(list(members)), skill)
            expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
        return expr

    p = profiles.select("profile_id", user.alias("user_skills")).crossJoin(F.broadcast(arr))
    rows = p.select("profile_id", "user_skills", F.explode("market").alias("m")).select(
        "profile_id", "m.market_rank", "m.skill", "m.demand",
        F.exists("user_skills", lambda us: (us == F.col("m.skill")) | (F.instr(us, F.col("m.skill")) > 0)).alias("have"))
    w = Window.partitionBy("profile_id", "have").orderBy("market_rank")
    tot = Window.partitionBy("profile_id")
    return rows.select(
        "profile_id", "skill", "demand", "market_rank",
        F.when(F.col("have"), "have").otherwise("learn").alias("status"),
        F.row_number().over(w).cast("bigint").alias("status_rank"),
        F.when(~F.col("have"), category_of(F.col("skill"))).alias("category"),
        py_round(F.sum(F.col("have").cast("int")).over(tot) * 100.0 / F.count(F.lit(1)).over(tot), 1)
        .alias("coverage_percent"))


def learning_plan(profiles: DataFrame, market_counts: DataFrame, n: int = 10, certs=V.CERTIFICATIONS,
                  max_certs: int = 3) -> DataFrame:
    """G6 + G7: market skills the user lacks (top n by demand) and up to 3 certifications.

    ``market_counts`` is (skill, count) over a fixed vocabulary, so it is
    attached to every profile as one bounded array.
    """
    arr = market_counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "skill", "count")))
                            .alias("market"))
    user = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: F.lower(s))
    p = profiles.select("profile_id", user.alias("user_skills")).crossJoin(F.broadcast(arr))
    missing = F.slice(F.filter("market", lambda m: ~F.array_contains(F.col("user_skills"), F.lower(m["skill"]))), 1, n)

    def cert_of(skill: Column) -> Column:
        expr = None
        for key, name in certs:
            cond = F.instr(F.lower(skill), key) > 0
            expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        return expr

    return p.select(
        "profile_id",
        F.transform(missing, lambda m: F.struct(m["skill"].alias("skill"), m["count"].alias("demand"))).alias("to_learn"),
        F.slice(F.filter(F.transform(missing, lambda m: cert_of(m["skill"])), lambda c: c.isNotNull()), 1, max_certs)
        .alias("certifications"))


def profile_text(profiles: DataFrame) -> Column:
    """G8: "Job title: t. Skills: a, b. Location: x. N years of experience" or a fallback."""
    def nonempty(c):
        return F.coalesce(F.size(c), F.lit(0)) > 0

    parts = F.array(
        F.when(F.length(F.coalesce("title", F.lit(""))) > 0, F.concat(F.lit("Job title: "), F.col("title"))),
        F.when(nonempty(F.col("skills")), F.concat(F.lit("Skills: "), F.array_join("skills", ", "))),
        F.when(nonempty(F.col("preferred_locations")),
               F.concat(F.lit("Location: "), F.array_join("preferred_locations", ", "))),
        F.when(F.coalesce("experience_years", F.lit(0)) != 0,
               F.concat(F.col("experience_years").cast("string"), F.lit(" years of experience"))),
    )
    joined = F.array_join(F.array_compact(parts), ". ")
    return F.when(joined == "", F.lit("software engineer")).otherwise(joined)


def job_text(df: DataFrame, max_chars: int = 500) -> Column:
    """G8: "title at company in location description[:500]" (skills when no description)."""
    def present(c):
        return F.length(F.coalesce(c, F.lit(""))) > 0

    place = F.coalesce(F.when(present(F.col("location")), F.col("location")),
                       F.col("city") if "city" in df.columns else F.lit(None))
    skills = (F.when(F.length(F.coalesce("skills", F.lit(""))) > 0, F.concat(F.lit("Skills: "), F.col("skills")))
              if "skills" in df.columns else F.lit(None))
    parts = F.array(
        F.when(present(F.col("title")), F.col("title")),
        F.when(present(F.col("company")), F.concat(F.lit("at "), F.col("company"))),
        F.when(present(place), F.concat(F.lit("in "), place)),
        F.when(present(F.col("description")), F.substring("description", 1, max_chars)).otherwise(skills),
    )
    return F.array_join(F.array_compact(parts), " ")
