"""Alert rules over postings.

A few alerts are a parameter list (like a rule table): every posting is tested
against all of them in one projection of literal-pattern expressions, without join
or shuffle. Alerts that users keep are a table of any size, found by an index of
their criteria (:class:`AlertIndex`), or on a stream by a stateless join with the table
(:func:`join_alert_table`). Criteria are conjunctive; an absent criterion passes; a
posting with no salary in its text passes the salary floor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.needles import anchored, found_needles, grams, lowered, with_found
from postlens.operators.extract import salary_lpa_col
from postlens.session import stored


@dataclass(frozen=True)
class Alert:
    name: str
    title_keywords: tuple[str, ...] | None = None
    skills: tuple[str, ...] | None = None
    location: str | None = None
    company: str | None = None
    min_salary_lpa: float | None = None
    job_type: str | None = None

    def __post_init__(self):
        """Criteria are kept lower-cased, as they are compared with lower-cased fields."""
        for c in ("title_keywords", "skills"):
            if getattr(self, c) is not None:
                object.__setattr__(self, c, tuple(x.lower() for x in getattr(self, c)))
        for c in ("location", "company", "job_type"):
            if getattr(self, c) is not None:
                object.__setattr__(self, c, getattr(self, c).lower())


def sample_alerts() -> list[Alert]:
    return [Alert(n, tuple(t) if t else None, tuple(s) if s else None, loc, comp, sal, jt)
            for n, t, s, loc, comp, sal, jt in V.SAMPLE_ALERTS]


def _low(c: str, df: DataFrame) -> Column:
    """The lower-cased field, computed once per row by ``match_alerts``."""
    return F.col(f"_low_{c}") if c in df.columns else F.lit("")


def _found(text: Column, needles: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(n), F.lit(n)) for n in needles]))


def alert_verdict(df: DataFrame, alert: Alert) -> Column:
    """struct(name, ok, reasons) for one alert on every row."""
    title, desc = _low("title", df), _low("description", df)
    loc, comp, jtype = _low("location", df), _low("company", df), _low("job_type", df)
    ok = F.lit(True)
    reasons: list[Column] = []
    if alert.title_keywords is not None:
        hit = _found(title, alert.title_keywords)
        ok = ok & (F.size(hit) > 0)
        reasons.append(F.concat(F.lit("Title contains: "), F.array_join(hit, ", ")))
    if alert.skills is not None:
        hit = _found(desc, alert.skills)
        ok = ok & (F.size(hit) > 0)
        reasons.append(F.concat(F.lit("Skills found: "), F.array_join(hit, ", ")))
    if alert.location is not None:
        ok = ok & loc.contains(alert.location)
        reasons.append(F.concat(F.lit("Location: "), F.coalesce(F.col("location"), F.lit("None"))))
    if alert.company is not None:
        ok = ok & comp.contains(alert.company)
        reasons.append(F.concat(F.lit("Company: "), F.coalesce(F.col("company"), F.lit("None"))))
    if alert.job_type is not None:
        ok = ok & (desc.contains(alert.job_type) | jtype.contains(alert.job_type))
        reasons.append(F.lit(f"Job type: {alert.job_type}"))
    if alert.min_salary_lpa is not None:
        text = F.coalesce(F.when(F.length(F.col("salary")) > 0, F.col("salary")), F.col("description")) \
            if "salary" in df.columns else F.col("description")
        lpa = salary_lpa_col(text)
        has = lpa.isNotNull() & (lpa != 0)
        ok = ok & (~has | (lpa >= alert.min_salary_lpa))
        reasons.append(F.when(has, F.concat(F.lit("Salary: "), lpa.cast("string"), F.lit(" LPA"))))
    return F.struct(F.lit(alert.name).alias("alert_name"), ok.alias("ok"),
                    F.array_compact(F.array(*reasons) if reasons else F.array().cast("array<string>")).alias("reasons"))


def match_alerts(df: DataFrame, alerts: Sequence[Alert], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per (posting, matching alert) with the reasons; works on streams."""
    keep = list(keep or df.columns)
    staged = df.select("*", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"_low_{c}")
                              for c in ("title", "description", "location", "company", "job_type") if c in df.columns])
    verdicts = F.array(*[alert_verdict(df, a) for a in alerts])
    return (staged.select(*keep, F.explode(F.filter(verdicts, lambda v: v["ok"])).alias("v"))
            .select("v.alert_name", *keep, F.array_join("v.reasons", "; ").alias("reasons")))


def check_alerts(df: DataFrame, alerts: Sequence[Alert], first: int = 20,
                 order_cols: Sequence[str] = ("job_id", "title", "company", "location", "description")) -> DataFrame:
    """Per alert the match count and its first N matches; alerts without matches kept."""
    spark = df.sparkSession
    # the alert projection runs once: counts and first matches read its rows
    m = stored(match_alerts(df, alerts).select("alert_name", *order_cols, "reasons"), "alerts")
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    counts = m.groupBy("alert_name").agg(F.count(F.lit(1)).alias("match_count"))
    firsts = (m.withColumn("match_rank", F.row_number().over(Window.partitionBy("alert_name").orderBy(*order))
                           .cast("bigint"))
              .where(F.col("match_rank") <= first)
              .select("alert_name", "match_rank", "job_id", "reasons"))
    names = spark.createDataFrame([(i, a.name) for i, a in enumerate(alerts)], "alert_order int, alert_name string")
    return (F.broadcast(names).join(counts, "alert_name", "left").join(firsts, "alert_name", "left")
            .select("alert_order", "alert_name", F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"),
                    "match_rank", "job_id", "reasons"))


ALERT_SCHEMA = ("alert_name string, title_keywords array<string>, skills array<string>, location string, company string, "
                "min_salary_lpa double, job_type string")


CRITERIA = ("title_keywords", "skills", "location", "company", "job_type")
#: Criterion -> posting fields that it looks in; the first two hold any-of lists.
LOOKS_IN = {"title_keywords": ("title",), "skills": ("description",), "location": ("location",), "company": ("company",),
            "job_type": ("description", "job_type")}
TEXT_FIELDS = ("title", "description", "location", "company", "job_type")
#: Copies of the alerts' anchors, over which the postings that hold a frequent needle are dealt.
SALTS = 16


RULE = ("title_keywords", "skills", "location", "company", "min_salary_lpa", "job_type")
#: Alert names that share their criteria are dealt out over the tasks in lots of about so many.
NAMES_A_LOT = 4096


def _digest(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def _lowered_alerts(alerts: DataFrame) -> DataFrame:
    """Alert names and lower-cased criteria, without the alerts that have an empty list (they match nothing)."""
    low_list = lambda c: F.transform(F.col(c).cast("array<string>"), lambda x: F.lower(x)).alias(c)
    low = lambda c: F.lower(c).alias(c)
    a = alerts.select("alert_name", low_list("title_keywords"), low_list("skills"), low("location"), low("company"),
                      F.col("min_salary_lpa").cast("double").alias("min_salary_lpa"), low("job_type"))
    return a.where((F.coalesce(F.size("title_keywords"), F.lit(1)) != 0) & (F.coalesce(F.size("skills"), F.lit(1)) != 0))


def _looks() -> Column:
    """Per text criterion its (field, needle) pairs in order."""
    def pairs(c):
        items = F.col(c) if c in ("title_keywords", "skills") else F.array(c)
        looks = F.flatten(F.transform(items, lambda x: F.array(*[F.struct(F.lit(f).alias("field"), x.alias("needle")) for f in LOOKS_IN[c]])))
        return F.when(F.col(c).isNotNull() & ~F.array_contains(items, ""), F.struct(F.lit(c).alias("criterion"), looks.alias("pairs")))

    return F.array_compact(F.array(*[pairs(c) for c in CRITERIA]))


def alert_criteria(alerts: DataFrame) -> DataFrame:
    """alert_id (a digest), the lower-cased criteria, and ``looks``: per text criterion its (field, needle) pairs in order.

    Repeated alert rows count once. An alert with an empty list matches nothing and is left out. A criterion with
    an empty needle holds for every posting, so it looks for nothing.
    """
    a = _lowered_alerts(alerts)
    return a.withColumn("alert_id", _digest(*a.columns)).dropDuplicates(["alert_id"]).withColumn("looks", _looks())


def _lpa(df: DataFrame) -> Column:
    text = F.coalesce(F.when(F.length(F.col("salary")) > 0, F.col("salary")), F.col("description")) if "salary" in df.columns else F.col("description")
    return salary_lpa_col(text)


def _verdict(contains) -> tuple[Column, Column, Column]:
    """(ok, title hits, skill hits) of the criteria in ``title_keywords`` ... ``min_salary_lpa`` and ``lpa``; ``contains(field, needle)``."""
    any_of = lambda c, f: F.filter(c, lambda k: contains(f, k))
    title, skill = any_of("title_keywords", "title"), any_of("skills", "description")
    ok = (F.col("title_keywords").isNull() | (F.size(title) > 0)) & (F.col("skills").isNull() | (F.size(skill) > 0))
    for c in ("location", "company", "job_type"):
        hit = F.lit(False)
        for f in LOOKS_IN[c]:
            hit = hit | contains(f, F.col(c))
        ok = ok & (F.col(c).isNull() | hit)
    paid = F.col("lpa").isNotNull() & (F.col("lpa") != 0)
    return ok & (F.col("min_salary_lpa").isNull() | ~paid | (F.col("lpa") >= F.col("min_salary_lpa"))), title, skill


def _reasons(df_columns: Sequence[str], title: Column, skill: Column) -> Column:
    paid = F.col("lpa").isNotNull() & (F.col("lpa") != 0)
    shown = lambda c: F.coalesce(F.col(f"post.{c}"), F.lit("None")) if c in df_columns else F.lit("None")
    return F.array_join(F.array_compact(F.array(
        F.when(F.col("title_keywords").isNotNull(), F.concat(F.lit("Title contains: "), F.array_join(title, ", "))),
        F.when(F.col("skills").isNotNull(), F.concat(F.lit("Skills found: "), F.array_join(skill, ", "))),
        F.when(F.col("location").isNotNull(), F.concat(F.lit("Location: "), shown("location"))),
        F.when(F.col("company").isNotNull(), F.concat(F.lit("Company: "), shown("company"))),
        F.when(F.col("job_type").isNotNull(), F.concat(F.lit("Job type: "), F.col("job_type"))),
        F.when(F.col("min_salary_lpa").isNotNull() & paid, F.concat(F.lit("Salary: "), F.col("lpa").cast("string"), F.lit(" LPA"))))), "; ")


def _tagged(items: Column, field: str, name: str, of: str) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(field).alias(name), x.alias(of)))


def _fields(df: DataFrame) -> list[str]:
    return [f for f in TEXT_FIELDS if f in df.columns]


class AlertIndex:
    """Alerts by their criteria's needles, over the signatures of postings.

    Alerts of the same criteria are one rule; rules are matched, and their names meet the result last.

    1. Every distinct field value is looked up once for the needles of its field (:mod:`postlens.functions.needles`).
    2. Postings whose fields hold the same needles, and that pay the same, are one signature.
    3. Each rule is anchored at its rarest criterion, by the postings that hold any of its needles. A signature
       meets a rule only by an anchor's needle; the first such needle of the criterion's list counts, so
       nothing is met twice, and the rule's other criteria are read off the signature's needles.
    Rules without a text criterion are anchored at nothing and meet every signature.
    """

    def __init__(self, df: DataFrame, alerts: DataFrame, keep: Sequence[str] | None = None):
        self.keep, self.columns, self.fields = list(keep or df.columns), df.columns, _fields(df)
        named = _lowered_alerts(alerts).withColumn("alert_id", _digest(*RULE))
        self.names = stored(named.select("alert_name", *RULE, "alert_id").distinct(), "names")
        rules = self.names.groupBy("alert_id", *RULE).agg(F.ceil(F.count(F.lit(1)) / NAMES_A_LOT).cast("int").alias("lots"))
        self.names = self.names.select("alert_name", "alert_id")
        self.alerts = stored(rules.withColumn("looks", _looks()), "alerts")
        pairs = self.alerts.select("alert_id", F.explode("looks").alias("l")).select("alert_id", "l.criterion", F.posexplode("l.pairs").alias("nth", "p"))
        self.pairs = pairs.select("alert_id", "criterion", "nth", "p.field", "p.needle")
        needles = self.pairs.where(F.col("field").isin(self.fields)).select("field", "needle").distinct()
        found = stored(found_needles(df, self.fields, needles), "found")
        rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("post"), _lpa(df).alias("lpa"), *self.fields)
        rows = with_found(rows, ["post", "lpa"], self.fields, found)
        held = [F.col(f"in_{f}") if f in self.fields else F.array().cast("array<string>").alias(f"in_{f}") for f in TEXT_FIELDS]
        rows = rows.select("post", "lpa", *held)
        self.rows = stored(rows.withColumn("sig", F.md5(F.to_json(F.struct("lpa", *[f"in_{f}" for f in TEXT_FIELDS]), {"ignoreNullFields": "false"}))), "signed")
        self.sets = self.rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.first("lpa").alias("lpa"), *[F.first(f"in_{f}").alias(f"in_{f}") for f in TEXT_FIELDS])
        self.sets = stored(self.sets, "signatures")

    def _anchors(self) -> DataFrame:
        """(field, needle, nth, alert columns): the pairs of each alert's rarest criterion, or one pair of nulls."""
        per = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"in_{f}").alias("needles")) for f in TEXT_FIELDS]))
        held = self.sets.select("n", per.alias("x")).select("n", "x.field", F.explode("x.needles").alias("needle"))
        load = held.groupBy("field", "needle").agg(F.sum("n").alias("load"))
        cost = self.pairs.join(load, ["field", "needle"], "left").groupBy("alert_id", "criterion").agg(F.sum(F.coalesce("load", F.lit(0))).alias("cost"))
        best = cost.groupBy("alert_id").agg(F.min(F.struct("cost", "criterion")).alias("best")).select("alert_id", F.col("best.criterion").alias("criterion"))
        chosen = self.pairs.join(best, ["alert_id", "criterion"]).groupBy("alert_id", "field", "needle").agg(F.min("nth").alias("nth"))
        every = self.alerts.join(chosen, "alert_id", "left")
        looks = F.filter("looks", lambda x: F.exists(x["pairs"], lambda p: (p["field"] == F.col("field")) & (p["needle"] == F.col("needle"))))
        return every.withColumn("looks", looks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def pairs_met(self) -> DataFrame:
        """(sig, n, lpa, alert columns, title hits, skill hits) of every signature and alert that match."""
        anchors = stored(self._anchors(), "anchored")
        per = F.array(*[_tagged(F.col(f"in_{f}"), f, "field", "needle") for f in TEXT_FIELDS], _tagged(F.array(F.lit("")), "", "field", "needle"))
        sets = self.sets.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int"))
        sets = sets.select("*", F.explode(F.flatten(per)).alias("x")).select(*sets.columns, "x.field", "x.needle")
        met = sets.join(anchors.withColumns({c: F.coalesce(c, F.lit("")) for c in ("field", "needle")}), ["field", "needle", "salt"])
        holds = lambda f, x: F.array_contains(F.col(f"in_{f}"), x) | (x == "")
        # of the criterion's pairs that the signature holds, this one is the first
        first = F.col("nth").isNull() | ~F.exists("looks", lambda l: F.exists(F.slice(l["pairs"], 1, F.col("nth")), lambda p: self._held(p)))  # noqa: E741
        ok, title, skill = _verdict(holds)
        return met.where(F.coalesce(ok & first, F.lit(False))).select("sig", "n", *self.alerts.columns, title.alias("title_hits"), skill.alias("skill_hits"))

    @staticmethod
    def _held(p: Column) -> Column:
        hit = F.lit(False)
        for f in TEXT_FIELDS:
            hit = hit | ((p["field"] == f) & F.array_contains(F.col(f"in_{f}"), p["needle"]))
        return hit

    def matches(self) -> DataFrame:
        """alert_name, the kept columns, reasons: a row per posting and alert that match."""
        both = self.rows.select("sig", "post", "lpa").join(self.pairs_met(), "sig")
        kept = F.struct(*[F.col(f"post.{c}").alias(c) for c in self.keep]).alias("post")
        found = both.select("alert_id", "lots", kept, _reasons(self.columns, F.col("title_hits"), F.col("skill_hits")).alias("reasons"))
        found = found.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
        names = self.names.join(self.alerts.select("alert_id", "lots"), "alert_id")
        names = names.select("alert_name", "alert_id", F.pmod(F.xxhash64("alert_name"), F.col("lots")).cast("int").alias("lot"))
        return found.join(names, ["alert_id", "lot"]).select("alert_name", *[F.col(f"post.{c}").alias(c) for c in self.keep], "reasons")

    def counts(self) -> DataFrame:
        """(alert_name, match_count), from signatures alone."""
        per = self.pairs_met().groupBy("alert_id").agg(F.sum("n").alias("n"))
        return self.names.join(per, "alert_id").groupBy("alert_name").agg(F.sum("n").alias("match_count"))

    def firsts(self, first: int, order_cols: Sequence[str]) -> DataFrame:
        """(alert_name, match_count, found): per name that matches, the count and its first rows (match_rank, job_id, reasons).

        Of a signature's postings only the first can be among a rule's first, and names that have the same rules share
        their result, so matches are never listed.
        """
        pairs = stored(self.pairs_met().drop("looks", "lots"), "pairs")
        by = lambda of: [F.col(f"{of}{c}").asc_nulls_first() for c in order_cols]
        # postings that tie in the order may differ in their reasons, if these show a column that the order leaves out
        shown = {"location", "company"} & set(self.columns)
        nth = (F.row_number() if shown <= set(order_cols) else F.rank()).over(Window.partitionBy("sig").orderBy(*by("post.")))
        rows = self.rows.select("sig", "post", "lpa").join(pairs.select("sig").distinct(), "sig", "left_semi")
        rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= first).drop("_nth").join(pairs, "sig")
        rows = rows.select("alert_id", F.struct(*[F.col(f"post.{c}").alias(c) for c in order_cols]).alias("post"),
                           _reasons(self.columns, F.col("title_hits"), F.col("skill_hits")).alias("reasons"))
        order = [*by("post."), F.col("reasons").asc_nulls_first()]
        rank = lambda of: F.row_number().over(Window.partitionBy(of).orderBy(*order)).cast("bigint")
        rows = stored(rows.withColumn("match_rank", rank("alert_id")).where(F.col("match_rank") <= first), "firsts")
        names = self.names.groupBy("alert_name").agg(F.array_sort(F.collect_set("alert_id")).alias("rules"))
        names = stored(names.withColumn("set_id", F.md5(F.array_join("rules", ","))), "rules")
        rules = stored(names.select("set_id", "rules").distinct().select("set_id", F.explode("rules").alias("alert_id")), "sets")
        counts = rules.join(pairs.groupBy("alert_id").agg(F.sum("n").alias("n")), "alert_id").groupBy("set_id").agg(F.sum("n").alias("match_count"))
        top = rules.join(rows.drop("match_rank"), "alert_id").withColumn("match_rank", rank("set_id")).where(F.col("match_rank") <= first)
        lists = top.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("match_rank", F.col("post.job_id").alias("job_id"), "reasons"))).alias("found"))
        return names.select("alert_name", "set_id").join(stored(counts.join(lists, "set_id"), "counted"), "set_id").drop("set_id")


def match_alert_table(df: DataFrame, alerts: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """G10 for alerts kept as a table (ALERT_SCHEMA; null criteria do not count): the rows of :func:`match_alerts`, by :class:`AlertIndex`.

    Neither side has to be small. Repeated alert rows count once.
    """
    return AlertIndex(df, alerts, keep).matches()


def check_alert_table(df: DataFrame, alerts: DataFrame, first: int = 20,
                      order_cols: Sequence[str] = ("job_id", "title", "company", "location", "description")) -> DataFrame:
    """G11 for a table of alerts: per alert name the match count and its first N matches; alerts without matches kept."""
    found = AlertIndex(df, alerts, order_cols).firsts(first, order_cols)
    out = alerts.select("alert_name").distinct().join(found, "alert_name", "left")
    out = out.select("alert_name", F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"), F.explode_outer("found").alias("m"))
    return out.select("alert_name", "match_count", "m.match_rank", "m.job_id", "m.reasons")


def join_alert_table(df: DataFrame, alerts: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of :func:`match_alert_table` as one stateless join, so ``df`` may be a stream and ``alerts`` its static side.

    Each alert is anchored at one criterion (company, location, title, skills, job type, the first that it has) and each
    needle of it at one 3-gram. A posting's distinct grams, field by field, meet these anchors; a row stays if the needle is
    the first of its criterion that the field contains and all criteria hold, so no match comes twice and no
    state is kept. Alerts without a text criterion meet every posting once.
    """
    keep, fields = list(keep or df.columns), _fields(df)
    a = alert_criteria(alerts)
    order = F.array(*[F.lit(c) for c in ("company", "location", "title_keywords", "skills", "job_type")])
    chosen = F.get(F.filter(F.transform(order, lambda c: F.get(F.filter("looks", lambda x: x["criterion"] == c), F.lit(0))), lambda x: x.isNotNull()), F.lit(0))
    a = a.withColumn("look", chosen)
    pairs = a.select("alert_id", F.posexplode("look.pairs").alias("nth", "p")).select("alert_id", "nth", "p.field", "p.needle")
    pairs = pairs.groupBy("alert_id", "field", "needle").agg(F.min("nth").alias("nth")).join(anchored(pairs.select("field", "needle")), ["field", "needle"])
    none = a.where("look is null").select("alert_id", F.lit("").alias("field"), F.lit("").alias("needle"), F.lit(None).cast("int").alias("nth"), F.lit("").alias("gram"))
    static = a.join(pairs.select(*none.columns).union(none), "alert_id")
    static = static.select(*[F.col(c).alias(c if c in CRITERIA or c in ("alert_name", "min_salary_lpa") else f"_{c}") for c in static.columns if c != "looks"])
    lows = [lowered(f).alias(f"_low_{f}") for f in fields]
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("post"), _lpa(df).alias("lpa"), *lows)
    tagged = [_tagged(grams(F.col(f"_low_{f}"), (1, 2, 3)), f, "_field", "_gram") for f in fields] + [_tagged(F.array(F.lit("")), "", "_field", "_gram")]
    met = rows.select("*", F.explode(F.concat(*tagged)).alias("_x")).select("post", "lpa", *[f"_low_{f}" for f in fields], "_x.*").join(static, ["_field", "_gram"])
    text = lambda f: F.col(f"_low_{f}") if f in fields else F.lit("")

    def held(p):
        hit = F.lit(False)
        for f in fields:
            hit = hit | ((p["field"] == f) & text(f).contains(p["needle"]))
        return hit

    here = F.struct(F.col("_field").alias("field"), F.col("_needle").alias("needle"))
    first = F.col("_nth").isNull() | (held(here) & ~F.exists(F.slice("_look.pairs", 1, F.col("_nth")), held))
    ok, title, skill = _verdict(lambda f, x: text(f).contains(x))
    good = met.where(F.coalesce(ok & first, F.lit(False)))
    return good.select("alert_name", *[F.col(f"post.{c}").alias(c) for c in keep], _reasons(df.columns, title, skill).alias("reasons"))
