"""Text extraction and classification.

Dictionary matching has three modes that disagree on purpose (substring,
``\\b`` boundary, look-around); each is one regex pass per text.
Short ordered rule lists (classes, titles) stay native column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import vocab as V
from postlens.functions.text import (
    UNICODE,
    anchored_pattern,
    contains_any,
    first_contains_label,
    first_regex_label,
    literal_array,
    py_strip,
    quote,
    term_pattern,
    title_case,
)
from postlens.functions.dictionary import match_terms
from postlens.operators.demand import with_rank


def dictionary_terms(text: Column, terms: Sequence[tuple[str, str]], mode: str) -> Column:
    """Distinct, sorted labels whose term occurs in ``text`` (lower-cased) under ``mode``.

    One regex pass per text (see ``postlens.functions.dictionary``).
    """
    if not terms:
        return F.array().cast("array<string>")
    return match_terms(text, terms, mode)


def skill_terms(vocab: V.Vocab = V.VOCAB, aliases: bool = True, variants: bool = False) -> list[tuple[str, str]]:
    terms = [(s, s) for s in vocab.skills]
    if aliases:
        terms += list(vocab.aliases)
    if variants:
        terms += list(vocab.normalization)
    return terms


def extract_skills_col(text: Column, mode: str = "lookaround", vocab: V.Vocab = V.VOCAB,
                       aliases: bool = True, variants: bool | None = None) -> Column:
    """C2 (``boundary``: dictionary + aliases) and C3 (``lookaround``: + variants)."""
    if variants is None:
        variants = mode == "lookaround"
    return dictionary_terms(F.coalesce(text, F.lit("")), skill_terms(vocab, aliases, variants), mode)


def substring_skills_col(text: Column, terms: Sequence[str] = V.VOCAB.tech_skills) -> Column:
    """C1 per text: the terms that its lower-cased form contains."""
    return dictionary_terms(text, [(t, t) for t in terms], "substring")


def substring_skill_counts(df: DataFrame, text_col: str = "description",
                           terms: Sequence[str] = V.VOCAB.tech_skills) -> DataFrame:
    """Per term, the number of rows whose lower-cased text contains it (count > 0)."""
    hits = substring_skills_col(F.col(text_col), terms)
    return (df.where(F.col(text_col).isNotNull()).select(F.explode(hits).alias("skill"))
            .groupBy("skill").agg(F.count(F.lit(1)).alias("count")))


def categorize_skills(df: DataFrame, skills_col: str, key_cols: Sequence[str],
                      categories=V.VOCAB.categories) -> DataFrame:
    """C4: (keys..., category, skills) for every category holding any of the row's skills."""
    def members_of(members):
        arr = literal_array(list(members))
        return lambda s: F.array_contains(arr, s)

    per_cat = [F.struct(F.lit(cat).alias("category"), F.filter(F.col(skills_col), members_of(members)).alias("skills"))
               for cat, members in categories]
    return (df.select(*key_cols, F.explode(F.array(*per_cat)).alias("c"))
            .where(F.size("c.skills") > 0).select(*key_cols, "c.category", "c.skills"))


def salary_mentions(df: DataFrame, text_col: str = "description", order_cols: Sequence[str] = ("job_id",),
                    pattern: str = V.SALARY_TEXT_PATTERN, samples: int = 20) -> DataFrame:
    """Every salary-looking span; total and the first N samples in row order.

    Returns one row: total_mentions and the samples joined by `` | ``.
    """
    spans = df.where(F.col(text_col).isNotNull()).select(
        *order_cols, F.col(text_col).alias("_t"),
        F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit("(?i)" + UNICODE + anchored_pattern(pattern)), 0)).alias("pos", "span"))
    total = spans.agg(F.count(F.lit(1)).alias("total_mentions"))
    order = [F.col(c).asc_nulls_first() for c in order_cols] + [F.col("_t"), F.col("pos")]
    first = with_rank(spans.orderBy(*order).limit(samples), order, "i")
    joined = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "span"))),
                                                lambda x: x["span"]), " | ").alias("samples"))
    return total.crossJoin(F.broadcast(joined))


def salary_coverage(df: DataFrame, candidates: Sequence[str] = ("salary", "salary_range", "compensation")) -> DataFrame:
    """Non-null count and % of rows for the first present salary column."""
    col = next((c for c in candidates if c in df.columns), None)
    if col is None:
        raise ValueError("no salary column present; use salary_mentions")
    return df.agg(F.lit(col).alias("column"), F.count(col).alias("total_with_salary"),
                  F.round(F.try_divide(F.count(col) * 100.0, F.count(F.lit(1))), 1).alias("percentage_with_salary"))


def salary_lpa_col(text: Column, pattern: str = V.LPA_PATTERN) -> Column:
    """The number before lpa / lakh / lac, as double; null when absent."""
    got = F.regexp_extract(F.lower(text), UNICODE + pattern, 1)
    return F.when(got != "", got.cast("double"))


def class_counts(df: DataFrame, label: Column, labels: Sequence[str]) -> DataFrame:
    """Counts per class, keeping classes with zero rows (left join from the class list)."""
    spark = df.sparkSession
    classes = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "ordinal int, level string")
    counts = df.select(label.alias("level")).where(F.col("level").isNotNull()).groupBy("level").agg(
        F.count(F.lit(1)).alias("count"))
    return (F.broadcast(classes).join(counts, "level", "left")
            .select("ordinal", "level", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def experience_levels(df: DataFrame, text_col: str = "description", rules=V.EXPERIENCE_PATTERNS) -> DataFrame:
    """First matching experience class per description; zero classes kept."""
    staged = df.where(F.col(text_col).isNotNull()).select(F.lower(F.col(text_col)).alias("_low"))
    label = first_regex_label(F.col("_low"), [(p, l) for l, p in rules], default=None)
    return class_counts(staged, label, [l for l, _ in rules])


def job_types_from_text(df: DataFrame, text_col: str = "description", rules=V.JOB_TYPE_PATTERNS) -> DataFrame:
    """C9 (text path): multi-label regex classes; a row counts in each class it matches."""
    staged = df.where(F.col(text_col).isNotNull()).select(F.lower(F.col(text_col)).alias("_low"))
    sums = [F.sum(F.col("_low").rlike(UNICODE + p).cast("bigint")).alias(f"c{i}") for i, (_, p) in enumerate(rules)]
    agg = staged.agg(*sums)
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(l).alias("job_type"),
                      F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("count")) for i, (l, _) in enumerate(rules)]
    return agg.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def market_role_counts(df: DataFrame, title_col: str = "title", rules=V.MARKET_ROLE_CATEGORIES) -> DataFrame:
    """First matching role category per non-empty title; unmatched titles dropped."""
    staged = (df.where(F.col(title_col).isNotNull() & (F.col(title_col) != ""))
              .select(F.lower(F.col(title_col)).alias("_low")))
    label = first_contains_label(F.col("_low"), [(kw, cat) for cat, kw in rules], default=None)
    return (staged.select(label.alias("category")).where(F.col("category").isNotNull())
            .groupBy("category").agg(F.count(F.lit(1)).alias("count")))


def experience_demand(df: DataFrame, rules=V.EXPERIENCE_DEMAND_KEYWORDS) -> DataFrame:
    """C11: first matching keyword class over description + ' ' + title; zero classes kept."""
    staged = df.select(F.lower(F.concat(F.coalesce("description", F.lit("")), F.lit(" "),
                                        F.coalesce("title", F.lit("")))).alias("_low"))
    label = first_contains_label(F.col("_low"), [(kw, l) for l, kw in rules], default=None)
    return class_counts(staged, label, [l for l, _ in rules])


# ---------------------------------------------------------------- resumes

def _u(p: str) -> str:
    """Python's \\w, \\d and \\b are Unicode-aware; Java's need (?U)."""
    return "(?U)" + p


def graduation_years_col(text: Column, as_of_year: int, patterns=V.RESUME_GRADUATION_PATTERNS,
                         low: Column | None = None) -> Column:
    """Years since the first in-range graduation year (2000..as_of), else 0."""
    low = F.lower(text) if low is None else low
    picks = []
    for p in patterns:
        y = F.regexp_extract(low, _u(p), 1)
        yi = F.when(y != "", y.cast("int"))
        picks.append(F.when(yi.between(2000, as_of_year), F.greatest(F.lit(0), F.lit(as_of_year) - yi)))
    return F.coalesce(*picks, F.lit(0))


def experience_years_col(text: Column, as_of_year: int, low: Column | None = None) -> Column:
    """Fresher -> 0; first experience pattern; else graduation estimate; else 0."""
    low = F.lower(text) if low is None else low
    found = [F.when(F.regexp_extract(low, _u(p), 1) != "", F.regexp_extract(low, _u(p), 1).cast("int"))
             for p in V.RESUME_EXPERIENCE_PATTERNS]
    grad = graduation_years_col(text, as_of_year, low=low)
    return (F.when(low.rlike(_u(V.RESUME_FRESHER_PATTERN)), F.lit(0))
            .otherwise(F.coalesce(*found, F.when(grad > 0, grad), F.lit(0))).cast("int"))


def resume_title_col(text: Column, titles=V.RESUME_TITLES, skill_titles=V.RESUME_SKILL_TITLES,
                     low: Column | None = None, boundary: bool = False) -> Column:
    """C14: longest known title contained; else the objective phrase; else skill -> title.

    ``boundary`` accepts titles only as whole words (so "director" holds no "cto").
    """
    low = F.lower(text) if low is None else low
    by_len = sorted(titles, key=len, reverse=True)  # stable: ties keep list order
    if boundary:
        known = first_regex_label(low, [(r"\b" + quote(t) + r"\b", t.title()) for t in by_len], None)
    else:
        known = first_contains_label(low, [((t,), t.title()) for t in by_len], default=None)
    obj = F.regexp_extract(low, _u(V.RESUME_OBJECTIVE_PATTERN), 1)
    objective = F.when(obj != "", title_case(py_strip(obj)))
    fallback = first_contains_label(low, [((k,), t) for k, t in skill_titles], default=F.lit(""))
    return F.coalesce(known, objective, fallback)


def resume_locations_col(text: Column, cities=V.RESUME_CITIES, low: Column | None = None) -> Column:
    """Known cities contained, in list order, then Remote."""
    low = F.lower(text) if low is None else low
    hits = [F.when(low.contains(c), F.lit(c.title())) for c in cities]
    hits.append(F.when(low.contains("remote"), F.lit("Remote")))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def parse_resumes(df: DataFrame, text_col: str = "text", id_col: str = "resume_id",
                  as_of_year: int = 2026, vocab: V.Vocab = V.VOCAB) -> DataFrame:
    """résumé texts -> profile rows (C3 + C14 + C12 + C15 + defaults)."""
    staged = df.select(F.col(id_col).alias("profile_id"), F.col(text_col).alias("_text"),
                       F.lower(F.col(text_col)).alias("_low"))
    t, low = F.col("_text"), F.col("_low")
    return staged.select(
        "profile_id",
        F.lit("").alias("name"),
        resume_title_col(t, low=low).alias("title"),
        experience_years_col(t, as_of_year, low=low).alias("experience_years"),
        extract_skills_col(t, "lookaround", vocab).alias("skills"),
        resume_locations_col(t, low=low).alias("preferred_locations"),
        F.array().cast("array<string>").alias("preferred_companies"),
        F.lit(0.0).alias("min_salary_lpa"),
        F.array().cast("array<string>").alias("job_types"),
        F.array().cast("array<string>").alias("industries"),
        F.lit("pdf_parser").alias("source"),
    )


def _profile_defaults() -> dict:
    return {
    "name": F.lit(""), "title": F.lit(""), "experience_years": F.lit(0),
    "skills": F.array().cast("array<string>"), "preferred_locations": F.array().cast("array<string>"),
    "preferred_companies": F.array().cast("array<string>"), "min_salary_lpa": F.lit(0.0),
    "job_types": F.array().cast("array<string>"), "industries": F.array().cast("array<string>"),
    }


def profile_defaults(df: DataFrame) -> DataFrame:
    """Missing profile fields become empty values."""
    out = df
    for name, default in _profile_defaults().items():
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)
    return out


def merge_profiles(stored: DataFrame, parsed: DataFrame, key: str = "profile_id") -> DataFrame:
    """C17: overwrite title / skills / locations when parsed non-empty, years when > 0."""
    s, p = stored.alias("s"), parsed.alias("p")
    j = s.join(p, F.col(f"s.{key}") == F.col(f"p.{key}"), "full_outer")

    def pick_text(c):
        return F.when(F.length(F.col(f"p.{c}")) > 0, F.col(f"p.{c}")).otherwise(F.col(f"s.{c}"))

    def pick_list(c):
        return F.when(F.size(F.col(f"p.{c}")) > 0, F.col(f"p.{c}")).otherwise(F.col(f"s.{c}"))

    return j.select(
        F.coalesce(F.col(f"s.{key}"), F.col(f"p.{key}")).alias(key),
        pick_text("title").alias("title"),
        F.when(F.col("p.experience_years") > 0, F.col("p.experience_years"))
        .otherwise(F.col("s.experience_years")).alias("experience_years"),
        pick_list("skills").alias("skills"),
        pick_list("preferred_locations").alias("preferred_locations"),
    )


__all__ = [
    "categorize_skills", "class_counts", "contains_any", "dictionary_terms", "experience_demand",
    "experience_levels", "experience_years_col", "extract_skills_col", "graduation_years_col",
    "job_types_from_text", "market_role_counts", "merge_profiles", "parse_resumes", "profile_defaults",
    "resume_locations_col", "resume_title_col", "salary_coverage", "salary_lpa_col", "salary_mentions",
    "skill_terms", "substring_skill_counts",
]
