"""Cleaning: title / skill / location normalisation, dedup, role category.

Every function maps a DataFrame to a DataFrame with native column
expressions; the one shuffle of the cleaning plan is the dedup (B6).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from postlens import vocab as V
from postlens.functions.text import (
    first_contains_label,
    first_regex_label,
    literal_map,
    py_strip,
    title_case,
)


def standardize_title_col(title: Column, rules: Sequence[tuple[str, str]] = V.TITLE_RULES) -> Column:
    """B1: ordered regex list on the lower-cased title; no match -> Python title case."""
    low = py_strip(F.lower(title))
    chain = first_regex_label(low, rules, default=title_case(py_strip(title)))
    return F.when(title.isNull(), F.lit("Unknown")).otherwise(chain)


def standardize_title(df: DataFrame, col: str = "title", out: str = "title_standardized",
                      rules: Sequence[tuple[str, str]] = V.TITLE_RULES) -> DataFrame:
    """B1 as a frame step: the lower-cased title is computed once, not once per rule."""
    low = "_title_low"
    staged = df.withColumn(low, py_strip(F.lower(F.col(col))))
    chain = first_regex_label(F.col(low), rules, default=title_case(py_strip(F.col(col))))
    return staged.withColumn(out, F.when(F.col(col).isNull(), F.lit("Unknown")).otherwise(chain)).drop(low)


def normalize_skill_col(skill: Column, normalization: Sequence[tuple[str, str]] = V.VOCAB.normalization) -> Column:
    """B2: lower + strip, then the variant map, else the lower-cased skill."""
    key = F.lower(py_strip(skill))
    return F.coalesce(F.element_at(literal_map(normalization), key), key)


def parse_skills_col(raw: Column, is_array: bool = False,
                     normalization: Sequence[tuple[str, str]] = V.VOCAB.normalization) -> Column:
    """JSON list (quotes swapped) or comma list -> normalised, non-empty skills.

    Duplicates are kept. Null gives an empty array. A value that parses as JSON
    but not as a list falls back to the comma split.
    """
    if is_array:
        items = F.coalesce(raw, F.array().cast("array<string>"))
    else:
        # Only a value that starts with '[' can be a JSON list; anything else goes
        # straight to the comma split (normalisation strips each item anyway).
        looks_json = F.startswith(py_strip(raw), F.lit("["))
        as_json = F.when(looks_json, F.from_json(F.translate(raw, "'", '"'), "array<string>"))
        items = (
            F.when(raw.isNull(), F.array().cast("array<string>"))
            .when(as_json.isNotNull(), as_json)
            .otherwise(F.split(raw, ","))
        )
    norm = F.transform(items, lambda s: normalize_skill_col(s, normalization))
    return F.filter(norm, lambda s: s.isNotNull() & (F.length(s) > 0))


def parse_skills(df: DataFrame, col: str = "skills", out: str = "skills_normalized",
                 normalization: Sequence[tuple[str, str]] = V.VOCAB.normalization) -> DataFrame:
    is_array = isinstance(df.schema[col].dataType, ArrayType)
    return df.withColumn(out, parse_skills_col(F.col(col), is_array, normalization))


def standardize_location(df: DataFrame, col: str = "location", state_map: bool = False) -> DataFrame:
    """B4 as a frame step: the split parts are computed once for both outputs."""
    staged = df.withColumn("_loc_parts", F.split(py_strip(F.col(col)), ","))
    parts = F.col("_loc_parts")
    city_raw = py_strip(F.element_at(parts, 1))
    second = py_strip(F.element_at(parts, 2))
    cut = F.substring(F.upper(second), 1, 2)
    if state_map:
        cut = F.coalesce(F.element_at(literal_map(V.STATE_NAMES), F.lower(second)), cut)
    state = F.when(F.size(parts) >= 2, cut).otherwise(F.lit("Unknown"))
    city = F.coalesce(F.element_at(literal_map(V.CITY_ALIASES), F.lower(city_raw)), title_case(city_raw))
    is_remote = F.instr(F.lower(F.col(col)), "remote") > 0
    loc = F.col(col)
    return (staged.withColumn("city_standardized",
                              F.when(loc.isNull(), "Unknown").when(is_remote, "Remote").otherwise(city))
            .withColumn("state_standardized",
                        F.when(loc.isNull(), "Unknown").when(is_remote, "USA").otherwise(state))
            .drop("_loc_parts"))


def fill_missing(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Constant defaults for missing values."""
    defaults = defaults or {"company": "Unknown Company", "title_standardized": "Unknown Role"}
    present = {k: v for k, v in defaults.items() if k in df.columns}
    return df.fillna(present)


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the first row per key under an explicit order.

    Written as ``min(struct(order..., rest...))`` per key. Strings make it a sort
    aggregate; its map-side partial step still folds a key that holds a third of
    all rows before the shuffle. Ascending order, nulls first (Spark's struct ordering).
    """
    order = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("_first")
    return df.groupBy(*keys).agg(F.min(packed).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the last row per key under an explicit order (upsert: last write wins)."""
    order = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest])
    return df.groupBy(*keys).agg(F.max(packed).alias("_last")).select(*keys, "_last.*").select(*df.columns)


def remove_duplicates(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """One row per (title_standardized, company, city) — raw city if present."""
    keys = ["title_standardized", "company"]
    keys.append("city" if "city" in df.columns else "city_standardized")
    return keep_first(df, keys, order_by)


def role_category_col(title_std: Column, rules=V.ROLE_RULES, default: str = V.ROLE_DEFAULT) -> Column:
    """Substring tests on the lower-cased standardised title, first match."""
    return first_contains_label(F.lower(title_std), rules, F.lit(default))


def _read_columns(df: DataFrame, order_by: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` and the order without what cannot change ``columns``.

    The first row's values up to the last wanted one in the order are the same whatever is compared behind it. A wanted
    column that is not in the order follows it.
    """
    by_city = "city" not in df.columns  # then the city is a key of the dedup
    source = {"title_standardized": "title", "role_category": "title", "skills_normalized": "skills", "skill_count": "skills",
              "city_standardized": "title" if by_city else "location", "state_standardized": "location"}
    wanted = {c if c in df.columns else source.get(c, c) for c in columns}
    keys = {"title", "company", "location", "city"}
    last = max((i for i, c in enumerate(order_by) if c in wanted), default=-1)
    order = list(order_by) if wanted - {*order_by} else list(order_by[:last + 1])
    return df.select(*[c for c in df.columns if c in wanted | keys | {*order}]), order


def clean_postings(df: DataFrame, order_by: Sequence[str] | None = None, dedup: bool = True,
                   normalization=V.VOCAB.normalization, columns: Sequence[str] | None = None) -> DataFrame:
    """B1 -> B3 -> B4 -> B5 -> B6 -> B7 -> B8 as one lazy plan.

    ``order_by`` decides which duplicate is "first"; it defaults to every input
    column so that the winner never depends on file order. ``columns``, if given, are all that is read of the
    result: the dedup then carries those and the part of the order that decides them.
    """
    order_by = list(order_by or df.columns)
    if columns is not None:
        df, order_by = _read_columns(df, order_by, columns)
    with_skills = columns is None or "skills" in df.columns
    out = standardize_title(df)
    loc_col = "location" if "location" in out.columns else "city"

    def derived(x: DataFrame) -> DataFrame:
        x = parse_skills(x, normalization=normalization) if with_skills else x
        return standardize_location(x, loc_col) if loc_col in x.columns else x

    made = {"skills_normalized", "city_standardized", "state_standardized"}
    if dedup and not made & {*df.columns, *order_by}:
        # they follow from the input columns, so the dedup chooses without carrying them: only what it is keyed by is made before
        by_city = "city" not in out.columns
        keyed = standardize_location(out, loc_col).drop("state_standardized") if by_city else out
        out = remove_duplicates(fill_missing(keyed), order_by)
        if by_city:
            out = derived(out.withColumnRenamed("city_standardized", "_city")).withColumn("city_standardized", F.col("_city")).drop("_city")
        else:
            out = derived(out)
    else:
        out = fill_missing(derived(out))
        if dedup:
            out = remove_duplicates(out, order_by)
    out = with_role_category(out)
    out = out.withColumn("skill_count", F.size("skills_normalized").cast("bigint")) if with_skills else out
    return out if columns is None else out.select(*columns)


def with_role_category(df: DataFrame, col: str = "title_standardized", out: str = "role_category") -> DataFrame:
    """B7 as a frame step: the lower-cased title is computed once for all rules."""
    staged = df.withColumn("_role_low", F.lower(F.col(col)))
    return staged.withColumn(out, first_contains_label(F.col("_role_low"), V.ROLE_RULES, F.lit(V.ROLE_DEFAULT))) \
        .drop("_role_low")


def data_quality_report(df: DataFrame) -> DataFrame:
    """One row of quality metrics.

    Duplicates are counted over the non-list columns as rows minus distinct
    rows (nulls compare equal, as in pandas).
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, ArrayType)]
    metrics = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("title_standardized").alias("unique_titles"),
        F.count_distinct("company").alias("unique_companies"),
        F.count_distinct("city_standardized").alias("unique_cities"),
        F.avg("skill_count").alias("avg_skills_per_job"),
        F.count_if(F.col("skill_count") == 0).alias("jobs_with_no_skills"),
    )
    distinct_rows = df.select(*plain).distinct().agg(F.count(F.lit(1)).alias("_distinct"))
    return (metrics.crossJoin(distinct_rows)
            .withColumn("duplicate_count", F.col("total_records") - F.col("_distinct"))
            .drop("_distinct"))


def cleaned_summary(df: DataFrame) -> DataFrame:
    """The six summary metrics as long (metric, value) rows.

    The most common role is the mode, ties broken by name (pandas ``mode()``
    returns sorted modes and the first is taken).
    """
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("company").alias("companies"),
        F.count_distinct("city_standardized").alias("cities"),
        F.count_distinct("title_standardized").alias("titles"),
        F.round(F.avg("skill_count"), 2).alias("avg_skills"),
    )
    mode = (df.where(F.col("role_category").isNotNull()).groupBy("role_category").count()
            .agg(F.min_by("role_category", F.struct(-F.col("count"), F.col("role_category"))).alias("mode")))
    both = stats.crossJoin(mode)
    rows = [("Total Jobs", F.col("n").cast("string")),
            ("Unique Companies", F.col("companies").cast("string")),
            ("Unique Cities", F.col("cities").cast("string")),
            ("Unique Job Titles", F.col("titles").cast("string")),
            ("Average Skills per Job", F.col("avg_skills").cast("string")),
            ("Most Common Role Category", F.col("mode"))]
    cells = [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows]
    return both.select(F.explode(F.array(*cells)).alias("m")).select("m.metric", "m.value")
