"""Aggregations, top-k, shares and pivots over postings.

Rank rule: count descending, key ascending (the reference leaves ties to
insertion order). Top-N runs as TakeOrderedAndProject (per-partition top-N,
then a merge of N rows per partition); per-group top-k runs on the already
aggregated (group, key, count) frame. Scalars such as totals are computed as
one-row aggregates and attached with a broadcast of that single row, never
with a global window over an unbounded frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.session import stored


def _one_row(df: DataFrame) -> DataFrame:
    """Mark a one-row aggregate for broadcast (its size is one row by construction)."""
    return F.broadcast(df)


def attach(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``."""
    return df.crossJoin(_one_row(scalars))


def rank_order(count_col: str = "count", key_col: str = "value") -> list[Column]:
    return [F.col(count_col).desc(), F.col(key_col).asc_nulls_first()]


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank a frame whose size is bounded (already limited to N rows)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def value_counts(df: DataFrame, col: str | Column, keep_null: bool = False, name: str = "value") -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    base = df.select(c.alias(name))
    if not keep_null:
        base = base.where(F.col(name).isNotNull())
    return base.groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, col: str | Column, n: int = 15, keep_null: bool = False) -> DataFrame:
    """Top-N values with counts and the number of distinct values.

    ``total_unique`` excludes null (pandas ``nunique``); ``keep_null=True``
    makes null a group, as SQL ``GROUP BY`` does (D18).
    """
    counts = value_counts(df, col, keep_null)
    top = with_rank(counts.orderBy(*rank_order()).limit(n), rank_order())
    uniq = counts.agg(F.count("value").alias("total_unique"))
    return attach(top, uniq).select("rank", "value", "count", "total_unique")


def explode_skills(df: DataFrame, skills_col: str = "skills_normalized", name: str = "skill",
                   keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.explode(skills_col).alias(name))


def skill_counts(df: DataFrame, skills_col: str = "skills_normalized") -> DataFrame:
    """(skill, count) over all mentions; duplicates inside one posting count."""
    return explode_skills(df, skills_col).groupBy("skill").agg(F.count(F.lit(1)).alias("count"))


def top_skills(df: DataFrame, skills_col: str = "skills_normalized", n: int = 20) -> DataFrame:
    """Top-N skills by mentions."""
    order = rank_order("count", "skill")
    return with_rank(skill_counts(df, skills_col).orderBy(*order).limit(n), order).select("rank", "skill", "count")


def top_raw_skills(df: DataFrame, col: str = "skills", n: int = 100) -> DataFrame:
    """D4 variant: comma split, lower, strip, length > 1, top 100."""
    from postlens.functions.text import py_strip

    items = F.transform(F.split(df[col], ","), lambda s: F.lower(py_strip(s)))
    ex = df.where(F.col(col).isNotNull()).select(F.explode(F.filter(items, lambda s: F.length(s) > 1)).alias("skill"))
    counts = ex.groupBy("skill").agg(F.count(F.lit(1)).alias("count"))
    order = rank_order("count", "skill")
    return with_rank(counts.orderBy(*order).limit(n), order).select("rank", "skill", "count")


def skill_share(df: DataFrame, skills_col: str = "skills_normalized", n: int = 30) -> DataFrame:
    """Top-N skills with % of postings that mention them (2 decimals).

    One scan: each posting adds a null marker to its skills, so the null
    group's count is the number of postings.
    """
    marked = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.col(skills_col), F.array().cast("array<string>")))
    counts = df.select(F.explode(marked).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("count"))
    total = counts.where(F.col("skill").isNull()).select(F.col("count").alias("_n"))
    order = rank_order("count", "skill")
    top = with_rank(counts.where(F.col("skill").isNotNull()).orderBy(*order).limit(n), order).select(
        "rank", "skill", "count")
    out = attach(top, total)
    return out.select("rank", "skill", "count",
                      F.round(F.try_divide(F.col("count") * 100.0, F.col("_n")), 2).alias("percentage"))


def share_of_total(df: DataFrame, col: str, n: int | None = None, digits: int = 2) -> DataFrame:
    """Value counts with share of all rows (null rows stay in the denominator)."""
    all_counts = value_counts(df, col, keep_null=True)  # one scan: the total is the sum of all groups
    total = all_counts.agg(F.sum("count").alias("_n"))
    counts = all_counts.where(F.col("value").isNotNull())
    if n is not None:
        counts = counts.orderBy(*rank_order()).limit(n)
    return attach(counts, total).select(
        "value", "count", F.round(F.try_divide(F.col("count") * 100.0, F.col("_n")), digits).alias("percentage"))


def _top_keys(counts: DataFrame, key: str, n: int) -> DataFrame:
    order = rank_order("count", key)
    return with_rank(counts.orderBy(*order).limit(n), order, "key_rank").select(key, "key_rank")


def group_skill_counts(df: DataFrame, group_col: str, skills_col: str = "skills_normalized") -> DataFrame:
    """(grp, skill, count): mentions per group and skill, and under a null skill the group's postings.

    One pass over the postings, stored: matrices, sizes and top lists all come from this frame, whose size
    is the number of distinct (group, skill) pairs.
    """
    marked = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.col(skills_col), F.array().cast("array<string>")))
    counts = df.select(F.col(group_col).alias("grp"), F.explode(marked).alias("skill")).groupBy("grp", "skill").agg(F.count(F.lit(1)).alias("count"))
    return stored(counts, "pairs")


def _skill_totals(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("skill").isNotNull()).groupBy("skill").agg(F.sum("count").alias("count"))


def skill_group_matrix(df: DataFrame, group_col: str, skills_col: str = "skills_normalized",
                       top_n_skills: int = 10) -> DataFrame:
    """(skill, group, count) for the top-N skills, zero-filled over every group.

    The grid is groups x N skills, N a parameter; the top skills are joined in
    as a broadcast of at most N rows.
    """
    counts = group_skill_counts(df, group_col, skills_col)
    grid = counts.select("grp").distinct().crossJoin(F.broadcast(_top_keys(_skill_totals(counts), "skill", top_n_skills)))
    return (grid.join(counts, ["grp", "skill"], "left")
            .select("skill", "grp", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def title_group_pivot(df: DataFrame, title_col: str, group_col: str, top_n: int = 8) -> DataFrame:
    """(group, title, count) for the top-N titles; zero-filled over groups that hold any of them."""
    counts = stored(df.where(F.col(title_col).isNotNull()).groupBy(F.col(group_col).alias("grp"), F.col(title_col).alias("title"))
                    .agg(F.count(F.lit(1)).alias("count")), "pairs")
    top = F.broadcast(_top_keys(counts.groupBy("title").agg(F.sum("count").alias("count")), "title", top_n).select("title"))
    pairs = counts.join(top, "title", "left_semi")
    grid = pairs.select("grp").distinct().crossJoin(top)
    return grid.join(pairs, ["grp", "title"], "left").select(
        "grp", "title", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def skill_pct_by_group(df: DataFrame, group_col: str, skills_col: str = "skills_normalized",
                       top_groups: int | None = 8, top_skills_n: int = 12) -> DataFrame:
    """% of a group's postings that list each top skill, dense with zeros.

    Groups are the top-N by posting count (all groups when ``top_groups`` is
    None); skills are the top-M overall. Both sides are bounded by parameters.
    """
    counts = group_skill_counts(df, group_col, skills_col)
    sizes = counts.where(F.col("skill").isNull() & F.col("grp").isNotNull()).select("grp", F.col("count").alias("grp_size"))
    if top_groups is not None:
        sizes = sizes.orderBy(F.col("grp_size").desc(), F.col("grp").asc()).limit(top_groups)
    grid = sizes.crossJoin(F.broadcast(_top_keys(_skill_totals(counts), "skill", top_skills_n)))
    out = grid.join(counts, ["grp", "skill"], "left").select(
        "grp", "skill", "key_rank", "grp_size", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    return out.withColumn("percentage", F.round(F.col("count") * 100.0 / F.col("grp_size"), 4))


def top_k_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int = 5,
                    name: str = "rank") -> DataFrame:
    """Top-k rows per group (Spark plans this as WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= k)


def skills_per_posting(df: DataFrame, count_col: str = "skill_count", bins: int = 15) -> DataFrame:
    """Mean, exact median and an equal-width histogram (last bin closed)."""
    stats = df.agg(F.avg(count_col).alias("mean"), F.median(count_col).alias("median"),
                   F.min(count_col).alias("_lo"), F.max(count_col).alias("_hi"))
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    stats = stats.select("mean", "median", lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    binned = attach(df.select(count_col), stats).select(
        "mean", "median", "lo", "hi",
        F.least(F.floor((F.col(count_col) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1,
                F.lit(bins)).cast("bigint").alias("bin"))
    return (binned.groupBy("bin", "mean", "median", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
            .select("bin",
                    F.round(F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins, 6).alias("bin_start"),
                    F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 6).alias("bin_end"),
                    "count", F.round("mean", 6).alias("mean"), F.col("median").cast("double").alias("median")))


def category_mentions(counts: DataFrame, categories: Sequence[tuple[str, Sequence[str]]],
                      key: str = "skill") -> DataFrame:
    """Mentions per category; a skill counts in each category holding it; zeros dropped."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(cat, s) for cat, members in categories for s in members],
                                "category string, skill string")
    return (counts.join(F.broadcast(dim), counts[key] == dim["skill"])
            .groupBy("category").agg(F.sum("count").cast("bigint").alias("mentions"))
            .where(F.col("mentions") > 0))


def top_share(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Share of each of the top-k values among the top-k only."""
    counts = value_counts(df, col)
    top = with_rank(counts.orderBy(*rank_order()).limit(k), rank_order())
    tot = top.agg(F.sum("count").alias("_t"))
    return attach(top, tot).select("rank", "value", "count",
                                   F.round(F.col("count") * 100.0 / F.col("_t"), 4).alias("share"))


def scaled_to_max(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    """The first N values by count, each as % of the largest count."""
    counts = value_counts(df, col)
    top = with_rank(counts.orderBy(*rank_order()).limit(n), rank_order())
    mx = top.agg(F.max("count").alias("_m"))
    return attach(top, mx).select("rank", "value", "count",
                                  F.round(F.col("count") * 100.0 / F.col("_m"), 4).alias("bar_pct"))


def per_day(df: DataFrame, ts_col: str, n: int = 7) -> DataFrame:
    """Postings per calendar day, the last N days present."""
    counts = df.groupBy(F.to_date(ts_col).alias("day")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("day").desc_nulls_last()).limit(n)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Value counts of a column with null and blank values removed."""
    c = F.col(col).cast("string")
    return (df.where(c.isNotNull() & (F.length(F.trim(c)) > 0)).groupBy(c.alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


def warehouse_stats(df: DataFrame, n: int = 10, ts_col: str = "posted_at", days: int = 7) -> DataFrame:
    """Totals, distinct companies / locations, postings per day (last N days
    present) and the top companies / locations, where null is a group (as SQL
    GROUP BY keeps it). Long form (section, rank, key, value). One pass counts (kind, key); the sections
    come from that frame."""
    item = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    items = F.array(item("row", F.lit(None)), item("company", F.col("company")), item("location", F.col("location")), item("day", F.to_date(ts_col)))
    counts = stored(df.select(F.explode(items).alias("x")).select("x.*").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("value")), "warehouse")
    own = lambda kind: counts.where(F.col("kind") == kind).select("key", "value")
    totals = counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == "row", F.col("value"))), F.lit(0)).alias("total_jobs"),
                        F.count(F.when(F.col("kind") == "company", F.col("key"))).alias("unique_companies"),
                        F.count(F.when(F.col("kind") == "location", F.col("key"))).alias("unique_locations"))
    tot_rows = totals.select(F.explode(F.array(*[
        F.struct(F.lit("totals").alias("section"), F.lit(None).cast("bigint").alias("rank"),
                 F.lit(k).alias("key"), F.col(k).alias("value"))
        for k in ("total_jobs", "unique_companies", "unique_locations")])).alias("t")).select("t.*")

    def top(kind: str, section: str, order: Sequence[Column], most: int) -> DataFrame:
        return with_rank(own(kind).orderBy(*order).limit(most), order).select(F.lit(section).alias("section"), "rank", "key", "value")

    by_value, by_day = rank_order("value", "key"), [F.col("key").desc_nulls_last()]
    return (tot_rows.unionByName(top("company", "top_companies", by_value, n)).unionByName(top("location", "top_locations", by_value, n))
            .unionByName(top("day", "jobs_by_date", by_day, days)))
