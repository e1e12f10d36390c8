"""Search and serving queries (H1-H6).

Filters are column predicates, so Catalyst pushes what parquet can evaluate
(dates, equality) to the scan; ``contains`` on free text is evaluated row-wise
after pruning. Newest-first with a limit plans as TakeOrderedAndProject.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEARCH_FIELDS = ("title", "company", "description", "location")
TIE_COLS = ("job_id", "title", "company", "location", "description")


def _contains_ci(c: str, q: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q.strip().lower())


def newest_first(ts_col: str, tie_cols: Sequence[str] = TIE_COLS) -> list[Column]:
    return [F.col(ts_col).desc_nulls_last()] + [F.col(c).asc_nulls_first() for c in tie_cols]


def search(df: DataFrame, q: str, fields: Sequence[str] = SEARCH_FIELDS, ts_col: str = "posted_at",
           limit: int = 50, tie_cols: Sequence[str] = TIE_COLS) -> DataFrame:
    """H1: case-insensitive substring in any field; newest first; limit.

    The query is matched literally (no LIKE wildcards).
    """
    cond = None
    for f in fields:
        c = _contains_ci(f, q)
        cond = c if cond is None else cond | c
    return df.where(cond).orderBy(*newest_first(ts_col, tie_cols)).limit(limit)


def by_field(df: DataFrame, field: str, q: str, ts_col: str = "posted_at", limit: int = 50,
             tie_cols: Sequence[str] = TIE_COLS) -> DataFrame:
    """H2: postings whose ``field`` contains ``q`` (company / location), newest first."""
    return search(df, q, (field,), ts_col, limit, tie_cols)


def recent(df: DataFrame, as_of: str, days: int = 7, ts_col: str = "posted_at", limit: int = 100,
           tie_cols: Sequence[str] = TIE_COLS) -> DataFrame:
    """H3: rows whose day is on or after ``as_of - days``; newest first; limit.

    A date predicate on the timestamp column, which parquet min/max stats and
    date partitions can prune.
    """
    start = F.date_sub(F.to_date(F.lit(as_of)), days)
    return df.where(F.to_date(ts_col) >= start).orderBy(*newest_first(ts_col, tie_cols)).limit(limit)


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """H4: one page with the total row count on every row; a limit outside 1..200 or a negative offset is an error."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))


def keyset_page(df: DataFrame, keys: str | Sequence[str], after: Sequence[object] | object | None = None, limit: int = 50) -> DataFrame:
    """H4 at scale: the next ``limit`` rows after a key (no offset scan, no shuffle of rows).

    ``keys`` should tell rows apart: a page ends between two rows, and the next one begins after its last
    row's whole key. Rows that share the whole key are told apart by ``page_key``, a digest of the row and, for equal
    rows, their number; it is the last part of ``after``, so pass the last row's values of (*keys, page_key). Nulls come first.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [F.col(c).asc_nulls_first() for c in keys]
    digest = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    rows, seen, last = df, 0, None
    if after is not None:
        *values, page_key = list(after)
        if len(values) != len(keys):
            raise ValueError("after must hold a value for each key and the page_key")
        last, number = page_key.rsplit("-", 1)
        seen = int(number)  # rows equal to the last one that earlier pages have shown
        later, same = F.lit(False), F.lit(True)
        for c, x in zip(keys, values, strict=True):
            bigger = F.col(c).isNotNull() if x is None else F.col(c) > F.lit(x)
            later = later | (same & F.coalesce(bigger, F.lit(False)))
            same = same & F.col(c).eqNullSafe(F.lit(x))
        rows = rows.where(later | (same & (digest >= last)))
    most = limit + seen
    # the page's last key by the keys alone: only rows up to it are digested
    packed = F.struct(*[F.col(c) for c in keys])
    bound = rows.select(*keys).orderBy(*order).limit(most).agg(F.max(packed).alias("_bound"))
    near = rows.crossJoin(F.broadcast(bound)).where(packed <= F.col("_bound")).drop("_bound").withColumn("_d", digest)
    first = near.orderBy(*order, "_d").limit(most)
    nth = F.row_number().over(Window.partitionBy("_d").orderBy("_d"))
    paged = first.withColumn("_n", nth)
    if last is not None:
        paged = paged.where((F.col("_d") != last) | (F.col("_n") > seen))
    paged = paged.withColumn("page_key", F.concat_ws("-", "_d", F.lpad(F.col("_n").cast("string"), 12, "0"))).drop("_d", "_n")
    return paged.orderBy(*order, "page_key").limit(limit)


def section(analysis: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """H5: one section of the long analysis frame (section, rank, key, value)."""
    out = analysis.where(F.col("section") == name)
    if n is not None:
        out = out.where(F.col("rank") <= n)
    return out


def latest_partition(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """H6: rows of the newest snapshot date (partition-pruned when partitioned by it)."""
    newest = df.agg(F.max(date_col).alias("_d"))
    return df.join(F.broadcast(newest), F.col(date_col) == F.col("_d")).drop("_d")
