"""Registered queries: search and serving (H1-H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import search as H
from postlens.operators.text_index import TextIndex
from postlens.plans.registry import ORACLES, query
from postlens.session import shared_path
from postlens.sources import fixtures

_P = "WITH postings AS (\n" + fixtures.duckdb_view("postings") + "\n)"
_OUT = ["job_id", "title", "company", "location"]
_ORDER = ("posted_at DESC NULLS LAST, job_id NULLS FIRST, title NULLS FIRST, company NULLS FIRST, "
          "location NULLS FIRST, description NULLS FIRST")


def _proj(df):
    return df.select(*_OUT, F.to_date("posted_at").alias("posted_on"))


def _like(field: str, q: str) -> str:
    return f"contains(lower(coalesce({field}, '')), '{q}')"


@query("search_jobs", "H1", oracle=_P + (
    " SELECT job_id, title, company, location, CAST(posted_at AS DATE) AS posted_on FROM postings WHERE "
    + " OR ".join(_like(f, "python") for f in H.SEARCH_FIELDS) + f" ORDER BY {_ORDER} LIMIT 50"))
def q_search_jobs(spark, sf_dir):
    return _proj(H.search(fixtures.postings(spark, sf_dir), "Python", limit=50))


@query("jobs_by_company", "H2", oracle=_P + (
    f" SELECT job_id, title, company, location, CAST(posted_at AS DATE) AS posted_on FROM postings WHERE "
    f"{_like('company', '#00000001')} ORDER BY {_ORDER} LIMIT 50"))
def q_jobs_by_company(spark, sf_dir):
    return _proj(H.by_field(fixtures.postings(spark, sf_dir), "company", "#00000001", limit=50))


@query("jobs_by_location", "H2", oracle=_P + (
    f" SELECT job_id, title, company, location, CAST(posted_at AS DATE) AS posted_on FROM postings WHERE "
    f"{_like('location', 'bangalore')} ORDER BY {_ORDER} LIMIT 50"))
def q_jobs_by_location(spark, sf_dir):
    return _proj(H.by_field(fixtures.postings(spark, sf_dir), "location", "Bangalore", limit=50))


@query("recent_jobs", "H3", oracle=_P + (
    " SELECT job_id, title, company, location, CAST(posted_at AS DATE) AS posted_on FROM postings WHERE "
    f"CAST(posted_at AS DATE) >= DATE '1998-08-01' - INTERVAL 30 DAY ORDER BY {_ORDER} LIMIT 100"))
def q_recent_jobs(spark, sf_dir):
    return _proj(H.recent(fixtures.postings(spark, sf_dir), "1998-08-01", days=30, limit=100))


@query("jobs_page", "H4", oracle=_P + (
    " SELECT job_id, title, company, location, CAST(posted_at AS DATE) AS posted_on, (SELECT count(*) FROM postings) AS total "
    "FROM postings ORDER BY job_id, title NULLS FIRST, company NULLS FIRST, location NULLS FIRST, description NULLS FIRST, "
    "posted_at LIMIT 50 OFFSET 100"))
def q_jobs_page(spark, sf_dir):
    df = fixtures.postings(spark, sf_dir)
    order = [F.col(c).asc_nulls_first() for c in ("job_id", "title", "company", "location", "description", "posted_at")]
    return H.page(df, order, limit=50, offset=100).select(*_OUT, F.to_date("posted_at").alias("posted_on"), "total")


@query("search_documents", "H1", oracle=(
    "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(coalesce(text, '')), 'ouen') "
    "ORDER BY doc_id DESC LIMIT 50"))
def q_search_documents(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    return H.search(docs, "ouen", fields=("text",), ts_col="doc_id", limit=50, tie_cols=()).select(
        "doc_id", "lang", "n_chars")


@query("indexed_search_documents", "H1", oracle=ORACLES["search_documents"])
def q_indexed_search_documents(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    index = TextIndex.build(docs, shared_path(spark, "index"), ["text"])
    return index.search("ouen", ts_col="doc_id", tie_cols=()).select("doc_id", "lang", "n_chars")


@query("indexed_jobs_by_company", "H2", oracle=ORACLES["jobs_by_company"])
def q_indexed_jobs_by_company(spark, sf_dir):
    jobs = fixtures.postings(spark, sf_dir).select(*_OUT, "description", "posted_at")
    return _proj(TextIndex.build(jobs, shared_path(spark, "index"), ["company", "location"]).search("#00000001", ["company"]))
