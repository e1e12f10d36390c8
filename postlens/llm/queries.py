"""One registered query per operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"), end_id=2)


@query
def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.packing import pack_documents

    # of a sequence at least two ids bear no loss (those that begin a document, or padding): the third limit acts
    return pack_documents(table(spark, sf_dir, "documents"), end_id=1, max_loss=2046)


@query
def op4_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.exact_dedup import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"))


ORACLES["op4_bloom_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query
def op10_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


@query
def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.secrets import scan_digest

    return scan_digest(table(spark, sf_dir, "documents"))


@query
def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


@query
def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.jaccard_join import components_of_documents

    return components_of_documents(table(spark, sf_dir, "documents"))


@query
def op11_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.ranked_search import top_documents

    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLES["op12_best_position_search"] = f"""
WITH d AS (SELECT doc_id, ts, len(ts) AS n FROM (SELECT doc_id, {_TERMS} AS ts FROM documents) WHERE len(ts) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
o AS (SELECT doc_id, n, unnest(ts) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll))))) AS BIGINT) AS score
      FROM p JOIN w USING (term) JOIN q USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@query
def op13_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postlens.llm.language import languages

    return languages(table(spark, sf_dir, "documents"))
