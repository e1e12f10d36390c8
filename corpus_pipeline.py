"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. toxicity   documents that the string-kernel classifier rejects go
2. exact      of equal texts (A-Z lower-cased) the one with the largest id stays
3. near       of each component of 5-word-shingle Jaccard links of 0.8 or more, the smallest id stays
4. mix        sources are mixed to their target weights by the cube method; a document that is taken twice stands twice
5. pack       whole texts are encoded and packed into sequences of 2048 tokens

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.llm.exact_dedup import drop_duplicates
from postlens.llm.files import written
from postlens.llm.jaccard_join import keep_one_of_each
from postlens.llm.mixing import mix
from postlens.llm.packing import pack_documents
from postlens.llm.toxicity import drop_toxic


#: Whole texts go to the Python workers in batches of so many rows, for JVM and Python both hold a batch. The
#: pipeline sets this for its session; Spark's own 10,000 rows are made for short ones.
ROWS_PER_BATCH = 2_000


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return pack_documents(docs, end_id=1, keep_encoder=False)


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("mix", mixed), ("pack", packed)]

# The classifier, the cube method and the tokenizer cannot be said in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
