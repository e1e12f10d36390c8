"""Where operators put tables of their own: under the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: it is not computed again, and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_rows(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``: whatever its columns are called, they meet no name of ours. Undone by select("row.*")."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
