"""Positions of sorted values without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import stored


def ordinals(values: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): each distinct non-null value and its position, from 0, among them in ascending order.

    The values are range-partitioned and numbered within their partition; a position is that number and the
    counts of the partitions before (a table of as many rows as there are partitions).
    """
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged.select(column, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_nth")), "ordinals")
    size = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = size.alias("a").join(F.broadcast(size.alias("b")), F.col("b._part") < F.col("a._part"), "left")
    before = before.groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_nth")).cast("int").alias(out))
