"""Identifiers and the layout of instances over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise


def dense_ids(frame: DataFrame, column: str = "uri", out: str = "id") -> DataFrame:
    """IDs 1, 2, ... in the order of ``column`` (distinct values). Rows are sorted into ranges once and written, a file per
    range; a row's place in its file and the number of rows in the ranges before give its ID, so nothing is shuffled again."""
    ranged = frame.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges", options={"maxRecordsPerFile": "0"})
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as partitions
    first = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    placed = ranged.select("*", F.col("_metadata.row_index").alias("_place"))
    return placed.join(F.broadcast(first), "_range").select((F.col("_first") + F.col("_place") + 1).cast("long").alias(out), *frame.columns)


def unique_ids(frame: DataFrame, out: str = "id") -> DataFrame:
    """IDs from 1, unique but neither dense nor stable: no sort, no shuffle. Write the result before using it twice."""
    return frame.select((F.monotonically_increasing_id() + 1).alias(out), *frame.columns)


def type_counts_by_hash(instances: DataFrame) -> DataFrame:
    """How many instances have each set of types (by its hash)."""
    return instances.groupBy(F.hash("types").alias("type_hash")).agg(F.count(F.lit(1)).alias("n"))


def partition_by_type(instances: DataFrame, partitions: int, rows_per_partition: int | None = None) -> DataFrame:
    """Instances of one set of types together, large sets over several partitions (salted by id)."""
    if rows_per_partition is None:
        rows_per_partition = max(1, -(-instances.count() // partitions))
    splits = type_counts_by_hash(instances).select("type_hash", (F.floor(F.col("n") / rows_per_partition) + 1).cast("int").alias("_splits"))
    salted = instances.withColumn("type_hash", F.hash("types")).join(splits, "type_hash").withColumn("_salt", F.pmod("id", "_splits"))
    return salted.repartition(partitions, "type_hash", "_salt").drop("type_hash", "_splits", "_salt")
