"""Reading the same table from many shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardline.operators.sets import union_all


def linked_table(
    spark: SparkSession,
    table: str,
    *,
    url: str | None = None,
    path: str | None = None,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Lazy scan of a shard's table, over JDBC (read in key ranges) or from Parquet files."""
    if path is not None:
        return spark.read.parquet(path)
    if url is None:
        raise ValueError("give a JDBC url or a path")
    return spark.read.format("jdbc").options(**jdbc_options(table, url, key, bounds, partitions), **options).load()


def jdbc_options(
    table: str, url: str, key: str | None, bounds: tuple[int, int] | None, partitions: int
) -> dict[str, str]:
    settings = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if key is not None and bounds is not None:
        settings |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return settings


def all_shards_of(frames: Mapping[int, DataFrame]) -> DataFrame:
    """One frame over all shards with ``shard_index``; a single job reads them side by side."""
    return union_all([df.withColumn("shard_index", F.lit(index)) for index, df in frames.items()])


def shard_rows(df: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of the active shards of a combined frame; the shard list is read as one array."""
    listed = active.agg(F.collect_set("shard_index").alias("a")).scalar()
    return df.where(F.array_contains(listed, F.col("shard_index")))
