"""Writing reports, archives and stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardline.session import cut_lineage, scratch_path


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header, every value quoted and quotes doubled."""
    text = df.select([F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in df.columns])
    text.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def distinct_items(report: DataFrame, column: str = "item_id") -> DataFrame:
    return report.agg(F.count_distinct(column).alias("items"))


def month_of(ts: str):
    return F.date_format(ts, "yyyyMM")


def archive_months(df: DataFrame, ts: str, path: str) -> None:
    """Write month partitions; the rebalance joins small months and splits big ones."""
    df.withColumn("yyyymm", month_of(ts)).hint("rebalance", "yyyymm").write.partitionBy("yyyymm").parquet(path)


def count_check(source: DataFrame, copied: DataFrame, key: str) -> DataFrame:
    """Row counts per key before and after a copy."""
    before = source.groupBy(key).agg(F.count("*").alias("rows_before"))
    after = copied.groupBy(key).agg(F.count("*").alias("rows_after"))
    zero = F.lit(0)
    return before.join(after, key, "full").select(
        key,
        F.coalesce("rows_before", zero).alias("rows_before"),
        F.coalesce("rows_after", zero).alias("rows_after"),
    )


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back."""
    return cut_lineage(df, name)


def distribute(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """All rows of a key in one partition."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str, path: str | None = None) -> None:
    """Table whose later joins and aggregates on ``keys`` need no shuffle.

    The rows are dealt to the buckets first, so each bucket is one file however many tasks the source
    has. ``path`` puts the files outside the warehouse.
    """
    writer = distribute(df, *keys, partitions=buckets).write.bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """The rows from a bucketed table below the application's folder."""
    table = f"{name}_{uuid.uuid4().hex}"
    write_bucketed(df, table, buckets, *keys, path=scratch_path(df.sparkSession, name))
    return df.sparkSession.table(table)


def promote(df: DataFrame, path: str, partition: str) -> None:
    """Write a staged frame to its final place, replacing only the partitions it holds."""
    (
        df.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
