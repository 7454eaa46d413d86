"""Space and partition reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardline.functions.scalars import ratio, status_suffix
from shardline.operators.aggregates import with_total_row
from shardline.operators.ordered import with_line_number
from shardline.operators.sets import union_distinct

MB = 1024 * 1024
ONLINE_FILE = 2


def _mb(blocks: Column, block_size: int, digits: int) -> Column:
    return F.round(ratio(blocks * block_size, F.lit(MB)), digits)


def _file_space(spaces: DataFrame, files: DataFrame, extents: DataFrame) -> DataFrame:
    """One row per online file: blocks and used blocks (NULL when the file has no extent)."""
    used = extents.groupBy("ts", "file").agg(F.sum("length").alias("used_blocks"))
    online = spaces.where(F.col("online").isin(1, 2))
    return (
        files.where(F.col("status") == ONLINE_FILE)
        .join(online, "ts")
        .join(used, ["ts", "file"], "left")
        .withColumn("tablespace", status_suffix("online", "name"))
    )


def _usage(total: Column, used: Column, block_size: int) -> list[Column]:
    return [
        _mb(total, block_size, 0).alias("total"),
        F.coalesce(_mb(used, block_size, 3), F.lit(0)).alias("used_mb"),
        _mb(total - F.coalesce(used, F.lit(0)), block_size, 3).alias("free_mb"),
        F.round(ratio(used * 100, total), 3).alias("use_pct"),
    ]


def usage_by_file(spaces: DataFrame, files: DataFrame, extents: DataFrame, block_size: int) -> DataFrame:
    """A line per online file, and a grand total of the rounded figures without a share."""
    rows = _file_space(spaces, files, extents)
    lines = rows.select("tablespace", "file_name", *_usage(F.col("blocks"), F.col("used_blocks"), block_size))
    figures = ["total", "used_mb", "free_mb"]
    total = lines.agg(*[F.sum(c).alias(c) for c in figures])
    none = {c: F.lit(None).cast(lines.schema[c].dataType) for c in ("file_name", "use_pct")}
    return lines.unionByName(total.withColumns({"tablespace": F.lit("Total"), **none}))


def usage_by_space(spaces: DataFrame, files: DataFrame, extents: DataFrame, block_size: int) -> DataFrame:
    """Totals per tablespace; a file's blocks count once, however many extents it has."""
    rows = _file_space(spaces, files, extents)
    sums = rows.groupBy("tablespace").agg(F.sum("blocks").alias("_all"), F.sum("used_blocks").alias("_used"))
    return sums.select(
        "tablespace", F.lit("Total ").alias("file_name"), *_usage(F.col("_all"), F.col("_used"), block_size)
    )


def space_report(
    spaces: DataFrame, data_files: DataFrame, temp_files: DataFrame, free: DataFrame, temp_free: DataFrame
) -> DataFrame:
    """Size, free and used MB per tablespace with a Total line.

    Free extents are summed on their own, so several files do not inflate them.
    """
    def per_space(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tablespace_name").agg(F.sum("bytes").alias(name))

    size = union_distinct([per_space(data_files, "size"), per_space(temp_files, "size")])
    empty = union_distinct([per_space(free, "free"), per_space(temp_free, "free")])
    rows = spaces.join(size, "tablespace_name").join(empty, "tablespace_name")
    sums = {
        "size_mb": ratio(F.sum("size"), F.lit(MB)),
        "free_mb": ratio(F.sum("free"), F.lit(MB)),
        "used_mb": ratio(F.sum(F.col("size") - F.col("free")), F.lit(MB)),
    }
    keys = ["tablespace_name", "contents", "extent_management", "status"]
    return with_total_row(rows, keys, sums)


def free_chunks(files: DataFrame, free: DataFrame) -> DataFrame:
    """Free bytes and number of free chunks per data file."""
    chunks = free.groupBy("file_id").agg(F.sum("bytes").alias("fbytes"), F.count("*").alias("kount"))
    rows = files.select("file_id", "tablespace_name", F.col("bytes").alias("sbytes")).join(chunks, "file_id")
    return rows.groupBy("tablespace_name", "sbytes").agg(
        F.sum("fbytes").alias("fbytes"), F.sum("kount").alias("kount")
    )


def partition_inventory(df: DataFrame, part: Column, value: str) -> DataFrame:
    """Name, position, rows, lowest and highest value of each partition.

    Positions count partitions, so the window sees one row per partition.
    """
    parts = df.groupBy(part.alias("partition_name")).agg(
        F.count("*").alias("num_rows"), F.min(value).alias("low_value"), F.max(value).alias("high_value")
    )
    return with_line_number(parts, ["partition_name"], "partition_position")
