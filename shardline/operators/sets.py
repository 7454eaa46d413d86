"""Set operations and symmetric differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    return union_all(frames).distinct()


def one_sided(
    local: DataFrame,
    remote: DataFrame,
    keys: Sequence[str],
    carry: Sequence[str] = (),
    labels: tuple[str, str] = ("Local Table", "Remote Table"),
) -> DataFrame:
    """Rows whose ``keys`` occur once over both sides, with the side in ``table_location``."""
    sides = [
        frame.select(F.lit(label).alias("table_location"), *keys, *carry)
        for frame, label in ((local, labels[0]), (remote, labels[1]))
    ]
    picked: list[Column] = [F.min("table_location").alias("table_location")]
    picked += [F.min(c).alias(c) for c in carry]
    grouped = union_all(sides).groupBy(*keys).agg(*picked, F.count("*").alias("_n"))
    return grouped.where("_n = 1").drop("_n")


def listing_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Lines of one listing that the other lacks, counting repeats ('<' source, '>' target)."""
    signed = union_all([source.withColumn("_sign", F.lit(1)), target.select(*source.columns).withColumn("_sign", F.lit(-1))])
    counted = signed.groupBy(*source.columns).agg(F.sum("_sign").alias("_balance")).where("_balance <> 0")
    return counted.select(
        F.when(F.col("_balance") > 0, "<").otherwise(">").alias("side"),
        *source.columns,
        F.abs("_balance").alias("copies"),
    )
