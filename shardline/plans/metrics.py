"""Ratios from name/value snapshots and contention counters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from shardline.functions.scalars import ratio
from shardline.operators.aggregates import percent, sum_named

# Metric names of the ratio report, (numerator, denominator) each.
RATIOS = {
    "pcc": ("parse count", "opened cursors cumulative"),
    "rcc": ("recursive calls", "opened cursors cumulative"),
    "rwr": ("physical reads", "physical writes"),
}
READS, BLOCK_GETS, CONSISTENT_GETS = "physical reads", "db block gets", "consistent gets"
SCANNED, SHORT_SCANS, LONG_SCANS = (
    "table scan blocks gotten",
    "table scans (short tables)",
    "table scans (long tables)",
)
SHORT_SCAN_BLOCKS = 4


def metric_ratios(snapshot: DataFrame, ratios: Mapping[str, tuple[str, str]] = RATIOS) -> DataFrame:
    """Instance ratios from one pass over (name, value); a zero divisor gives 0.

    ``hr`` is the buffer ratio by the report's formula, in which the sign belongs to the bracket alone:
    1 - (reads / block gets + consistent gets) * -1. ``hit_ratio`` is the share of logical reads
    (block gets and consistent gets) that needed no physical read.
    """
    def total(*names: str):
        return sum_named("name", "value", *names)

    cols = {name: ratio(total(num), total(den)) for name, (num, den) in ratios.items()}
    hits = ratio(total(READS), total(BLOCK_GETS)) + total(CONSISTENT_GETS)
    cols["hr"] = 1 + hits
    logical = total(BLOCK_GETS, CONSISTENT_GETS)
    cols["hit_ratio"] = ratio(logical - total(READS), logical)
    cols["bpfts"] = ratio(total(SCANNED) - total(SHORT_SCANS) * SHORT_SCAN_BLOCKS, total(LONG_SCANS))
    return snapshot.agg(*[c.alias(n) for n, c in cols.items()])


def miss_percent(counters: DataFrame, part: str, whole: str, name: str) -> DataFrame:
    """100 * sum(part) / sum(whole), to two places."""
    return counters.agg(percent(F.sum(part), F.sum(whole)).alias(name))


def contention(waits: DataFrame, classes: list[str]) -> DataFrame:
    """Share of each wait class in all waits, in percent with two places."""
    whole = waits.agg(F.sum("count")).scalar()
    chosen = waits.where(F.col("class").isin(classes)).groupBy("class").agg(F.sum("count").alias("count"))
    return chosen.select("class", "count", percent(F.col("count"), whole).alias("contention_pct"))
