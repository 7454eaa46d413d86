"""Row movement between link, stage and delta layers.

Plain files have no MERGE: each function returns the new state, to be written beside the
old one and promoted (see ``sources.sinks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shardline.functions.scalars import tracked_columns
from shardline.operators.ordered import latest


def only_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the key set, once each however often the set repeats it."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def only_owned(df: DataFrame, owned: DataFrame, sharding_column: str, account: str = "account_id") -> DataFrame:
    """Rows of the accounts that belong to the shard."""
    mine = owned.select(F.col(account).alias(sharding_column)).distinct()
    return df.join(mine, sharding_column, "left_semi")


def in_window(df: DataFrame, dtm: str | None, start: Column, end: Column) -> DataFrame:
    """Rows changed in [start, end]; everything when the table has no change column."""
    return df if dtm is None else df.where(F.col(dtm).between(start, end))


def load_rows(
    link: DataFrame,
    key: str,
    *,
    owned: DataFrame | None = None,
    sharding_column: str | None = None,
    dtm: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Rows to load, range-partitioned by key so that each task writes one key block."""
    rows = link if dtm is None else in_window(link, dtm, start, end)
    if owned is not None and sharding_column is not None:
        rows = only_owned(rows, owned, sharding_column)
    return rows.repartitionByRange(blocks, key) if blocks else rows.repartitionByRange(key)


def block_size(keys: Column) -> Column:
    """Keys per block for a key count."""
    return F.when(keys > 1_000_000, 1_000_000).when(keys > 100_000, 100_000).otherwise(10_000)


def upsert(stage: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Stage with the delta rows put over it; the first delta row in ``order`` wins its key.

    Only stage rows without a delta key are kept, so a small delta leaves the stage
    unshuffled.
    """
    kept = stage.join(delta.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(latest(delta, keys, order).select(*stage.columns))


def upsert_counts(stage: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many delta keys are new and how many replace a stage row."""
    known = stage.select(*keys).distinct().withColumn("_known", F.lit(True))
    joined = delta.select(*keys).distinct().join(known, list(keys), "left")
    return joined.agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if(F.col("_known")).alias("updated")
    )


def append_new(stage: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Stage plus the delta rows with a key it lacks; of equal delta keys the first stays."""
    fresh = latest(delta, keys, order).join(stage.select(*keys).distinct(), list(keys), "left_anti")
    return stage.unionByName(fresh.select(*stage.columns))


def before_images(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of the keys whose tracked values differ in ``new``."""
    fields = tracked_columns(old.columns, keys)
    after = new.select(*keys, F.struct(*fields).alias("_after"))
    changed = old.join(after, list(keys)).where(~F.struct(*fields).eqNullSafe(F.col("_after")))
    return changed.select(*old.columns)
