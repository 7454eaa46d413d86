"""Drop log rows that repeat the previous version of their master row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shardline.functions.scalars import tracked_columns
from shardline.operators.ordered import with_previous


def mark_repeats(
    log: DataFrame,
    master_key: str,
    log_key: str,
    dtm: str,
    columns: Sequence[str] | None = None,
    spans: int | None = None,
) -> DataFrame:
    """Log rows with ``is_repeated``: same tracked values as the row before, by (dtm, log key)."""
    tracked = list(columns) if columns else tracked_columns(log.columns, [master_key, log_key, dtm])
    valued = log.withColumn("_now", F.struct(*tracked))
    looked = with_previous(valued, [master_key], [dtm, log_key], {"_now": "_before"}, spans)
    repeated = F.col("_has_previous") & F.col("_now").eqNullSafe(F.col("_before"))
    return looked.withColumn("is_repeated", repeated).drop("_now", "_before", "_has_previous")


def compact_log(log: DataFrame, master_key: str, log_key: str, dtm: str, columns=None, spans: int | None = None) -> DataFrame:
    """First row of every run of equal versions; running it twice changes nothing."""
    marked = mark_repeats(log, master_key, log_key, dtm, columns, spans)
    return marked.where(~F.col("is_repeated")).drop("is_repeated")


def compaction_stats(marked: DataFrame, master_key: str, by: Sequence[str] = ()) -> DataFrame:
    """Entries (master rows), total and deleted log rows, per table when ``by`` names one."""
    per_entry = marked.groupBy(*by, master_key).agg(
        F.count("*").alias("_total"), F.count_if("is_repeated").alias("_deleted")
    )
    return per_entry.groupBy(*by).agg(
        F.count("*").alias("entries_num"),
        F.sum("_total").alias("total_rows"),
        F.sum("_deleted").alias("deleted_rows"),
    )
