"""Control ledger: delta window, download entries, status checks and reconciliation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from shardline.functions.scalars import nearest_half_hour, thousands, whole_hours

MIN_GAP_HOURS = 2
CATCH_UP_HOURS = 3
DELTA = "DELTA"


def _hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def delta_window(last: Column | str, now: Column | str) -> dict[str, Column]:
    """{is_due, start, end} of the next download after ``last`` (NULL: never).

    The window starts an hour before the last end, or a day before it around midnight, so
    late rows are read again; it ends two hours after it, or now when four hours or more
    have passed.
    """
    last = F.col(last) if isinstance(last, str) else last
    now = F.col(now) if isinstance(now, str) else now
    gap = whole_hours(last, now)
    first = last.isNull()
    midnight = F.hour(last).isin(0, 1)
    from_last, from_now = nearest_half_hour(last), nearest_half_hour(now)
    start = F.when(first, from_now - _hours(24)).when(midnight, from_last - _hours(24)).otherwise(from_last - _hours(1))
    end = F.when(first | (gap > CATCH_UP_HOURS), from_now).otherwise(from_last + _hours(2))
    return {"is_due": first | (gap >= MIN_GAP_HOURS), "start": start, "end": end}


def last_end(ledger: DataFrame) -> Column:
    return ledger.where("download_status = 1").agg(F.max("control_end_dtm")).scalar()


def last_number(ledger: DataFrame) -> Column:
    return F.coalesce(ledger.agg(F.max("download_num")).scalar(), F.lit(0))


def close_processed(ledger: DataFrame) -> DataFrame:
    """Mark the entries of the last download that moved rows or took time as downloaded."""
    number = last_number(ledger)
    done = (
        (F.col("download_num") == number)
        & (F.col("download_status") == 0)
        & ((F.coalesce("proc_rows", F.lit(0)) > 0) | (F.coalesce("proc_duration", F.lit(0)) > 0))
    )
    return ledger.withColumns(
        {
            "append_status": F.when(done & (number == 1), 1).otherwise(F.col("append_status")),
            "download_status": F.when(done, 1).otherwise(F.col("download_status")),
        }
    )


def unfinished(ledger: DataFrame) -> DataFrame:
    """Entries of the last download still to be loaded."""
    return ledger.where((F.col("download_num") == last_number(ledger)) & (F.col("download_status") == 0))


def next_entries(
    ledger: DataFrame, sources: DataFrame, profiles: DataFrame, start: Column, end: Column, control_type: str
) -> DataFrame:
    """Ledger rows of the next download: one per active, valid source of an active shard."""
    active = profiles.where("status = 1").select("shard_profile_id", "shard_table_name")
    chosen = sources.where("src_table_load_status = 1 AND src_table_valid_status = 1").join(active, "shard_profile_id")
    chosen = chosen.where(F.col("src_table_name") != F.col("shard_table_name"))
    return chosen.select(
        (last_number(ledger) + 1).alias("download_num"),
        "src_table_id",
        "host_alias",
        "shard_number",
        "src_schema_name",
        "src_table_name",
        F.lit(0).alias("download_status"),
        F.lit(0).alias("append_status"),
        F.lit(control_type).alias("control_type"),
        F.least(start, F.col("override_dtm")).alias("control_start_dtm"),
        end.alias("control_end_dtm"),
        F.lit(0).cast("long").alias("proc_rows"),
        F.lit(0).cast("long").alias("proc_duration"),
    )


def is_running(ledger: DataFrame, now: dt.datetime) -> DataFrame:
    """is_running = 1 when an entry of the last day is not downloaded or not appended."""
    recent = whole_hours(F.col("control_end_dtm"), F.lit(now).cast("timestamp_ntz")) <= 24
    open_entry = recent & ((F.col("download_status") == 0) | (F.col("append_status") == 0))
    return ledger.agg(F.coalesce(F.max(open_entry.cast("int")), F.lit(0)).alias("is_running"))


def last_migrated(ledger: DataFrame) -> DataFrame:
    """The newest finished entry as one line of text."""
    newest = ledger.where("download_status = 1").agg(F.max("control_download_id")).scalar()
    text = F.concat(
        F.lit("DB: "), "host_alias",
        F.lit("; Shard: "), "shard_number",
        F.lit("; Table: "), "src_table_name",
        F.lit("; Rows="), thousands("proc_rows"),
        F.lit("; Duration="), thousands("proc_duration"),
        F.lit("sec; Finished: "), F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss"),
    )
    return ledger.where(F.col("control_download_id") == newest).select(text.alias("last_migrated_table"))


def appended_rows(ledger: DataFrame, stage_rows: DataFrame, number: int | None = None) -> DataFrame:
    """Populated against appended rows of one download (default: the last), with a text line.

    ``stage_rows`` holds (src_table_name, dtm): the change time of every row now in stage.
    """
    wanted = last_number(ledger) if number is None else F.lit(number)
    entries = ledger.where(
        (F.col("control_type") == DELTA)
        & (F.col("download_status") == 1)
        & (F.col("append_status") == 1)
        & (F.col("download_num") == wanted)
    )
    loaded = entries.agg(
        F.max("download_num").alias("download_num"),
        F.coalesce(F.sum("proc_rows"), F.lit(0)).alias("proc_rows"),
        F.coalesce(F.sum("proc_duration"), F.lit(0)).alias("proc_duration"),
    ).where(F.col("download_num").isNotNull())
    # by table and day, so that one big table is no hot join key; a row has one day and meets each window once
    days = F.sequence(F.to_date("control_start_dtm"), F.to_date("control_end_dtm"))
    spans = entries.where("control_start_dtm <= control_end_dtm").select(
        "src_table_name", "control_start_dtm", "control_end_dtm", F.explode(days).alias("_day")
    )
    hits = stage_rows.withColumn("_day", F.to_date("dtm")).join(spans, ["src_table_name", "_day"]).where(
        F.col("dtm").between(F.col("control_start_dtm"), F.col("control_end_dtm"))
    )
    appended = hits.agg(F.count("*")).scalar()
    text = F.concat(
        F.lit("Download # "), "download_num",
        F.lit("; Rows= "), thousands("proc_rows"),
        F.lit("; Duration= "), thousands("proc_duration"),
        F.lit(" sec; Appended Rows= "), thousands("appended_rows"),
    )
    return loaded.withColumn("appended_rows", appended).withColumn("summary", text)


def initial_rows(sources: DataFrame, rows: DataFrame, keys: list[str], only_missing: bool = False) -> DataFrame:
    """Row count per source table and shard; ``only_missing`` keeps counts already known."""
    todo = sources.where(F.coalesce("initial_rows", F.lit(0)) <= 0) if only_missing else sources
    wanted = todo.select(*keys).distinct()
    counted = rows.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("_counted"))
    known = F.col("initial_rows")
    fresh = F.coalesce("_counted", F.lit(0))
    value = F.when(F.coalesce(known, F.lit(0)) > 0, known).otherwise(fresh) if only_missing else fresh
    return sources.join(counted, keys, "left").withColumn("initial_rows", value).drop("_counted")
