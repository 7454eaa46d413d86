"""Space, metric, profile and event-log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardline.gallery.base import div, fixed, query
from shardline.operators.aggregates import column_profile, percent, sum_named
from shardline.operators.ordered import with_line_number
from shardline.plans import eventlog, metrics, storage

BLOCK = 8192
MB = storage.MB


def _mb(blocks: str, digits: int) -> str:
    return fixed(div(f"({blocks}) * {BLOCK}", str(MB)), 6, digits)


def _usage_sql(total: str, used: str) -> str:
    free = f"({total} - COALESCE({used}, 0))"
    return f"""{_mb(total, 0)} AS total, COALESCE({_mb(used, 3)}, 0) AS used_mb, {_mb(free, 3)} AS free_mb,
      CASE WHEN {used} IS NOT NULL THEN {fixed(div(f"{used} * 100", total), 6, 3)} END AS use_pct"""


SPACE = """
  f AS (
    SELECT CASE WHEN x.online = 1 THEN x.name ELSE RPAD(x.name, 14, ' ') || ' OFF' END AS tablespace, f.file_name, f.blocks,
           (SELECT SUM(e.length) FROM x_extents e WHERE e.ts = f.ts AND e.file = f.file) AS used
    FROM x_files f JOIN x_spaces x ON x.ts = f.ts WHERE x.online IN (1, 2) AND f.status = 2)"""


@query(
    "r21_tablespace_usage_by_file",
    f"""WITH {SPACE}, lines AS (SELECT tablespace, file_name, {_usage_sql("blocks", "used")} FROM f)
        SELECT * FROM lines
        UNION ALL SELECT 'Total', NULL, SUM(total), ROUND(SUM(used_mb), 3), ROUND(SUM(free_mb), 3), NULL FROM lines""",
)
def _(t):
    return storage.usage_by_file(t.spaces, t.files, t.extents, BLOCK)


TOTALS = f"""WITH {SPACE}, s AS (SELECT tablespace, SUM(blocks) AS b, SUM(used) AS u FROM f GROUP BY tablespace)
  SELECT tablespace, 'Total ' AS file_name, {_usage_sql('b', 'u')} FROM s"""
query("r21_tablespace_usage_total", TOTALS)(lambda t: storage.usage_by_space(t.spaces, t.files, t.extents, BLOCK))


@query(
    "a14_sum_once_per_file",
    """SELECT ts, CAST(SUM(blocks) AS BIGINT) AS blocks, CAST(SUM(length) AS BIGINT) AS length FROM (
         SELECT f.ts, f.file, MAX(f.blocks) AS blocks, SUM(e.length) AS length FROM x_files f
         JOIN x_extents e ON e.ts = f.ts AND e.file = f.file GROUP BY f.ts, f.file) GROUP BY ts""",
)
def _(t):
    used = t.extents.groupBy("ts", "file").agg(F.sum("length").alias("length"))
    files = t.files.select("ts", "file", "blocks").join(used, ["ts", "file"])
    return files.groupBy("ts").agg(F.sum("blocks").alias("blocks"), F.sum("length").alias("length"))


@query(
    "r22_tablespace_report",
    f"""
    WITH r AS (
      SELECT a.tablespace_name, contents, extent_management, status, b.bytes AS size, c.bytes AS free FROM x_tablespaces a
      JOIN (SELECT tablespace_name, SUM(bytes) AS bytes FROM x_data_files GROUP BY 1 UNION SELECT tablespace_name, SUM(bytes) FROM x_temp_files GROUP BY 1) b
        USING (tablespace_name)
      JOIN (SELECT tablespace_name, SUM(bytes) AS bytes FROM x_free_space GROUP BY 1 UNION SELECT tablespace_name, SUM(bytes) FROM x_temp_free GROUP BY 1) c
        USING (tablespace_name))
    SELECT tablespace_name, contents, extent_management, status, {fixed(div("size", str(MB)), 6, 6)} AS size_mb,
           {fixed(div("free", str(MB)), 6, 6)} AS free_mb, {fixed(div("size - free", str(MB)), 6, 6)} AS used_mb FROM r
    UNION ALL SELECT 'Total', NULL, NULL, NULL, {fixed(div("SUM(size)", str(MB)), 6, 6)}, {fixed(div("SUM(free)", str(MB)), 6, 6)},
           {fixed(div("SUM(size - free)", str(MB)), 6, 6)} FROM r""",
)
def _(t):
    return storage.space_report(t.tablespaces, t.data_files, t.temp_files, t.free_space, t.temp_free)


@query(
    "a16_free_chunks",
    """SELECT d.tablespace_name, d.bytes AS sbytes, CAST(SUM(f.bytes) AS BIGINT) AS fbytes, COUNT(*) AS kount
       FROM x_data_files d JOIN x_free_space f ON f.file_id = d.file_id GROUP BY 1, 2""",
)
def _(t):
    return storage.free_chunks(t.data_files, t.free_space)


def _named(*names: str) -> str:
    return "SUM(CASE WHEN name IN (" + ", ".join(f"'{n}'" for n in names) + ") THEN value ELSE 0 END)"


def _r(num: str, den: str) -> str:
    return fixed(div(num, den), 6, 6)


READS, GETS, SEEN = _named("physical reads"), _named("db block gets"), _named("consistent gets")
RATIOS_SQL = f"""
  SELECT {_r(_named("parse count"), _named("opened cursors cumulative"))} AS pcc,
         {_r(_named("recursive calls"), _named("opened cursors cumulative"))} AS rcc,
         {_r(READS, _named("physical writes"))} AS rwr,
         (CAST({div(READS, GETS)} + 1000000 * (CAST({SEEN} AS HUGEINT) + 1) AS DOUBLE) / 1000000) AS hr,
         {_r(f"{GETS} + {SEEN} - {READS}", f"{GETS} + {SEEN}")} AS hit_ratio,
         {_r(f"{_named('table scan blocks gotten')} - 4 * {_named('table scans (short tables)')}", _named("table scans (long tables)"))} AS bpfts
  FROM x_sysstat"""
query("r23_metric_ratios", RATIOS_SQL)(lambda t: metrics.metric_ratios(t.sysstat))
query(
    "a9_name_value_pivot",
    f"SELECT CAST({READS} AS BIGINT) AS reads, CAST({_named('db block gets', 'consistent gets')} AS BIGINT) AS gets FROM x_sysstat",
)(
    lambda t: t.sysstat.agg(
        sum_named("name", "value", "physical reads").alias("reads"),
        sum_named("name", "value", "db block gets", "consistent gets").alias("gets"),
    )
)
query(
    "a10_miss_percent_by_name",
    f"SELECT name, {fixed(div('100 * SUM(misses)', 'SUM(gets)'), 6, 2)} AS miss_pct FROM x_latch GROUP BY name",
)(lambda t: t.latch.groupBy("name").agg(percent(F.sum("misses"), F.sum("gets")).alias("miss_pct")))
query("a10_miss_percent", f"SELECT {fixed(div('100 * SUM(misses)', 'SUM(gets)'), 6, 2)} AS miss_pct FROM x_latch")(
    lambda t: metrics.miss_percent(t.latch, "misses", "gets", "miss_pct")
)
query(
    "r23_wait_contention",
    f"""SELECT class, CAST(SUM(count) AS BIGINT) AS count, {fixed(div("100 * SUM(count)", "(SELECT SUM(count) FROM x_waits)"), 6, 2)} AS contention_pct
        FROM x_waits WHERE class IN ('undo header', 'undo block', 'system undo header') GROUP BY class""",
)(lambda t: metrics.contention(t.waits, ["undo header", "undo block", "system undo header"]))

DOC_COLUMNS = ("lang", "source", "n_chars", "text")
query(
    "r24_table_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) AS num_rows, COUNT(DISTINCT {c}) AS num_distinct, COUNT(*) - COUNT({c}) AS num_nulls,
            {fixed(div(f"SUM(LENGTH(CAST({c} AS VARCHAR)))", f"COUNT({c})"), 6, 6)} AS avg_length,
            1.0::DOUBLE / COUNT(DISTINCT {c}) AS density FROM documents"""
        for c in DOC_COLUMNS
    ),
)(lambda t: column_profile(t.documents, DOC_COLUMNS))


@query(
    "r25_logon_report",
    """SELECT CONCAT('user ', user_id) AS user_name, event_type AS event_action, STRFTIME(ts, '%m/%d/%Y %H:%M:%S') AS event_date,
              CONCAT('10.1.0.', user_id % 250) AS ip_address, user_id % 4 AS instance_num FROM events""",
)
def _(t):
    log = t.events.select(
        F.concat(F.lit("user "), "user_id").alias("user_name"),
        F.col("event_type").alias("event_action"),
        F.col("ts").alias("event_date"),
        F.concat(F.lit("10.1.0."), F.col("user_id") % 250).alias("ip_address"),
        (F.col("user_id") % 4).alias("instance_num"),
    )
    return eventlog.logon_report(log)


@query(
    "r25_ddl_report",
    """SELECT CONCAT('user ', o_custkey) AS user_name, STRFTIME(o_orderdate, '%m/%d/%Y %H:%M:%S') AS ddl_date, o_orderpriority AS ddl_event,
              o_orderstatus AS obj_type, 'owner' AS obj_owner, CONCAT('T', o_orderkey) AS obj_name FROM orders""",
)
def _(t):
    log = t.orders.select(
        F.concat(F.lit("user "), "o_custkey").alias("user_name"),
        F.col("o_orderdate").alias("ddl_date"),
        F.col("o_orderpriority").alias("ddl_event"),
        F.col("o_orderstatus").alias("obj_type"),
        F.lit("owner").alias("obj_owner"),
        F.concat(F.lit("T"), "o_orderkey").alias("obj_name"),
    )
    return eventlog.ddl_report(log)


@query(
    "r25_error_report",
    """SELECT props AS error, STRFTIME(ts, '%m/%d/%Y %H:%M:%S') AS datestamp, CONCAT('user ', user_id) AS username, 'os' AS osuser,
              'm' AS machine, CAST(event_id AS VARCHAR) AS process, event_type AS program FROM events WHERE event_type = 'error'""",
)
def _(t):
    log = t.events.where("event_type = 'error'").select(
        F.col("props").alias("error"),
        F.col("ts").alias("datestamp"),
        F.concat(F.lit("user "), "user_id").alias("username"),
        F.lit("os").alias("osuser"),
        F.lit("m").alias("machine"),
        F.col("event_id").cast("string").alias("process"),
        F.col("event_type").alias("program"),
    )
    return eventlog.error_report(log)


@query(
    "k5_newest_first",
    """SELECT ROW_NUMBER() OVER (ORDER BY events.ts DESC, event_id) AS line_num, event_id, STRFTIME(ts, '%m/%d/%Y %H:%M:%S') AS ts
       FROM events""",
)
def _(t):
    lines = with_line_number(t.events.select("event_id", "ts"), [F.col("ts").desc(), "event_id"])
    return eventlog.event_report(lines, "ts", ["line_num", "event_id", "ts"], ["event_id"])


@query(
    "r26_partition_inventory",
    """SELECT ROW_NUMBER() OVER (ORDER BY STRFTIME(l_shipdate, '%Y%m')) AS partition_position, STRFTIME(l_shipdate, '%Y%m') AS partition_name,
              COUNT(*) AS num_rows, MIN(l_shipdate) AS low_value, MAX(l_shipdate) AS high_value FROM lineitem GROUP BY 2""",
)
def _(t):
    return storage.partition_inventory(t.lineitem, F.date_format("l_shipdate", "yyyyMM"), "l_shipdate")
