"""Incremental loads, ledger, log compaction and schema differences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shardline.elt import compaction, incremental, ledger, load, registry, schema_diff
from shardline.functions import predicates as P
from shardline.gallery.base import query
from shardline.operators.ordered import latest
from shardline.sources import shards, sinks
from shardline.streaming import delta as streaming

def newest() -> list:
    return [F.col("o_orderdate").desc(), F.col("o_orderstatus").desc(), "o_totalprice"]


# ---- sources and sinks ----
@query("s1_linked_scan", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM orders")
def _(t):
    link = shards.linked_table(t.spark, "orders", path=f"{t.folder}/orders.parquet")
    return link.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query(
    "s6_month_archive_with_counts",
    "SELECT STRFTIME(o_orderdate, '%Y%m') AS yyyymm, COUNT(*) AS rows_before, COUNT(*) AS rows_after FROM orders GROUP BY 1",
)
def _(t):
    path = sinks.scratch_path(t.spark, "archive")
    sinks.archive_months(t.orders, "o_orderdate", path)
    copied = t.spark.read.parquet(path).withColumn("yyyymm", F.col("yyyymm").cast("string"))
    return sinks.count_check(t.orders.withColumn("yyyymm", sinks.month_of("o_orderdate")), copied, "yyyymm")


@query(
    "s7_distribution_by_key",
    "SELECT l_suppkey, COUNT(*) AS n, CAST(1 AS BIGINT) AS partitions FROM lineitem GROUP BY l_suppkey",
)
def _(t):
    spread = sinks.distribute(t.lineitem.select("l_suppkey"), "l_suppkey", partitions=16)
    placed = spread.withColumn("p", F.spark_partition_id()).groupBy("l_suppkey", "p").agg(F.count("*").alias("n"))
    return placed.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.count("*").alias("partitions"))


@query(
    "s7_join_of_bucketed_tables",
    """SELECT o_orderkey, o_orderpriority, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS quantity
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""",
)
def _(t):
    orders = sinks.bucketed(t.orders.select("o_orderkey", "o_orderpriority"), "orders", 16, "o_orderkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    lines = sinks.bucketed(lines, "lines", 16, "o_orderkey")
    sums = orders.join(lines, "o_orderkey").groupBy("o_orderkey", "o_orderpriority")
    return sums.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(
    "s8_month_partition_layout",
    "SELECT '199712' AS yyyymm, l_linestatus, COUNT(*) AS n FROM lineitem WHERE STRFTIME(l_shipdate, '%Y%m') = '199712' GROUP BY 2",
)
def _(t):
    path = sinks.scratch_path(t.spark, "months")
    sinks.archive_months(t.lineitem.select("l_shipdate", "l_linestatus"), "l_shipdate", path)
    month = t.spark.read.parquet(path).where("yyyymm = 199712")
    return month.groupBy(F.col("yyyymm").cast("string").alias("yyyymm"), "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "s9_staged_result",
    """WITH s AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey)
       SELECT o_custkey, n FROM s WHERE n = (SELECT MAX(n) FROM s)""",
)
def _(t):
    sums = sinks.staged(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "stage")
    return sums.where(F.col("n") == sums.agg(F.max("n")).scalar())


# ---- catalog of sources ----
def _columns_sql(host: str) -> str:
    dtm = """MAX(CASE WHEN column_name IN ('modified_dtm', 'last_mod_time', 'log_created_dtm', 'log_modified_dtm')
              AND (table_name NOT LIKE '%!_log' ESCAPE '!' OR column_name LIKE 'log!_%' ESCAPE '!') THEN column_name END)"""
    sharding = "'dummy_account_id'" if host == "db1" else "'account_id', 'owner_account_id'"
    pk = """CASE WHEN table_name LIKE '%!_log' ESCAPE '!' THEN REPLACE(column_name, '_log', '') ELSE column_name END"""
    alias = "LOWER(REGEXP_REPLACE(array_to_string(list_transform(string_split(REPLACE(table_name, '_', ' '), ' '), lambda w: UPPER(w[1]) || w[2:]), ' '), '[a-z ]', '', 'g'))"
    return f"""
    q AS (
      SELECT table_schema, table_name, {alias} AS src_table_alias,
             FIRST({pk} ORDER BY ordinal_position, column_name) FILTER (column_key = 'PRI') AS pk,
             MAX(CASE WHEN ordinal_position = 1 THEN column_name END) AS first_column, {dtm} AS dtm_column_name,
             MAX(CASE WHEN column_name IN ({sharding}) AND column_key <> 'PRI' THEN column_name END) AS sharding_column_name
      FROM x_catalog WHERE table_name NOT LIKE 'brand_2%' GROUP BY table_schema, table_name),
    src AS (
      SELECT '{host}' AS host_alias, table_schema AS src_schema_name, table_name AS src_table_name, src_table_alias,
             CASE WHEN CONTAINS(table_name, '_log') THEN 'LOG' ELSE 'MASTER' END AS src_table_type, dtm_column_name, sharding_column_name,
             COALESCE(pk, first_column) AS proc_pk_column_name,
             CASE WHEN dtm_column_name IS NULL THEN -1 WHEN pk IS NULL THEN 0 WHEN table_name LIKE '%!_log' ESCAPE '!' THEN 1000000
                  ELSE {0 if host == "db1" else 100000} END AS proc_block_size, shard_profile_id, shard_number
      FROM q JOIN x_shard_profiles ON host_alias = '{host}' AND status = 1)"""


def _sources(t, host: str):
    chosen = P.name_lists("table_name", unlike="brand_2%")
    return registry.register_sources(t.catalog, t.shard_profiles, host, chosen)


for _host in ("db1", "db2"):
    query(f"e1_register_sources_{_host}", f"WITH {_columns_sql(_host)} SELECT * FROM src")(
        lambda t, host=_host: _sources(t, host).drop("src_table_load_status", "src_table_valid_status")
    )

VALIDATE = f"""
  WITH {_columns_sql("db2")},
  k AS (
    SELECT table_schema, table_name, MAX(CASE WHEN column_name IN ('modified_dtm', 'last_mod_time') THEN 1 ELSE 0 END) AS m,
           MAX(CASE WHEN column_name = 'log_created_dtm' THEN 1 ELSE 0 END) AS l, MAX(CASE WHEN column_key = 'PRI' THEN 1 ELSE 0 END) AS p
    FROM known GROUP BY 1, 2),
  v AS (
    SELECT src.*, CASE WHEN k.table_name IS NULL THEN 0 ELSE 1 END AS src_table_valid_status,
           CASE WHEN k.table_name IS NULL THEN 'The table ' || src_table_name || ' has been removed from the schema' ELSE NULLIF(CONCAT_WS('; ',
             CASE WHEN (src_table_type = 'LOG' AND l = 0) OR (src_table_type = 'MASTER' AND m = 0) THEN 'There is no column for data processing' END,
             CASE WHEN src_table_type = 'MASTER' AND p = 0 THEN 'There is no PK on Master table' END,
             CASE WHEN src_table_type = 'LOG' AND NOT EXISTS (
               SELECT 1 FROM known a JOIN known b ON b.table_schema = a.table_schema AND b.table_name = REPLACE(a.table_name, '_log', '')
                 AND b.column_name = a.column_name AND b.column_key = 'PRI'
               WHERE a.table_schema = src_schema_name AND a.table_name = src_table_name) THEN 'There is no FK to Master table' END), '') END AS comments
    FROM src LEFT JOIN k ON k.table_schema = src_schema_name AND k.table_name = src_table_name)"""
VALIDATE = VALIDATE.replace("\n  k AS (", "\n  known AS (SELECT * FROM x_catalog WHERE table_name <> 'brand_13'),\n  k AS (", 1)
SHOWN = "src_schema_name, src_table_name, shard_profile_id, src_table_valid_status, comments, proc_block_size"


def _validated(t):
    known = t.catalog.where("table_name <> 'brand_13'")
    return registry.validate_sources(_sources(t, "db2"), known, "db2")


query("e2_validate_sources", VALIDATE + f" SELECT {SHOWN} FROM v")(
    lambda t: _validated(t).select(*SHOWN.split(", "))
)
query(
    "e3_choose_load_mode",
    VALIDATE
    + """ SELECT src_schema_name, src_table_name, shard_profile_id,
            CASE WHEN dtm_column_name IS NULL OR comments LIKE '%There is no PK on Master table%' THEN 1 ELSE src_table_valid_status END AS src_table_valid_status,
            CASE WHEN dtm_column_name IS NULL THEN -1 WHEN comments LIKE '%There is no PK on Master table%' THEN 0 ELSE proc_block_size END AS proc_block_size
          FROM v""",
)(
    lambda t: registry.choose_load_mode(_validated(t)).select(
        "src_schema_name", "src_table_name", "shard_profile_id", "src_table_valid_status", "proc_block_size"
    )
)

# ---- ledger ----
HALF = "make_timestamp(CAST(ROUND(EPOCH({0}) / 1800) * 1800 AS BIGINT) * 1000000)"
GAP = "DATE_SUB('hour', last, now)"


@query(
    "e4_delta_window",
    f"""
    WITH w AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS last,
                      TIMESTAMP '2024-01-31 13:50:00' - INTERVAL 1 MINUTE * CAST(ROUND(value * 100) AS INT) AS now FROM events)
    SELECT event_id, last IS NULL OR {GAP} >= 2 AS is_due,
           CASE WHEN last IS NULL THEN {HALF.format("now")} - INTERVAL 24 HOUR
                WHEN HOUR(last) IN (0, 1) THEN {HALF.format("last")} - INTERVAL 24 HOUR ELSE {HALF.format("last")} - INTERVAL 1 HOUR END AS start_dtm,
           CASE WHEN last IS NULL OR {GAP} > 3 THEN {HALF.format("now")} ELSE {HALF.format("last")} + INTERVAL 2 HOUR END AS end_dtm
    FROM w""",
)
def _(t):
    minutes = F.round(F.col("value") * 100).cast("int")
    moments = t.events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("ts")).alias("last"),
        (F.lit("2024-01-31 13:50:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("now"),
    )
    window = ledger.delta_window("last", "now")
    return moments.select(
        "event_id",
        window["is_due"].alias("is_due"),
        window["start"].alias("start_dtm"),
        window["end"].alias("end_dtm"),
    )


@query(
    "e5_close_processed_entries",
    """SELECT control_download_id, CASE WHEN done THEN 1 ELSE download_status END AS download_status, append_status FROM (
         SELECT *, download_status = 0 AND download_num = (SELECT MAX(download_num) FROM x_ledger) AND (proc_rows > 0 OR proc_duration > 0) AS done
         FROM x_ledger)""",
)
def _(t):
    closed = ledger.close_processed(t.ledger)
    return closed.select("control_download_id", "download_status", "append_status")


@query(
    "e5_unfinished_entries",
    """SELECT control_download_id FROM x_ledger WHERE download_status = 0 AND download_num = (SELECT MAX(download_num) FROM x_ledger)""",
)
def _(t):
    return ledger.unfinished(t.ledger).select("control_download_id")


@query(
    "e5_next_ledger_entries",
    f"""
    WITH {_columns_sql("db2")}
    SELECT (SELECT MAX(download_num) FROM x_ledger) + 1 AS download_num, src_schema_name, src_table_name, src.shard_number,
           LEAST(e.m - INTERVAL 1 HOUR, TIMESTAMP '2024-01-20') AS control_start_dtm, e.m AS control_end_dtm
    FROM src JOIN x_shard_profiles p ON p.shard_profile_id = src.shard_profile_id AND p.status = 1,
         (SELECT MAX(control_end_dtm) AS m FROM x_ledger WHERE download_status = 1) e
    WHERE src_table_name <> p.shard_table_name""",
)
def _(t):
    sources = _sources(t, "db2").withColumns(
        {
            "src_table_id": F.col("shard_profile_id"),
            "src_table_valid_status": F.lit(1),
            "override_dtm": F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"),
        }
    )
    end = ledger.last_end(t.ledger)
    entries = ledger.next_entries(
        t.ledger, sources, t.shard_profiles, end - F.make_dt_interval(F.lit(0), F.lit(1)), end, "DELTA"
    )
    return entries.select(
        "download_num", "src_schema_name", "src_table_name", "shard_number", "control_start_dtm", "control_end_dtm"
    )


NOW = dt.datetime(2024, 1, 31)
query(
    "e17_is_running",
    """SELECT CASE WHEN COUNT(*) > 0 THEN 1 ELSE 0 END AS is_running FROM x_ledger
       WHERE DATE_SUB('hour', control_end_dtm, TIMESTAMP '2024-01-31') <= 24 AND (download_status = 0 OR append_status = 0)""",
)(lambda t: ledger.is_running(t.ledger, NOW))
query(
    "e17_last_migrated_table",
    """SELECT 'DB: ' || host_alias || '; Shard: ' || shard_number || '; Table: ' || src_table_name || '; Rows=' || FORMAT('{:,}', proc_rows)
              || '; Duration=' || FORMAT('{:,}', proc_duration) || 'sec; Finished: ' || STRFTIME(modified_at, '%Y-%m-%d %H:%M:%S') AS last_migrated_table
       FROM x_ledger WHERE control_download_id = (SELECT MAX(control_download_id) FROM x_ledger WHERE download_status = 1)""",
)(lambda t: ledger.last_migrated(t.ledger))
query(
    "e11_appended_rows",
    """
    WITH e AS (SELECT * FROM x_ledger WHERE control_type = 'DELTA' AND download_status = 1 AND append_status = 1 AND download_num = 3),
    s AS (SELECT MAX(download_num) AS download_num, CAST(SUM(proc_rows) AS BIGINT) AS proc_rows, CAST(SUM(proc_duration) AS BIGINT) AS proc_duration,
                 (SELECT COUNT(*) FROM x_stage_rows r JOIN e ON e.src_table_name = r.src_table_name
                  WHERE r.dtm BETWEEN e.control_start_dtm AND e.control_end_dtm) AS appended_rows FROM e)
    SELECT *, 'Download # ' || download_num || '; Rows= ' || FORMAT('{:,}', proc_rows) || '; Duration= ' || FORMAT('{:,}', proc_duration)
              || ' sec; Appended Rows= ' || FORMAT('{:,}', appended_rows) AS summary FROM s""",
)(lambda t: ledger.appended_rows(t.ledger, t.stage_rows, 3))
query(
    "e12_initial_rows_only_missing",
    """SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN CAST(n_regionkey AS BIGINT) ELSE
              (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) END AS initial_rows FROM nation""",
)(
    lambda t: ledger.initial_rows(
        t.nation.select(
            "n_nationkey", F.when(F.col("n_regionkey") > 2, F.col("n_regionkey").cast("long")).alias("initial_rows")
        ),
        t.customer.select(F.col("c_nationkey").alias("n_nationkey")),
        ["n_nationkey"],
        only_missing=True,
    )
)

# ---- loads ----
@query(
    "e6_load_in_key_blocks",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01'
       AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(t):
    owned = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("account_id"))
    window = [F.lit(v).cast("timestamp_ntz") for v in ("1996-01-01 00:00:00", "1998-01-01 00:00:00")]
    rows = load.load_rows(
        t.orders, "o_orderkey", owned=owned, sharding_column="o_custkey", dtm="o_orderdate", start=window[0], end=window[1]
    )
    return rows.select("o_orderkey", "o_custkey")


query(
    "e6_block_size_by_key_count",
    """SELECT o_custkey, CASE WHEN n * 40000 > 1000000 THEN 1000000 WHEN n * 40000 > 100000 THEN 100000 ELSE 10000 END AS block_size
       FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey)""",
)(
    lambda t: t.orders.groupBy("o_custkey")
    .agg((F.count("*") * 40000).alias("n"))
    .select("o_custkey", load.block_size(F.col("n")).alias("block_size"))
)
query(
    "j9_key_set_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
)(
    lambda t: load.only_keys(
        t.lineitem.select("l_orderkey", "l_linenumber"),
        t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")),
        ["l_orderkey"],
    )
)
query(
    "j10_shard_ownership_filter",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
)(
    lambda t: load.only_owned(
        t.orders.select("o_orderkey", "o_custkey"),
        t.customer.where("c_nationkey = 7").select(F.col("c_custkey").alias("account_id")),
        "o_custkey",
    ).select("o_orderkey")
)
FRESH = """SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY o_orderkey ORDER BY o_orderdate DESC, o_orderstatus DESC, o_totalprice) AS rn FROM x_delta) WHERE rn = 1"""
query(
    "e7_delta_upsert",
    f"""WITH f AS ({FRESH}) SELECT * FROM x_stage WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f) UNION ALL SELECT * FROM f""",
)(lambda t: load.upsert(t.stage, t.delta, ["o_orderkey"], newest()))
query(
    "e7_upsert_counts",
    """SELECT COUNT(*) FILTER (k.o_orderkey IS NULL) AS inserted, COUNT(*) FILTER (k.o_orderkey IS NOT NULL) AS updated
       FROM (SELECT DISTINCT o_orderkey FROM x_delta) d LEFT JOIN (SELECT DISTINCT o_orderkey FROM x_stage) k ON k.o_orderkey = d.o_orderkey""",
)(lambda t: load.upsert_counts(t.stage, t.delta, ["o_orderkey"]))


@query(
    "e7_upsert_repeated_line_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey, l_suppkey) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def _(t):
    order = [F.col("l_shipdate").desc(), F.col("l_extendedprice").desc(), "l_partkey", "l_suppkey"]
    lines = t.lineitem
    keys = ["l_orderkey", "l_linenumber"]
    stage = latest(lines.where("l_returnflag = 'N'"), keys, order)
    merged = load.upsert(stage, lines, keys, order)
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


query(
    "e8_append_ignoring_known_keys",
    f"""WITH f AS ({FRESH}) SELECT * FROM x_stage UNION ALL SELECT * FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x_stage)""",
)(lambda t: load.append_new(t.stage, t.delta, ["o_orderkey"], newest()))
query(
    "e16_before_images",
    f"""WITH f AS ({FRESH}) SELECT s.* FROM x_stage s JOIN f ON f.o_orderkey = s.o_orderkey
        WHERE (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority) IS DISTINCT FROM
              (f.o_custkey, f.o_orderstatus, f.o_totalprice, f.o_orderdate, f.o_orderpriority)""",
)(
    lambda t: load.before_images(
        t.stage, load.upsert(t.stage, t.delta, ["o_orderkey"], newest()), ["o_orderkey"]
    )
)


@query(
    "e22_promote_by_partition",
    f"""WITH f AS ({FRESH})
        SELECT STRFTIME(o_orderdate, '%Y') AS year, COUNT(*) AS n FROM (
          SELECT o_orderdate FROM x_stage WHERE YEAR(o_orderdate) < 1999 UNION ALL SELECT o_orderdate FROM f WHERE YEAR(o_orderdate) >= 1999)
        GROUP BY 1""",
)
def _(t):
    path = sinks.scratch_path(t.spark, "final")
    year = F.date_format("o_orderdate", "yyyy")
    sinks.promote(t.stage.withColumn("year", year), path, "year")
    fresh = latest(t.delta, ["o_orderkey"], newest())
    sinks.promote(fresh.withColumn("year", year), path, "year")
    final = t.spark.read.parquet(path)
    return final.groupBy(F.col("year").cast("string").alias("year")).agg(F.count("*").alias("n"))


# ---- compaction ----
MARKED = """
  m AS (
    SELECT log_id, master_id, log_created_dtm, state, big,
           LAG(log_id) OVER w IS NOT NULL AND LAG(state) OVER w IS NOT DISTINCT FROM state AND LAG(big) OVER w = big AS is_repeated
    FROM x_log WINDOW w AS (PARTITION BY master_id ORDER BY log_created_dtm, log_id))"""
LOG_KEYS = ("master_id", "log_id", "log_created_dtm")
query("e9_compact_log", f"WITH {MARKED} SELECT log_id, master_id, state, big FROM m WHERE NOT is_repeated")(
    lambda t: compaction.compact_log(t.log, *LOG_KEYS).select("log_id", "master_id", "state", "big")
)
query("j11_previous_version_compare", f"WITH {MARKED} SELECT log_id, is_repeated FROM m")(
    lambda t: compaction.mark_repeats(t.log, *LOG_KEYS).select("log_id", "is_repeated")
)
query(
    "e10_compaction_stats",
    f"""WITH {MARKED} SELECT COUNT(DISTINCT master_id) AS entries_num, COUNT(*) AS total_rows, COUNT(*) FILTER (is_repeated) AS deleted_rows FROM m""",
)(lambda t: compaction.compaction_stats(compaction.mark_repeats(t.log, *LOG_KEYS), "master_id"))

# ---- differences ----
ATTRIBUTES = """UPPER(column_type) || CASE WHEN is_nullable = 'NO' THEN ' NOT NULL' ELSE ' NULL' END
  || COALESCE(' DEFAULT ''' || column_default || '''', '') || CASE WHEN column_key = 'PRI' THEN ' PRIMARY KEY' ELSE '' END"""
COLUMN_DIFF = f"""
  d AS (
    SELECT MIN(side) AS side, table_name, column_name, column_type, column_key, MIN(is_nullable) AS is_nullable,
           MIN(column_default) AS column_default, MIN(ordinal_position) AS ordinal_position
    FROM (SELECT 'DROP' AS side, * REPLACE (CASE WHEN column_key = 'MUL' THEN '' ELSE column_key END AS column_key) FROM x_local_columns
          UNION ALL
          SELECT 'ADD', * REPLACE (CASE WHEN column_key = 'MUL' THEN '' ELSE column_key END AS column_key,
            CASE WHEN column_type = 'timestamp' AND column_default = '0000-00-00 00:00:00' THEN '2000-01-01 00:00:00' ELSE column_default END AS column_default)
          FROM x_remote_columns)
    GROUP BY table_name, column_name, column_type, column_key HAVING COUNT(*) = 1)"""
query(
    "e13_column_actions",
    f"""WITH {COLUMN_DIFF} SELECT side AS action, table_name, column_name, column_type, column_key, ordinal_position,
        'ALTER TABLE db_stage.' || table_name || ' ' || side || ' COLUMN ' || column_name || ' ' || {ATTRIBUTES} AS statement FROM d""",
)(lambda t: schema_diff.column_actions(t.local_columns, t.remote_columns, "db_stage"))
query(
    "e13_changed_columns",
    f"""WITH {COLUMN_DIFF} SELECT table_name, column_name, MAX(column_type) FILTER (side = 'DROP') AS old_type,
        MAX(column_type) FILTER (side = 'ADD') AS new_type FROM d GROUP BY 1, 2
        HAVING COUNT(*) FILTER (side = 'DROP') > 0 AND COUNT(*) FILTER (side = 'ADD') > 0""",
)(lambda t: schema_diff.changed_columns(schema_diff.column_actions(t.local_columns, t.remote_columns, "db_stage")))


def _index_sql(source: str, side: str) -> str:
    return f"""SELECT '{side}' AS side, table_name, index_name, CASE WHEN non_unique = 0 THEN 'UNIQUE' ELSE '' END AS uniq,
      STRING_AGG(column_name, ', ' ORDER BY seq_in_index) AS columns FROM {source} WHERE index_name <> 'PRIMARY' GROUP BY ALL"""


query(
    "e14_index_actions",
    f"""
    WITH d AS (SELECT MIN(side) AS side, table_name, columns, MIN(index_name) AS index_name, MIN(uniq) AS uniq
               FROM ({_index_sql("x_local_indexes", "Local")} UNION ALL {_index_sql("x_remote_indexes", "Remote")}) GROUP BY table_name, columns HAVING COUNT(*) = 1)
    SELECT CASE side WHEN 'Local' THEN 'DROP' ELSE 'ADD' END AS action, table_name, columns, 'ALTER TABLE db_stage.' || table_name ||
           CASE side WHEN 'Local' THEN ' DROP INDEX ' || index_name || CASE WHEN uniq <> '' THEN ' [ ' || uniq || ' ]' ELSE '' END
                ELSE ' ADD ' || uniq || ' INDEX ' || REPLACE(index_name, 'db1_', '') END || ' (' || columns || ')' AS statement FROM d""",
)(lambda t: schema_diff.index_actions(t.local_indexes, t.remote_indexes, "db_stage", "db1_"))
query(
    "e15_table_actions",
    """SELECT MIN(s) AS table_schema, table_name, CASE WHEN MIN(side) = 1 THEN 'CREATE TABLE ' ELSE 'DROP TABLE ' END || MIN(s) || '.' || table_name || '()' AS statement
       FROM (SELECT DISTINCT 1 AS side, p_type AS s, REPLACE(p_name, ' ', '_') AS table_name FROM part WHERE p_size < 25
             UNION ALL SELECT DISTINCT 2, p_type, REPLACE(p_name, ' ', '_') FROM part WHERE p_size >= 25)
       GROUP BY s, table_name HAVING COUNT(*) = 1""",
)(
    lambda t: schema_diff.table_actions(
        *[
            t.part.where(test).select(
                F.col("p_type").alias("table_schema"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("table_name")
            )
            for test in ("p_size < 25", "p_size >= 25")
        ]
    )
)


# ---- incremental streams ----
def _stream(t, ignore_known: bool):
    files = t.orders
    return streaming.merge_files(
        t.spark, t.folder, files.schema, sinks.scratch_path(t.spark, "versions"), sinks.scratch_path(t.spark, "progress"),
        ["o_orderkey"], newest, ignore_known, file_filter="orders.parquet",
    )


query("e7_upsert_stream_available_now", "SELECT * FROM orders")(lambda t: _stream(t, False))
query("e8_append_stream_available_now", "SELECT * FROM orders")(lambda t: _stream(t, True))
query(
    "r1_quarter_hour_windows",
    """SELECT TIME_BUCKET(INTERVAL 15 MINUTE, ts) AS start_time, event_type, COUNT(*) AS events, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS total,
              MAX(CAST(ROUND(value * 100) AS BIGINT)) AS peak FROM events GROUP BY 1, 2""",
)(
    lambda t: streaming.rate_windows(
        t.events.withColumn("cents", F.round(F.col("value") * 100).cast("long")), "ts", "15 minutes", "1 hour", ["event_type"], "cents"
    )
)


# ---- the load from ledger to stage ----
FIRST, SECOND = dt.datetime(1996, 6, 1, 12), dt.datetime(1996, 6, 3, 12)


def _remote(t, second: bool):
    """Link rows of a shard. By the second download some orders have changed, some came late and some customers are gone."""

    def link(name: str, shard: int):
        if name == "customer":
            rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.lit(None).cast("timestamp_ntz").alias("dtm"))
            rows = rows.where("id % 5 <> 0") if second else rows
            return rows.where(F.col("id") % 2 + 1 == shard)
        rows = t.orders.where(F.col("o_custkey") % 2 + 1 == shard).select(
            F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("timestamp_ntz").alias("dtm")
        )
        if not second:
            return rows.where("id % 11 <> 0")
        old = F.col("dtm") < F.lit(FIRST).cast("timestamp_ntz")
        changed, late = old & (F.col("id") % 7 == 0), old & (F.col("id") % 11 == 0)
        moved = F.when(changed, F.lit(SECOND - dt.timedelta(hours=10))).when(late, F.lit(FIRST - dt.timedelta(minutes=30)))
        return rows.select(
            "id", (F.col("amount") + changed.cast("int")).alias("amount"), F.coalesce(moved.cast("timestamp_ntz"), F.col("dtm")).alias("dtm")
        )

    return link


@query(
    "e6_load_resumed_over_two_downloads",
    """
    WITH one AS (
      SELECT o_orderkey AS id, CAST(o_custkey % 2 + 1 AS INT) AS shard_number, o_totalprice AS amount, o_orderdate AS dtm
      FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderdate <= TIMESTAMP '1996-06-01 12:00:00'),
    seen AS (
      SELECT o_orderkey AS id, CAST(o_custkey % 2 + 1 AS INT) AS shard_number,
             CASE WHEN o_orderdate < TIMESTAMP '1996-06-01 12:00:00' AND o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS amount,
             CASE WHEN o_orderdate >= TIMESTAMP '1996-06-01 12:00:00' THEN o_orderdate
                  WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '1996-06-03 02:00:00'
                  WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '1996-06-01 11:30:00' ELSE o_orderdate END AS dtm
      FROM orders),
    two AS (SELECT * FROM seen WHERE dtm BETWEEN TIMESTAMP '1996-06-01 11:00:00' AND TIMESTAMP '1996-06-03 12:00:00'),
    people AS (SELECT c_custkey AS id, CAST(c_custkey % 2 + 1 AS INT) AS shard_number, c_acctbal AS amount FROM customer),
    loads AS (
      SELECT 1 AS n, 'orders' AS name, shard_number FROM one UNION ALL SELECT 2, 'orders', shard_number FROM two
      UNION ALL SELECT 1, 'customer', shard_number FROM people UNION ALL SELECT 2, 'customer', shard_number FROM people WHERE id % 5 <> 0)
    SELECT 'stage' AS part, 'orders' AS src_table_name, shard_number, id, CAST(amount AS DOUBLE) AS amount, dtm AS from_dtm,
           CAST(NULL AS TIMESTAMP) AS to_dtm, CAST(NULL AS INT) AS status
    FROM (SELECT * FROM two UNION ALL SELECT * FROM one WHERE id NOT IN (SELECT id FROM two))
    UNION ALL
    SELECT 'stage', 'customer', shard_number, id, CAST(amount AS DOUBLE), NULL, NULL, NULL FROM people WHERE id % 5 <> 0
    UNION ALL
    SELECT 'ledger', name, shard_number, n, CAST(COUNT(l.n) AS DOUBLE),
           CASE WHEN n = 1 THEN TIMESTAMP '1900-01-01' ELSE TIMESTAMP '1996-06-01 11:00:00' END,
           CASE WHEN n = 1 THEN TIMESTAMP '1996-06-01 12:00:00' ELSE TIMESTAMP '1996-06-03 12:00:00' END, 11
    FROM (SELECT * FROM range(1, 3) a(n), (VALUES ('orders'), ('customer')) b(name), (VALUES (1), (2)) c(shard_number))
    LEFT JOIN loads l USING (n, name, shard_number) GROUP BY n, name, shard_number""",
)
def _(t):
    sources = registry.choose_load_mode(
        t.spark.sql(
            f"""SELECT id AS src_table_id, 'db2' AS host_alias, shard AS shard_number, shard AS shard_profile_id, 'db' AS src_schema_name,
                       name AS src_table_name, dtm AS dtm_column_name, 'id' AS proc_pk_column_name, 100000 AS proc_block_size,
                       if(dtm IS NULL, '{registry.NO_DTM}', NULL) AS comments, if(dtm IS NULL, 0, 1) AS src_table_valid_status,
                       1 AS src_table_load_status, TIMESTAMP_NTZ '1900-01-01' AS override_dtm
                FROM VALUES (1L, 'orders', 'dtm'), (2L, 'customer', NULL) AS s(id, name, dtm), VALUES (1), (2) AS n(shard)"""
        )
    )
    profiles = t.spark.sql("SELECT id AS shard_profile_id, 'accounts' AS shard_table_name, 1 AS status FROM VALUES (1), (2) AS v(id)")
    stage = incremental.Stage(t.spark, sinks.scratch_path(t.spark, "load"))
    incremental.run_load(stage, sources, profiles, _remote(t, False), FIRST, max_tables=1)  # stops half way
    later = FIRST + dt.timedelta(minutes=20)
    incremental.run_load(stage, sources, profiles, _remote(t, False), later)  # goes on with what was left
    incremental.run_load(stage, sources, profiles, _remote(t, False), later)  # too early for the next
    sources = sources.withColumn("override_dtm", F.lit(None).cast("timestamp_ntz"))
    incremental.run_load(stage, sources, profiles, _remote(t, True), SECOND)
    none = {"to_dtm": F.lit(None).cast("timestamp_ntz"), "status": F.lit(None).cast("int")}
    rows = [
        stage.table(name, ["id"]).select(
            F.lit("stage").alias("part"), F.lit(name).alias("src_table_name"), "shard_number", F.col("id").cast("long").alias("id"),
            F.col("amount").cast("double").alias("amount"), F.col("dtm").alias("from_dtm"), *(c.alias(n) for n, c in none.items())
        )
        for name in ("orders", "customer")
    ]
    entries = stage.ledger().select(
        F.lit("ledger").alias("part"), "src_table_name", "shard_number", F.col("download_num").cast("long").alias("id"),
        F.col("proc_rows").cast("double").alias("amount"), F.col("control_start_dtm").alias("from_dtm"),
        F.col("control_end_dtm").alias("to_dtm"), (10 * F.col("download_status") + F.col("append_status")).cast("int").alias("status"),
    )
    return rows[0].unionByName(rows[1]).unionByName(entries)


def _streamed(t, ignore_known: bool):
    """A stage that is there already, and files with new, repeated and known keys put over it."""
    root = sinks.scratch_path(t.spark, "streamed")
    streaming.start_stage(t.stage, f"{root}/stage")
    latest(t.delta, ["o_orderkey", "o_orderdate", "o_orderstatus"], newest()).repartition(3).write.parquet(f"{root}/in")
    return streaming.merge_files(
        t.spark, f"{root}/in", t.stage.schema, f"{root}/stage", f"{root}/progress", ["o_orderkey"], newest, ignore_known
    )


query(
    "e7_upsert_stream_over_a_stage",
    f"""WITH f AS ({FRESH}) SELECT * FROM x_stage WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f) UNION ALL SELECT * FROM f""",
)(lambda t: _streamed(t, False))
query(
    "e8_append_stream_over_a_stage",
    f"""WITH f AS ({FRESH}) SELECT * FROM x_stage UNION ALL SELECT * FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x_stage)""",
)(lambda t: _streamed(t, True))
