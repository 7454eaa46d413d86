"""Scalar functions and predicates over whole tables and whole texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shardline.functions import predicates as P
from shardline.functions import scalars as S
from shardline.gallery.base import query
from shardline.operators.ordered import with_line_number

TITLE = "array_to_string(list_transform(string_split(LOWER({0}), ' '), lambda w: UPPER(w[1]) || w[2:]), ' ')"


@query("c1_initcap", f"SELECT p_partkey, {TITLE.format('p_name')} AS title FROM part")
def _(t):
    return t.part.select("p_partkey", S.initcap("p_name").alias("title"))


@query(
    "c2_translate_in_sequence",
    "SELECT doc_id, REPLACE(REPLACE(REPLACE(REPLACE(text, 'e', ''), 'a', 'o'), 'o', 'i'), 'i', '1') AS out FROM documents",
)
def _(t):
    return t.documents.select("doc_id", S.translate("text", "ioae", "1io").alias("out"))


@query(
    "c3_table_alias",
    f"SELECT DISTINCT table_name, LOWER(REGEXP_REPLACE({TITLE.format(chr(82) + 'EPLACE(table_name, ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')}, '[a-z ]', '', 'g')) AS table_alias FROM x_columns",
)
def _(t):
    return t.columns.select("table_name").distinct().withColumn("table_alias", S.table_alias("table_name"))


@query(
    "c4_nth_path_element",
    """SELECT page_id, string_split(url, '/')[1] AS e1, string_split(url, '/')[LEAST(4, len(string_split(url, '/')))] AS e4,
              string_split(url, '/')[LEAST(6, len(string_split(url, '/')))] AS e6, string_split(url, '/')[-1] AS last FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id", *[S.path_element("url", n, "/").alias(a) for n, a in ((1, "e1"), (4, "e4"), (6, "e6"), (-1, "last"))]
    )


def _packed(key: str, lead: str) -> str:
    mark = f"{lead}{key}=="
    tail = f"CASE WHEN CONTAINS(v, '{mark}') THEN SPLIT_PART(v, '{mark}', 2) ELSE v END"
    return f"CASE WHEN CONTAINS(v, '{key}') THEN TRIM(SPLIT_PART({tail}, '~|~', 1), ' ') END"


@query(
    "c5_packed_attribute",
    f"""SELECT item_id, {_packed("mfgname", "~|~")} AS maker, {_packed("brand", "~|~")} AS brand, {_packed("title", "")} AS title
        FROM (SELECT item_id, ima_attribute_values AS v FROM x_item)""",
)
def _(t):
    v = "ima_attribute_values"
    return t.item.select(
        "item_id",
        S.packed_value(v, "mfgname").alias("maker"),
        S.packed_value(v, "brand").alias("brand"),
        S.packed_value(v, "title", anchored=False).alias("title"),
    )


@query(
    "c6_top_of_path_or_empty",
    """SELECT store_hierarchy_id, CASE WHEN CONTAINS(store_hierarchy_display_path, '|')
              THEN SPLIT_PART(store_hierarchy_display_path, '|', 1) ELSE '' END AS top FROM x_hierarchy""",
)
def _(t):
    return t.hierarchy.select("store_hierarchy_id", S.path_top("store_hierarchy_display_path").alias("top"))


@query(
    "c7_date_formats",
    "SELECT event_id, STRFTIME(ts, '%m/%d/%Y') AS day, STRFTIME(ts, '%m/%d/%Y %H:%M:%S') AS moment FROM events",
)
def _(t):
    return t.events.select("event_id", S.us_date("ts").alias("day"), S.us_date_time("ts").alias("moment"))


@query(
    "c9_date_arithmetic",
    """SELECT o_orderkey, DATE_DIFF('day', CAST(o_orderdate AS DATE), DATE '2001-03-04') AS days,
              DATE_SUB('hour', o_orderdate, TIMESTAMP '2001-03-04 05:30:00') AS hours,
              STRFTIME(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') AS later FROM orders""",
)
def _(t):
    when = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_diff(F.lit(dt.date(2001, 3, 4)), F.to_date(when)).cast("long").alias("days"),
        S.whole_hours(when, F.lit("2001-03-04 05:30:00").cast("timestamp_ntz")).alias("hours"),
        F.date_format(when + F.make_dt_interval(F.lit(2)), "yyyy-MM-dd").alias("later"),
    )


@query(
    "c10_nearest_half_hour",
    "SELECT event_id, make_timestamp(CAST(ROUND(EPOCH(ts) / 1800) * 1800 AS BIGINT) * 1000000) AS slot FROM events",
)
def _(t):
    return t.events.select("event_id", S.nearest_half_hour("ts").alias("slot"))


@query(
    "c11_later_of_two_times",
    """SELECT item_vendor_package_id, MAX(CASE WHEN modified_dtm IS NULL OR ima_timestamp > modified_dtm THEN ima_timestamp ELSE modified_dtm END) AS latest
       FROM x_vendor_package GROUP BY 1""",
)
def _(t):
    return t.vendor_package.groupBy("item_vendor_package_id").agg(
        F.max(S.later_of("ima_timestamp", "modified_dtm")).alias("latest")
    )


@query(
    "c12_ipv4_text_and_binary",
    """SELECT src_ip, PRINTF('%02X%02X%02X%02X', CAST(SPLIT_PART(src_ip, '.', 1) AS INT), CAST(SPLIT_PART(src_ip, '.', 2) AS INT),
                    CAST(SPLIT_PART(src_ip, '.', 3) AS INT), CAST(SPLIT_PART(src_ip, '.', 4) AS INT)) AS code,
              src_ip AS back, COUNT(*) AS n FROM x_flows GROUP BY src_ip""",
)
def _(t):
    packed = t.flows.select("src_ip", S.ipv4_to_binary("src_ip").alias("b"))
    rows = packed.select("src_ip", F.hex("b").alias("code"), S.ipv4_to_text("b").alias("back"))
    return rows.groupBy("src_ip", "code", "back").agg(F.count("*").alias("n"))


@query("c14_thousands_separators", "SELECT o_orderkey, CONCAT('Rows= ', FORMAT('{:,}', o_orderkey * 1009)) AS line FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.concat(F.lit("Rows= "), S.thousands(F.col("o_orderkey") * 1009)).alias("line"))


@query(
    "c15_row_fingerprint",
    "SELECT master_id, COUNT(DISTINCT (COALESCE(state, '?'), big)) AS versions FROM x_log GROUP BY master_id",
)
def _(t):
    log = t.log
    printed = log.select("master_id", S.row_fingerprint(S.tracked_columns(log.columns, ["log_id", "master_id"])).alias("p"))
    return printed.groupBy("master_id").agg(F.count_distinct("p").alias("versions"))


@query(
    "c16_status_suffix",
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 1 THEN c_mktsegment ELSE RPAD(c_mktsegment, 14, ' ') || ' OFF' END AS label FROM customer""",
)
def _(t):
    return t.customer.select("c_custkey", S.status_suffix(F.col("c_nationkey") % 3, "c_mktsegment").alias("label"))


@query(
    "f2_equal_or_any_drops_null",
    "SELECT account_user_id FROM x_account_user WHERE user_id IS NOT NULL AND account_id = 7",
)
def _(t):
    users = t.account_user
    return users.where(P.equals_or_any("user_id", None) & P.equals_or_any("account_id", 7)).select("account_user_id")


@query(
    "f3_bit_mask_predicates",
    """SELECT account_id, fulfillment_type_mask & 5 <> 0 AS shares, fulfillment_type_mask & 5 = 5 AS covers FROM x_vendor_account""",
)
def _(t):
    m = "fulfillment_type_mask"
    return t.vendor_account.select(
        "account_id", P.shares_bits(m, 5).alias("shares"), P.covers_bits(m, 5).alias("covers")
    )


@query(
    "f4_prefix_and_contains_search",
    """SELECT p_partkey, STARTS_WITH(UPPER(p_name), 'RED') AS prefix, CONTAINS(UPPER(p_name), 'RED') AS part FROM part""",
)
def _(t):
    name = F.upper("p_name")
    return t.part.select(
        "p_partkey", P.name_starts(name, "red").alias("prefix"), P.name_contains(name, "red").alias("part")
    )


@query(
    "f5_inclusive_day_window",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-05-28' AND TIMESTAMP '1997-05-29'",
)
def _(t):
    return t.orders.where(P.on_day("o_orderdate", dt.date(1997, 5, 28))).select("o_orderkey", "o_orderdate")


@query(
    "f6_half_open_last_days",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'",
)
def _(t):
    return t.events.where(P.last_days("ts", dt.date(2024, 1, 17), 7)).select("event_id")


@query(
    "f7_date_filter_in_the_join",
    """SELECT o_orderstatus, COUNT(*) AS n, COUNT(l_orderkey) AS matched FROM orders
       LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
       GROUP BY o_orderstatus""",
)
def _(t):
    shipped = t.lineitem.where(P.within("l_shipdate", dt.date(1998, 1, 1), dt.date(1999, 1, 1))).select("l_orderkey")
    joined = t.orders.join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("l_orderkey").alias("matched"))


@query(
    "f11_code_labels",
    """SELECT item_id, CASE catalog_status WHEN 0 THEN 'Rejected' WHEN 1 THEN 'Saved' WHEN 2 THEN 'Published'
              WHEN 3 THEN 'Ima_pending' WHEN 4 THEN 'New' WHEN 5 THEN 'Excluded' END AS status,
              CASE allocation_mask WHEN 1 THEN 'Site_01' WHEN 2 THEN 'Site_02' WHEN 3 THEN 'Both' ELSE '' END AS allocation,
              COALESCE(CASE owner_code WHEN 'S' THEN 'Site_02' WHEN 'K' THEN 'Site_01' WHEN 'B' THEN 'Both' END, '') AS owner FROM x_item""",
)
def _(t):
    return t.item.select(
        "item_id",
        P.code_label("catalog_status", P.CATALOG_STATUS).alias("status"),
        P.code_label("allocation_mask", P.ALLOCATION, "").alias("allocation"),
        P.code_label("owner_code", P.OWNER, "").alias("owner"),
    )


@query(
    "f12_table_name_lists",
    """SELECT DISTINCT table_schema, table_name FROM x_columns
       WHERE table_name NOT IN ('brand_1', 'brand_2_log') AND table_name LIKE 'brand%' AND table_name LIKE '%log'
         AND table_name NOT LIKE '%_3_log' AND table_name NOT LIKE 'brand_2__log'""",
)
def _(t):
    chosen = P.name_lists(
        "table_name", without="brand_1; brand_2_log", like="brand%; %log", unlike="%_3_log;brand_2__log"
    )
    return t.columns.where(chosen).select("table_schema", "table_name").distinct()


@query(
    "f12_table_name_in_and_not_in",
    "SELECT DISTINCT table_name FROM x_columns WHERE table_name IN ('brand_1', 'brand_2', 'brand_3') AND table_name NOT IN ('brand_2')",
)
def _(t):
    chosen = P.name_lists("table_name", within="brand_1;brand_2;brand_3", without="brand_2")
    return t.columns.where(chosen).select("table_name").distinct()


@query(
    "f13_null_fill_and_excel_quote",
    """SELECT master_id, log_id, COALESCE(state, '') AS filled, CASE WHEN state IS NULL THEN '' ELSE '''' || state || '''' END AS quoted
       FROM x_log""",
)
def _(t):
    return t.log.select(
        "master_id",
        "log_id",
        S.blank_if_null("state").alias("filled"),
        S.blank_if_null(S.excel_quote("state")).alias("quoted"),
    )


@query(
    "f15_numbered_lines",
    """SELECT ROW_NUMBER() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS line_num, o_orderkey FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    order = ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"]
    return with_line_number(rows, order).select("line_num", "o_orderkey")
