"""Joins, aggregates, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardline.gallery.base import div, fixed, query
from shardline.operators import aggregates as A
from shardline.operators import masks, ordered, sets
from shardline.plans import accounts
from shardline.plans.catalog import over_threshold, site_order_number


@query(
    "a6_count_non_null_after_outer_join",
    """SELECT o_custkey, CAST(SUM(shipped) AS BIGINT) AS shipped, CAST(SUM(returned) AS BIGINT) AS returned FROM (
         SELECT o_custkey, o_orderkey, COUNT(l_linenumber) AS shipped, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned
         FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey) GROUP BY o_custkey""",
)
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    joined = t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("o_custkey").agg(
        F.count("l_linenumber").alias("shipped"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"),
    )


@query(
    "a7_distinct_values_as_text",
    "SELECT o_custkey, STRING_AGG(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey",
)
def _(t):
    return t.orders.groupBy("o_custkey").agg(A.joined_distinct("o_orderpriority").alias("priorities"))


@query(
    "a7_values_by_position_as_text",
    """SELECT table_name, index_name, STRING_AGG(column_name, ', ' ORDER BY seq_in_index) AS columns FROM x_local_indexes GROUP BY 1, 2""",
)
def _(t):
    return t.local_indexes.groupBy("table_name", "index_name").agg(
        A.joined_by_position("column_name", "seq_in_index").alias("columns")
    )


@query(
    "a8_conditional_max_pivot",
    """SELECT l_orderkey, MAX(CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_part,
              MAX(CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS accepted_part FROM lineitem GROUP BY l_orderkey""",
)
def _(t):
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy("l_orderkey").agg(
        A.max_where(flag == "R", "l_partkey").alias("returned_part"),
        A.max_where(flag == "A", "l_partkey").alias("accepted_part"),
    )


@query("a11_bit_or", "SELECT parent_id, BIT_OR(fulfillment_type_mask) AS bits FROM x_vendor_account GROUP BY parent_id")
def _(t):
    return t.vendor_account.groupBy("parent_id").agg(F.bit_or("fulfillment_type_mask").alias("bits"))


@query(
    "a13_grand_total_line",
    """SELECT o_orderpriority, n_orders, cents FROM (
         SELECT o_orderpriority, COUNT(*) AS n_orders, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1
         UNION ALL SELECT 'Total', COUNT(*), CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders)""",
)
def _(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return A.with_total_row(
        t.orders.select("o_orderpriority", cents.alias("c")),
        ["o_orderpriority"],
        {"n_orders": F.count("*"), "cents": F.sum("c")},
    )


PROFILED = ("o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "a15_column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) AS num_rows, COUNT(DISTINCT {c}) AS num_distinct, COUNT(*) - COUNT({c}) AS num_nulls,
            {fixed(div(f"SUM(LENGTH(CAST({c} AS VARCHAR)))", f"COUNT({c})"), 6, 6)} AS avg_length,
            1.0::DOUBLE / COUNT(DISTINCT {c}) AS density FROM orders"""
        for c in PROFILED
    ),
)
def _(t):
    return A.column_profile(t.orders, PROFILED)


@query(
    "a18_distinct_counts",
    " UNION ALL ".join(
        f"SELECT 'nd_{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM lineitem"
        for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_shipdate")
    ),
)
def _(t):
    return A.distinct_counts(t.lineitem, ["l_partkey", "l_suppkey", "l_orderkey", "l_shipdate"])


@query(
    "j2_left_join_with_extra_condition",
    """SELECT a.account_id, a.account_name, u.user_id FROM x_account a
       LEFT JOIN x_account_user u ON u.account_id = a.account_id AND u.is_owner = 1""",
)
def _(t):
    rows = accounts.find_accounts(t.account, t.vendor_account, t.account_user)
    return rows.select("account_id", "account_name", "user_id")


@query(
    "j3_outer_join_on_two_keys",
    """SELECT f.ts, f.file, CAST(COALESCE(SUM(e.length), 0) AS BIGINT) AS used FROM x_files f
       LEFT JOIN x_extents e ON e.ts = f.ts AND e.file = f.file GROUP BY f.ts, f.file""",
)
def _(t):
    used = t.extents.groupBy("ts", "file").agg(F.sum("length").alias("used"))
    joined = t.files.select("ts", "file").join(used, ["ts", "file"], "left")
    return joined.withColumn("used", F.coalesce("used", F.lit(0)))


@query(
    "j4_inner_join_cancels_left",
    """SELECT i.external_item_id, v.value_name FROM x_outer_item i
       LEFT JOIN x_outer_attribute_value av ON av.external_item_id = i.external_item_id
       JOIN x_outer_value v ON v.external_value_id = av.external_value_id AND v.status = 1""",
)
def _(t):
    values = t.outer_value.where("status = 1").select("external_value_id", "value_name")
    links = t.outer_attribute_value.select("external_item_id", "external_value_id")
    joined = t.outer_item.select("external_item_id").join(links, "external_item_id", "left").join(values, "external_value_id")
    return joined.select("external_item_id", "value_name")


@query(
    "j5_same_table_under_two_filters",
    """SELECT i.item_id, h1.store_hierarchy_display_path AS path1, h2.store_hierarchy_display_path AS path2 FROM x_item i
       LEFT JOIN x_hierarchy h1 ON h1.store_hierarchy_id = i.shc_hierarchy_id AND h1.store_id = 1
       LEFT JOIN x_hierarchy h2 ON h2.store_hierarchy_id = i.core_hierarchy_id AND h2.store_id = 2""",
)
def _(t):
    def tree(store: int, key: str, name: str):
        return t.hierarchy.where(F.col("store_id") == store).select(
            F.col("store_hierarchy_id").alias(key), F.col("store_hierarchy_display_path").alias(name)
        )

    items = t.item.select("item_id", "shc_hierarchy_id", "core_hierarchy_id")
    joined = items.join(tree(1, "shc_hierarchy_id", "path1"), "shc_hierarchy_id", "left").join(
        tree(2, "core_hierarchy_id", "path2"), "core_hierarchy_id", "left"
    )
    return joined.select("item_id", "path1", "path2")


@query(
    "j6_bit_mask_join",
    """SELECT i.item_id, t.item_relation_type_name FROM x_item i
       JOIN x_item_relation_type t ON t.bit_value & i.relation_type_mask = i.relation_type_mask""",
)
def _(t):
    joined = masks.join_covering(t.item, "relation_type_mask", t.item_relation_type, "bit_value")
    return joined.select("item_id", "item_relation_type_name")


@query(
    "j7_semi_and_anti_join",
    """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
       AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def _(t):
    def customers_of(test: str):
        return t.orders.where(test).select(F.col("o_custkey").alias("c_custkey")).distinct()

    return (
        t.customer.select("c_custkey")
        .join(customers_of("o_orderstatus = 'P'"), "c_custkey", "left_semi")
        .join(customers_of("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")
    )


@query(
    "j12_threshold_from_parameter_row",
    """SELECT o_orderkey, DATE_DIFF('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age FROM orders
       WHERE DATE_DIFF('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > (
         SELECT v.profile_term_value / 86400 FROM x_profile_value v JOIN x_profile p ON p.profile_id = v.profile_id
         WHERE p.profile_name = 'INTERNAL_SETTINGS' AND v.profile_term_type = 'IMA_PENDING_THRESHOLD')""",
)
def _(t):
    age = F.date_diff(F.to_date(F.lit("2001-08-01")), F.to_date("o_orderdate")).cast("long")
    aged = t.orders.select("o_orderkey", age.alias("age"))
    return over_threshold(aged, "age", t.profile, t.profile_value, "IMA_PENDING_THRESHOLD", "INTERNAL_SETTINGS")


@query(
    "j13_account_names_joined",
    """SELECT i.item_id, '''' || a.account_name || '''' AS account_name FROM x_item i JOIN x_account a ON a.account_id = i.account_id""",
)
def _(t):
    names = t.account.select("account_id", F.concat(F.lit("'"), "account_name", F.lit("'")).alias("account_name"))
    return t.item.select("item_id", "account_id").join(names, "account_id").select("item_id", "account_name")


@query(
    "j14_site_override_rule",
    """SELECT si.item_id, si.site_id, MAX(CASE WHEN si.site_id = p.store_id OR (si.site_id = 3 AND p.store_id = 1)
              OR (si.site_id > 3 AND p.store_id = 2) THEN p.order_duns_number END) AS order_duns_number
       FROM x_item_site si LEFT JOIN x_vendor_package p ON p.item_id = si.item_id AND p.status = 1
       WHERE si.status = 1 GROUP BY 1, 2""",
)
def _(t):
    packages = t.vendor_package.where("status = 1").select("item_id", "store_id", "order_duns_number")
    joined = t.item_site.where("status = 1").select("item_id", "site_id").join(packages, "item_id", "left")
    return joined.groupBy("item_id", "site_id").agg(site_order_number().alias("order_duns_number"))


@query(
    "w1_carry_forward_from_parent",
    """SELECT item_id, item_relation_id, FIRST_VALUE(base_pid IGNORE NULLS) OVER (
              PARTITION BY item_relation_id ORDER BY flag DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base1_pid
       FROM (SELECT item_id, CAST(FLOOR(item_id / 5) AS BIGINT) AS item_relation_id, CASE WHEN item_id % 5 = 3 THEN 1 ELSE 0 END AS flag,
                    CASE WHEN item_id % 5 = 3 THEN pid END AS base_pid FROM x_item)""",
)
def _(t):
    dummy = F.col("item_id") % 5 == 3
    rows = t.item.select(
        "item_id",
        F.floor(F.col("item_id") / 5).alias("item_relation_id"),
        F.when(dummy, 1).otherwise(0).alias("flag"),
        F.when(dummy, F.col("pid")).alias("base_pid"),
    )
    carried = ordered.with_first_before(
        rows, "item_relation_id", [-F.col("flag"), F.col("item_id")], {"base_pid": "base1_pid"}
    )
    return carried.select("item_id", "item_relation_id", "base1_pid")


@query(
    "w2_rank_in_group",
    "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return ordered.with_rank_in_group(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rank")


@query(
    "w3_rank_by_counting_smaller",
    """SELECT log_id, ROW_NUMBER() OVER (PARTITION BY master_id ORDER BY log_created_dtm, log_id) AS rank FROM x_log""",
)
def _(t):
    rows = t.log.select("log_id", "master_id", "log_created_dtm")
    return ordered.with_rank_in_group(rows, ["master_id"], ["log_created_dtm", "log_id"]).select("log_id", "rank")


@query(
    "w4_previous_row_compare",
    """SELECT event_id, event_type = LAG(event_type) OVER w AS same_type, COALESCE(value > LAG(value) OVER w, FALSE) AS grew
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    looked = ordered.with_previous(rows, ["user_id"], ["ts", "event_id"], {"event_type": "_type", "value": "_value"})
    return looked.select(
        "event_id",
        (F.col("event_type") == F.col("_type")).alias("same_type"),
        F.coalesce(F.col("value") > F.col("_value"), F.lit(False)).alias("grew"),
    )


@query("w6_page_of_results", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return ordered.page(rows, [F.col("c_acctbal").desc(), "c_custkey"], 50, 25).drop("c_acctbal")


@query(
    "k4_numeric_order_of_text",
    """SELECT ROW_NUMBER() OVER (ORDER BY TRY_CAST(external_hierarchy_id AS BIGINT) NULLS FIRST, store_hierarchy_id) AS line_num,
              store_hierarchy_id, external_hierarchy_id FROM x_hierarchy""",
)
def _(t):
    rows = t.hierarchy.select("store_hierarchy_id", "external_hierarchy_id")
    return ordered.with_line_number(rows, [F.col("external_hierarchy_id").try_cast("bigint"), "store_hierarchy_id"])


@query(
    "u3_union_with_constant_label",
    """SELECT item_id, rule FROM (
         SELECT item_id, ban_rule_name AS rule FROM x_item_ban_rule JOIN x_ban_rule USING (ban_rule_id) WHERE status = 1
         UNION SELECT item_id, 'Item level ban' FROM x_sticky_ban WHERE sticky_ban_state = 1)""",
)
def _(t):
    by_rule = t.item_ban_rule.where("status = 1").join(t.ban_rule, "ban_rule_id")
    by_item = t.sticky_ban.where("sticky_ban_state = 1").select("item_id", F.lit("Item level ban").alias("rule"))
    return sets.union_distinct([by_rule.select("item_id", F.col("ban_rule_name").alias("rule")), by_item])


@query(
    "u4_union_of_permanent_and_temporary",
    """SELECT tablespace_name, CAST(SUM(bytes) AS BIGINT) AS bytes FROM x_data_files GROUP BY 1
       UNION SELECT tablespace_name, CAST(SUM(bytes) AS BIGINT) FROM x_temp_files GROUP BY 1""",
)
def _(t):
    sums = [f.groupBy("tablespace_name").agg(F.sum("bytes").alias("bytes")) for f in (t.data_files, t.temp_files)]
    return sets.union_distinct(sums)


@query(
    "u5_symmetric_difference",
    """SELECT MIN(side) AS table_location, o_orderkey, o_orderstatus FROM (
         SELECT 'Local Table' AS side, o_orderkey, o_orderstatus FROM x_stage
         UNION ALL SELECT 'Remote Table', o_orderkey, o_orderstatus FROM x_delta)
       GROUP BY o_orderkey, o_orderstatus HAVING COUNT(*) = 1""",
)
def _(t):
    return sets.one_sided(t.stage, t.delta, ["o_orderkey", "o_orderstatus"])


@query(
    "u6_listing_diff",
    """SELECT CASE WHEN SUM(s) > 0 THEN '<' ELSE '>' END AS side, p_brand, p_type, CAST(ABS(SUM(s)) AS BIGINT) AS copies FROM (
         SELECT 1 AS s, p_brand, p_type FROM part WHERE p_size <= 30
         UNION ALL SELECT -1, p_brand, p_type FROM part WHERE p_size > 20)
       GROUP BY p_brand, p_type HAVING SUM(s) <> 0""",
)
def _(t):
    rows = t.part
    return sets.listing_diff(
        rows.where("p_size <= 30").select("p_brand", "p_type"), rows.where("p_size > 20").select("p_brand", "p_type")
    )
