"""Provided tables in the shapes of the network, retail, load and storage models."""

SHAPES: dict[str, str] = {}

# ---- network flow: line items as traffic, suppliers as devices, parts as classes ----
SHAPES["x_class_facts"] = """
SELECT 'month' AS grain,
       CAST(EXTRACT(YEAR FROM l_shipdate) * 12 + EXTRACT(MONTH FROM l_shipdate) AS BIGINT) AS period_id,
       MONTH_START(l_shipdate) AS datetime,
       l_suppkey AS device_id,
       l_partkey AS class_id,
       CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS bytes,
       CAST(l_quantity AS BIGINT) AS pkts,
       CASE WHEN l_returnflag = 'R' THEN CAST(ROUND(l_extendedprice) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS tcp_retx_bytes,
       CAST(l_linenumber * 60 AS BIGINT) AS sample_interval_secs,
       CAST(ROUND(l_extendedprice) * l_quantity AS BIGINT) AS peak_bps,
       CAST(ROUND(l_discount * 100) AS BIGINT) AS guar_rate_fails
FROM {lineitem}
"""
SHAPES["x_raw_facts"] = """
SELECT 'raw' AS grain, CAST(0 AS BIGINT) AS period_id, ts AS datetime, user_id AS device_id,
       user_id % 5 AS class_id,
       CAST(ROUND(value * 100) AS BIGINT) AS bytes,
       CAST(LENGTH(event_type) AS BIGINT) AS pkts,
       CASE WHEN event_type = 'error' THEN CAST(ROUND(value * 10) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS tcp_retx_bytes,
       CAST(30 + event_id % 3 AS BIGINT) AS sample_interval_secs,
       CAST(ROUND(value * 800) AS BIGINT) AS peak_bps,
       CASE WHEN event_type = 'error' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS guar_rate_fails
FROM {events}
"""
SHAPES["x_classes"] = """
SELECT p_partkey AS class_id,
       CAST(1000000000 + p_size AS BIGINT) AS parent_id,
       p_name AS name,
       CONCAT('/Size', CAST(p_size AS STRING), '/', CAST(p_partkey AS STRING)) AS path,
       2 * p_partkey AS l_idx,
       2 * p_partkey + CASE WHEN p_size % 10 = 0 THEN 3 ELSE 1 END AS r_idx
FROM {part}
UNION ALL
SELECT CAST(1000000000 + p_size AS BIGINT), CAST(NULL AS BIGINT), CONCAT('Size ', CAST(p_size AS STRING)),
       CONCAT('/Size', CAST(p_size AS STRING)), CAST(-1 AS BIGINT), CAST(1000000000 AS BIGINT)
FROM {part} GROUP BY p_size
"""
SHAPES["x_sites"] = """
SELECT CASE WHEN n_nationkey < 23 THEN n_nationkey ELSE n_nationkey + 100 END AS site_id, CONCAT('  ', n_name) AS name
FROM {nation}
"""
SHAPES["x_site_classes"] = "SELECT p_size % 25 AS site_id, p_partkey AS class_id FROM {part}"
SHAPES["x_dev_classes"] = """
SELECT DISTINCT l_suppkey AS device_id, l_partkey AS class_id, l_partkey % 7 AS ud_class_id FROM {lineitem}
"""
SHAPES["x_group_devices"] = "SELECT s_nationkey % 5 + 1 AS group_id, s_suppkey AS device_id FROM {supplier}"
SHAPES["x_devices"] = "SELECT s_suppkey AS device_id, s_name AS name FROM {supplier}"
SHAPES["x_partitions"] = """
SELECT CASE WHEN p_type = 'PROMO' THEN -p_partkey ELSE p_partkey END AS part_id,
       CONCAT('/Size', CAST(p_size AS STRING), '/', CAST(p_partkey AS STRING)) AS path
FROM {part}
"""
SHAPES["x_part_facts"] = """
SELECT 'month' AS grain,
       CAST(EXTRACT(YEAR FROM l_shipdate) * 12 + EXTRACT(MONTH FROM l_shipdate) AS BIGINT) AS period_id,
       MONTH_START(l_shipdate) AS datetime,
       l_suppkey AS device_id, l_partkey AS part_id,
       CAST(l_quantity * 1000 AS BIGINT) AS part_size_bps,
       CAST(ROUND(l_extendedprice * 10) AS BIGINT) AS bytes
FROM {lineitem}
"""
SHAPES["x_flows"] = """
SELECT 'month' AS grain,
       CAST(EXTRACT(YEAR FROM l_shipdate) * 12 + EXTRACT(MONTH FROM l_shipdate) AS BIGINT) AS period_id,
       l_shipdate AS datetime,
       l_suppkey AS device_id, l_partkey % 7 AS ud_class_id,
       CONCAT('10.0.', CAST(l_partkey % 9 AS STRING), '.', CAST(l_suppkey % 4 AS STRING)) AS src_ip,
       CONCAT('172.16.', CAST(l_orderkey % 20 AS STRING), '.', CAST(l_linenumber AS STRING)) AS dst_ip,
       l_linenumber AS vlan_id,
       CAST(ROUND(l_discount * 100) AS INT) AS tos,
       l_partkey % 5 AS service_id,
       l_linenumber AS ftype_num,
       CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS bytes,
       CAST(l_quantity AS BIGINT) AS pkts,
       CAST(1 AS BIGINT) AS flow_num,
       CASE WHEN l_returnflag = 'R' THEN CAST(ROUND(l_extendedprice) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS retrans_bytes,
       CAST(ROUND(l_tax * 10000) AS BIGINT) AS measure_1,
       CAST(ROUND(l_tax * 5000) AS BIGINT) AS measure_2,
       CAST(l_quantity AS BIGINT) AS measure_3
FROM {lineitem}
"""
SHAPES["x_services"] = "SELECT CAST(r_regionkey AS BIGINT) AS ord_id, r_name AS name FROM {region}"

# ---- accounts: customers as accounts, orders as users, suppliers as stores ----
SHAPES["x_account"] = """
SELECT c_custkey AS account_id, c_name AS account_name, UPPER(c_name) AS account_name_upper,
       CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 ELSE 1 END AS account_status,
       CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS account_type_mask,
       CONCAT(LOWER(c_mktsegment), '.example') AS account_web_domain,
       CONCAT('a', CAST(c_custkey AS STRING), '@mail.example') AS account_email_addr,
       CAST(-1 AS BIGINT) AS modified_id
FROM {customer}
"""
SHAPES["x_vendor_account"] = """
SELECT CASE WHEN c_acctbal < 2000 THEN -c_custkey ELSE c_custkey END AS account_id,
       CAST(c_custkey % 8 AS INT) AS fulfillment_type_mask,
       c_nationkey AS external_seller_id, c_custkey % 10 AS parent_id,
       CAST(100000 + c_nationkey AS BIGINT) AS remit_to_duns, CAST(c_nationkey AS STRING) AS vid,
       c_mktsegment AS description, CAST(c_custkey % 2 AS INT) AS channel_mask
FROM {customer}
"""
SHAPES["x_account_user"] = """
SELECT o_orderkey AS account_user_id, o_custkey AS account_id, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS is_owner,
       CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS account_user_status,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 40 END AS user_id,
       o_orderdate AS token_expiration_date
FROM {orders}
"""
SHAPES["x_web_account"] = """
SELECT o_orderkey AS account_id, CONCAT(o_orderpriority, ' ', CAST(o_orderkey AS STRING)) AS account_name,
       CASE WHEN o_orderpriority = '5-LOW' THEN CAST(NULL AS STRING) ELSE CAST(300000 + o_custkey AS STRING) END AS duns,
       CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END AS account_status,
       o_orderdate AS created_dtm
FROM {orders}
"""
SHAPES["x_pending_user"] = """
SELECT l_orderkey AS account_id, CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END AS account_user_status,
       l_shipdate AS token_expiration_date, l_linenumber AS line
FROM {lineitem}
"""
SHAPES["x_store"] = """
SELECT s_suppkey AS store_id, s_name AS store_name, s_nationkey % 3 AS store_type_id,
       CASE WHEN s_acctbal > 1000 THEN 1 ELSE 0 END AS operational_status
FROM {supplier}
"""
SHAPES["x_account_store"] = """
SELECT s_suppkey + 1 AS account_store_id, s_nationkey % 4 AS account_id, s_suppkey AS store_id,
       CONCAT('S', CAST(s_suppkey % 6 AS STRING)) AS external_store_id
FROM {supplier}
"""
SHAPES["x_address"] = """
SELECT s_suppkey AS address_id, s_name AS address_name, CONCAT('Street ', CAST(s_nationkey AS STRING)) AS street_1,
       CAST(s_acctbal AS DOUBLE) AS longitude
FROM {supplier}
"""
SHAPES["x_account_address"] = """
SELECT c_custkey AS account_address_id, c_nationkey AS account_id, c_custkey % 10 AS address_id,
       CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS account_address_status, c_mktsegment AS account_address_type_cd
FROM {customer}
"""
SHAPES["x_shard"] = """
SELECT n_nationkey AS shard_id, n_nationkey AS shard_index, n_name AS shard_name, n_regionkey AS shard_type_id,
       CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 31 END AS shard_type_bit_value,
       3306 AS db_port, CONCAT(LOWER(n_name), '.example') AS db_host, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE 1 END AS shard_status
FROM {nation}
"""
SHAPES["x_shard_type"] = """
SELECT r_regionkey AS shard_type_id, r_name AS shard_type_name,
       CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS shard_type_bit_value
FROM {region}
"""
SHAPES["x_hierarchy"] = """
SELECT p_partkey AS store_hierarchy_id, p_name AS store_hierarchy_name, p_size % 3 AS store_id,
       CASE WHEN p_partkey = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(FLOOR(p_partkey / 10) AS BIGINT) END AS parent_store_hierarchy_id,
       CAST((p_partkey * 7) % 1000 AS STRING) AS external_hierarchy_id,
       CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN CONCAT(p_type, '|', p_brand)
            ELSE CONCAT(p_type, '|', p_brand, '|', p_name) END AS store_hierarchy_display_path,
       CONCAT(p_brand, '/', p_type) AS external_hierarchy_id_path,
       CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS status
FROM {part}
"""

# ---- catalog: orders as items, parts as content, line items as log ----
# Five consecutive orders make a relation whose first order is the dummy parent; in every
# third run of five the orders are single items, outside any relation.
SHAPES["x_item"] = """
SELECT o_orderkey AS item_id, o_custkey % 10 AS account_id, 1 AS account_type,
       CASE WHEN o_orderstatus <> 'P' THEN 3 ELSE 1 END AS fulfillment_type,
       CONCAT('W', CAST(o_orderkey AS STRING)) AS websku, CONCAT('P', CAST(o_custkey AS STRING)) AS pid,
       CASE WHEN FLOOR(o_orderkey / 5) % 3 = 0 THEN CAST(NULL AS INT) WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS dummy_item_flag,
       CASE WHEN FLOOR(o_orderkey / 5) % 3 = 0 THEN 1 WHEN FLOOR(o_orderkey / 5) % 3 = 1 THEN 2 ELSE 6 END AS relation_type_mask,
       o_custkey % 25 AS content_item_class_id, o_custkey AS content_item_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS seller_item_status,
       CAST(o_orderkey % 5 AS INT) AS catalog_status,
       MONTH_START(o_orderdate) AS created_dtm, o_orderdate AS modified_dtm,
       CAST(o_custkey % 30 AS INT) AS shc_division_nbr, o_custkey AS shc_hierarchy_id, o_custkey % 50 AS core_hierarchy_id,
       o_custkey % 11 AS modified_id, o_orderkey % 97 AS ksn_id, o_orderkey % 89 AS ima_item_id, o_orderkey % 83 AS core_item_number,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS allocation_mask,
       CASE o_orderstatus WHEN 'F' THEN 'S' WHEN 'O' THEN 'K' ELSE 'X' END AS owner_code,
       CONCAT('~|~mfgname== Maker ', CAST(o_custkey % 7 AS STRING), '~|~title==T ', o_orderpriority, ' ~|~',
              CASE WHEN o_orderkey % 2 = 0 THEN 'brand==B1~|~' ELSE '' END) AS ima_attribute_values
FROM {orders}
"""
SHAPES["x_item_relation_detail"] = """
SELECT o_orderkey AS item_id, CAST(FLOOR(o_orderkey / 5) AS BIGINT) AS item_relation_id,
       CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END AS status
FROM {orders} WHERE FLOOR(o_orderkey / 5) % 3 <> 0 AND o_orderkey % 5 <> 0
"""
SHAPES["x_item_relation"] = """
SELECT CAST(FLOOR(o_orderkey / 5) AS BIGINT) AS item_relation_id, o_orderkey AS base_item_id,
       CASE WHEN o_orderkey % 35 = 0 THEN 0 ELSE 1 END AS status
FROM {orders} WHERE FLOOR(o_orderkey / 5) % 3 <> 0 AND o_orderkey % 5 = 0
"""
SHAPES["x_item_relation_type"] = """
SELECT CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 7 ELSE 16 END AS bit_value,
       r_name AS item_relation_type_name
FROM {region}
"""
SHAPES["x_content_item"] = """
SELECT p_partkey AS content_item_id, CONCAT('00', CAST(p_partkey AS STRING)) AS upc, p_name AS name,
       CASE WHEN p_size % 9 = 0 THEN 0 ELSE 1 END AS status, p_size % 3 AS enrichment_status,
       p_size % 5 AS brand_id, CONCAT('M', p_brand) AS manufacturer_model_num
FROM {part}
"""
SHAPES["x_item_class"] = """
SELECT n_nationkey AS content_item_class_id,
       CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE CONCAT('R', CAST(n_regionkey AS STRING), '|', n_name) END
         AS content_item_class_display_path
FROM {nation}
"""
SHAPES["x_lookup"] = """
SELECT 18 AS lookup_type_id, r_regionkey AS lookup_value, r_name AS lookup_description FROM {region}
UNION ALL SELECT 19, r_regionkey, CONCAT('seller ', r_name) FROM {region}
UNION ALL SELECT 20, r_regionkey, CONCAT('enriched ', r_name) FROM {region} WHERE r_regionkey > 0
"""
SHAPES["x_item_log"] = """
SELECT l_orderkey AS item_id, l_orderkey % 40 AS account_id, CAST(l_linenumber % 6 AS INT) AS catalog_status,
       YEAR_START(l_shipdate) AS log_created_dtm
FROM {lineitem}
"""
SHAPES["x_vendor_package"] = """
SELECT l_orderkey AS item_id, l_orderkey * 10 + l_linenumber AS item_vendor_package_id,
       CAST(1 + l_suppkey % 3 AS INT) AS store_id, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS status,
       CAST(l_linenumber % 3 AS INT) AS ima_exchange_status, l_suppkey AS order_duns_number,
       CONCAT('V', CAST(l_partkey AS STRING)) AS vendor_stk_number,
       CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate ELSE CAST(NULL AS TIMESTAMP) END AS ima_timestamp,
       CASE WHEN l_linenumber % 4 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE l_shipdate END AS modified_dtm
FROM {lineitem}
"""
SHAPES["x_item_site"] = """
SELECT o_orderkey AS item_id, CAST(o_orderkey % 5 AS INT) AS site_id, 1 AS status FROM {orders}
UNION ALL
SELECT o_orderkey, CAST((o_orderkey + 2) % 5 AS INT), CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END FROM {orders}
"""
SHAPES["x_site"] = "SELECT r_regionkey AS site_id, r_name AS site_name FROM {region}"
SHAPES["x_ban_rule"] = "SELECT n_nationkey AS ban_rule_id, CONCAT('rule ', n_name) AS ban_rule_name FROM {nation}"
SHAPES["x_item_ban_rule"] = """
SELECT l_orderkey AS item_id, CAST(l_suppkey % 25 AS INT) AS ban_rule_id, CASE WHEN l_linenumber <= 2 THEN 1 ELSE 0 END AS status
FROM {lineitem}
"""
SHAPES["x_sticky_ban"] = """
SELECT o_orderkey AS item_id, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS sticky_ban_state FROM {orders}
"""
SHAPES["x_brand"] = "SELECT r_regionkey AS brand_id, r_name AS brand_name FROM {region}"
SHAPES["x_profile"] = """
SELECT r_regionkey AS profile_id, CASE WHEN r_regionkey = 0 THEN 'INTERNAL_SETTINGS' ELSE r_name END AS profile_name FROM {region}
"""
SHAPES["x_profile_value"] = """
SELECT r_regionkey AS profile_id, 'IMA_PENDING_THRESHOLD' AS profile_term_type, 86400 * (900 + r_regionkey) AS profile_term_value
FROM {region}
"""
SHAPES["x_outer_item"] = """
SELECT event_id AS external_item_id, CONCAT('X', CAST(user_id AS STRING)) AS product_id, CONCAT('0', CAST(event_id AS STRING)) AS upc,
       event_type AS title, ts AS modified_dtm, MONTH_START(ts) AS created_dtm, CONCAT('N', CAST(user_id AS STRING)) AS manufacturer_part_number,
       CONCAT('Maker ', event_type) AS manufacturer_name, YEAR_START(ts) AS lastdeliverydate, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status,
       CAST(user_id % 2 AS INT) AS external_account_id
FROM {events}
"""
SHAPES["x_outer_attribute_value"] = """
SELECT event_id AS external_item_id, CAST(event_id % 3 AS INT) AS external_attribute_id, CAST(user_id % 25 AS INT) AS external_value_id,
       CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS status
FROM {events}
"""
SHAPES["x_outer_attribute"] = """
SELECT r_regionkey AS external_attribute_id,
       CASE WHEN r_regionkey <= 1 THEN 'Shop Data Quality Score' ELSE r_name END AS attribute_name, 1 AS status
FROM {region}
"""
SHAPES["x_outer_value"] = """
SELECT n_nationkey AS external_value_id, n_name AS value_name, CASE WHEN n_nationkey = 3 THEN 0 ELSE 1 END AS status FROM {nation}
"""
SHAPES["x_outer_account"] = """
SELECT r_regionkey AS external_account_id, CASE WHEN r_regionkey = 1 THEN 'Shop' ELSE r_name END AS account_name, 1 AS status FROM {region}
"""
SHAPES["x_outer_mapping"] = """
SELECT CASE WHEN event_type = 'click' THEN -event_id ELSE event_id END AS external_item_id, event_id % 50 AS content_item_id
FROM {events}
"""

# ---- sales ----
SHAPES["x_purchase_order"] = """
SELECT o_orderkey AS purchase_order_id, o_custkey AS account_id, CAST(300000 + o_custkey AS STRING) AS duns_number,
       o_orderkey * 3 AS po_number, o_orderdate AS po_date, CAST(o_orderkey % 4 AS INT) AS po_status_id,
       o_orderdate AS sales_date, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 4 END AS program_type_mask
FROM {orders}
"""
SHAPES["x_purchase_order_line"] = """
SELECT l_orderkey AS purchase_order_id, o_custkey AS account_id, l_linenumber AS com_line_number,
       l_partkey AS item_number, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS selling_price,
       CASE WHEN l_linestatus = 'O' THEN 2 ELSE 1 END AS fulfillment_status_id,
       CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber ELSE CAST(NULL AS BIGINT) END AS return_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
SHAPES["x_com_line_detail"] = """
SELECT l_orderkey AS purchase_order_id, l_linenumber AS com_line_number,
       CONCAT('E', CAST(MIN(l_partkey) AS STRING)) AS external_product_id, MIN(l_returnflag) AS name
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""
SHAPES["x_return"] = """
SELECT l_orderkey * 10 + l_linenumber AS return_id, MIN(o_custkey) AS account_id, MAX(l_shipdate) AS return_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
GROUP BY l_orderkey * 10 + l_linenumber
"""

# ---- loads: orders split into stage and delta, events as change log and ledger ----
SHAPES["x_stage"] = "SELECT * FROM {orders} WHERE o_orderdate < CAST('1999-06-01' AS TIMESTAMP)"
SHAPES["x_delta"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderdate >= CAST('1999-01-01' AS TIMESTAMP)
UNION ALL
SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderdate >= CAST('2000-01-01' AS TIMESTAMP) AND o_orderkey % 3 = 0
"""
SHAPES["x_log"] = """
SELECT event_id AS log_id, user_id AS master_id, ts AS log_created_dtm, event_id AS modified_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'seen' WHEN event_type = 'error' THEN CAST(NULL AS STRING) ELSE 'done' END AS state,
       CASE WHEN value > 30 THEN 'big' ELSE 'small' END AS size_lower,
       CASE WHEN value > 60 THEN 1 ELSE 0 END AS big
FROM {events}
"""
SHAPES["x_ledger"] = """
SELECT event_id AS control_download_id, CAST(FLOOR(event_id / 100) AS BIGINT) AS download_num,
       CONCAT('db', CAST(1 + event_id % 2 AS STRING)) AS host_alias, CONCAT('0', CAST(1 + event_id % 3 AS STRING)) AS shard_number,
       CONCAT('user_', CAST(user_id AS STRING)) AS src_table_name,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS download_status,
       CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END AS append_status,
       CASE WHEN event_type = 'click' THEN 'STAGE' ELSE 'DELTA' END AS control_type,
       ts AS control_start_dtm, ts AS control_end_dtm, ts AS modified_at,
       CAST(ROUND(value * 100) AS BIGINT) AS proc_rows, CAST(ROUND(value) AS BIGINT) AS proc_duration
FROM {events}
"""
SHAPES["x_stage_rows"] = """
SELECT CONCAT('user_', CAST(user_id AS STRING)) AS src_table_name, ts AS dtm FROM {events}
"""
SHAPES["x_columns"] = """
SELECT DISTINCT LOWER(p_type) AS table_schema,
       CONCAT(REPLACE(LOWER(p_brand), '#', '_'), CASE WHEN p_size % 2 = 0 THEN '_log' ELSE '' END) AS table_name,
       CASE WHEN p_size % 8 = 1 THEN 'modified_dtm' WHEN p_size % 8 = 2 THEN 'log_created_dtm' WHEN p_size % 8 = 3 THEN 'account_id'
            ELSE CONCAT(REPLACE(p_name, ' ', '_'), CASE WHEN p_size % 2 = 0 THEN '_log' ELSE '' END) END AS column_name,
       CASE WHEN p_size % 8 = 5 OR p_size % 8 = 6 THEN 'PRI' ELSE '' END AS column_key,
       p_size AS ordinal_position
FROM {part}
"""
SHAPES["x_catalog"] = """
SELECT table_schema, table_name, column_name, MAX(column_key) AS column_key, MIN(ordinal_position) AS ordinal_position
FROM {x_columns} GROUP BY table_schema, table_name, column_name
"""
SHAPES["x_shard_profiles"] = """
SELECT n_nationkey AS shard_profile_id, CASE WHEN n_nationkey % 2 = 0 THEN 'db1' ELSE 'db2' END AS host_alias,
       LPAD(CAST(n_nationkey AS STRING), 2, '0') AS shard_number, CASE WHEN n_regionkey = 4 THEN 0 ELSE 1 END AS status,
       'shard_account_list' AS shard_table_name
FROM {nation}
"""
SHAPES["x_local_columns"] = """
SELECT REPLACE(p_brand, '#', '_') AS table_name, REPLACE(p_name, ' ', '_') AS column_name,
       CASE WHEN MIN(p_size) > 12 THEN 'timestamp' ELSE LOWER(MIN(p_type)) END AS column_type,
       CASE WHEN MAX(p_size) > 44 THEN 'PRI' WHEN MAX(p_size) > 38 THEN 'MUL' ELSE '' END AS column_key,
       CASE WHEN MIN(p_size) % 2 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
       CASE WHEN MIN(p_size) % 3 = 0 THEN '0000-00-00 00:00:00' ELSE CAST(NULL AS STRING) END AS column_default,
       MIN(p_size) AS ordinal_position
FROM {part} WHERE p_type <> 'PROMO' GROUP BY p_brand, p_name
"""
SHAPES["x_remote_columns"] = """
SELECT REPLACE(p_brand, '#', '_') AS table_name, REPLACE(p_name, ' ', '_') AS column_name,
       CASE WHEN MIN(p_size) > 12 THEN 'timestamp' ELSE LOWER(MIN(p_type)) END AS column_type,
       CASE WHEN MAX(p_size) > 44 THEN 'PRI' WHEN MAX(p_size) > 38 THEN 'MUL' ELSE '' END AS column_key,
       CASE WHEN MIN(p_size) % 2 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
       CASE WHEN MIN(p_size) % 3 = 0 THEN '0000-00-00 00:00:00' ELSE CAST(NULL AS STRING) END AS column_default,
       MIN(p_size) AS ordinal_position
FROM {part} WHERE p_type <> 'SMALL' GROUP BY p_brand, p_name
"""
SHAPES["x_local_indexes"] = """
SELECT REPLACE(p_brand, '#', '_') AS table_name, CASE WHEN p_type = 'PROMO' THEN 'PRIMARY' ELSE CONCAT('idx_', LOWER(p_type)) END AS index_name,
       CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END AS non_unique, REPLACE(p_name, ' ', '_') AS column_name, MIN(p_partkey) AS seq_in_index
FROM {part} GROUP BY p_brand, p_type, p_name
"""
SHAPES["x_remote_indexes"] = """
SELECT REPLACE(p_brand, '#', '_') AS table_name, CASE WHEN p_type = 'PROMO' THEN 'PRIMARY' ELSE CONCAT('db1_idx_', LOWER(p_type)) END AS index_name,
       CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END AS non_unique, REPLACE(p_name, ' ', '_') AS column_name, MIN(p_partkey) AS seq_in_index
FROM {part} WHERE p_size <> 7 GROUP BY p_brand, p_type, p_name
"""

# ---- storage and metrics ----
SHAPES["x_spaces"] = """
SELECT n_nationkey AS ts, n_name AS name, CASE WHEN n_nationkey % 7 = 6 THEN 3 WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS online
FROM {nation}
"""
SHAPES["x_files"] = """
SELECT s_nationkey AS ts, s_suppkey AS file, CONCAT('/data/', s_name) AS file_name, CASE WHEN s_suppkey % 8 = 0 THEN 1 ELSE 2 END AS status,
       CAST(50000000 + s_suppkey * 10 AS BIGINT) AS blocks
FROM {supplier}
"""
SHAPES["x_extents"] = """
SELECT s_nationkey AS ts, CASE WHEN s_acctbal > 500 THEN l_suppkey ELSE -l_suppkey END AS file,
       CAST(l_quantity AS BIGINT) AS length
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""
SHAPES["x_tablespaces"] = """
SELECT n_name AS tablespace_name, CASE WHEN n_regionkey = 1 THEN 'TEMPORARY' ELSE 'PERMANENT' END AS contents,
       'LOCAL' AS extent_management, CASE WHEN n_nationkey % 9 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS status
FROM {nation}
"""
SHAPES["x_data_files"] = """
SELECT n_name AS tablespace_name, s_suppkey AS file_id, CAST(104857600 + s_suppkey * 1024 AS BIGINT) AS bytes
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_regionkey <> 1
"""
SHAPES["x_temp_files"] = """
SELECT n_name AS tablespace_name, s_suppkey AS file_id, CAST(52428800 + s_suppkey * 2048 AS BIGINT) AS bytes
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_regionkey = 1
"""
SHAPES["x_free_space"] = """
SELECT n_name AS tablespace_name, l_suppkey AS file_id, CAST(l_quantity * 1024 AS BIGINT) AS bytes
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE n_regionkey <> 1
"""
SHAPES["x_temp_free"] = """
SELECT n_name AS tablespace_name, l_suppkey AS file_id, CAST(l_quantity * 512 AS BIGINT) AS bytes
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
WHERE n_regionkey = 1
"""
SHAPES["x_sysstat"] = """
SELECT CASE CAST(l_partkey % 10 AS INT) WHEN 0 THEN 'parse count' WHEN 1 THEN 'opened cursors cumulative' WHEN 2 THEN 'recursive calls'
            WHEN 3 THEN 'physical reads' WHEN 4 THEN 'db block gets' WHEN 5 THEN 'consistent gets' WHEN 6 THEN 'physical writes'
            WHEN 7 THEN 'table scan blocks gotten' WHEN 8 THEN 'table scans (short tables)' ELSE 'table scans (long tables)' END AS name,
       CASE WHEN l_partkey % 10 = 8 THEN CAST(1 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS value
FROM {lineitem}
"""
SHAPES["x_latch"] = """
SELECT event_type AS name, CAST(ROUND(value * 100) AS BIGINT) AS gets, CAST(FLOOR(value / 50) AS BIGINT) AS misses FROM {events}
"""
SHAPES["x_waits"] = """
SELECT CASE event_type WHEN 'click' THEN 'undo header' WHEN 'view' THEN 'undo block' WHEN 'error' THEN 'system undo header' ELSE event_type END AS class,
       CAST(ROUND(value) AS BIGINT) AS count
FROM {events}
"""
