"""Account, store and shard lookups and account maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shardline.gallery.base import query
from shardline.operators.hierarchy import with_children_flag
from shardline.plans import accounts as plans
from shardline.plans.sales import sales_and_returns

ACCOUNT_COLUMNS = "account_id, account_name, account_status, fulfillment_type_mask, external_seller_id, parent_id, remit_to_duns, user_id"
ACCOUNT_JOINS = """x_account a LEFT JOIN x_vendor_account va ON a.account_id = va.account_id
  LEFT JOIN x_account_user au ON a.account_id = au.account_id AND au.is_owner = 1"""
ACCOUNT_SELECT = f"""SELECT a.account_id, a.account_name, a.account_status, va.fulfillment_type_mask, va.external_seller_id,
  va.parent_id, va.remit_to_duns, au.user_id FROM {ACCOUNT_JOINS}"""


def _accounts(t, *args, **filters):
    rows = plans.find_accounts(t.account, t.vendor_account, t.account_user, *args, **filters)
    return rows.select(*[c.strip() for c in ACCOUNT_COLUMNS.split(",")])


query("f1_optional_filters_none_given", ACCOUNT_SELECT)(lambda t: _accounts(t))
query(
    "f1_optional_filters_all_given",
    ACCOUNT_SELECT
    + """ WHERE a.account_name_upper LIKE 'CUSTOMER#0000%' AND va.fulfillment_type_mask & 6 <> 0 AND va.external_seller_id = 4
          AND va.parent_id = 3 AND va.remit_to_duns = 100004 AND a.account_type_mask & 14 <> 0 AND a.account_status = 1""",
)(
    lambda t: _accounts(
        t, name="customer#0000", fulfillment_mask=6, external_seller_id=4, parent_id=3, duns=100004, type_mask=14, active=1
    )
)
query(
    "r9_accounts_page",
    ACCOUNT_SELECT
    + """ WHERE a.account_type_mask & 8 <> 0 AND a.account_status = 1
          ORDER BY a.account_name, a.account_id, au.user_id NULLS FIRST LIMIT 20 OFFSET 10""",
)(lambda t: _accounts(t, 10, 20, type_mask=8, active=1))
query(
    "r10_account_count",
    f"SELECT COUNT(a.account_id) AS out_count FROM {ACCOUNT_JOINS} WHERE a.account_name_upper LIKE '%MER#00000%' AND a.account_type_mask & 3 <> 0",
)(
    lambda t: plans.count_accounts(t.account, t.vendor_account, t.account_user, name="mer#00000", type_mask=3)
)
query("a12_count_over_outer_joins", f"SELECT COUNT(a.account_id) AS out_count FROM {ACCOUNT_JOINS}")(
    lambda t: plans.count_accounts(t.account, t.vendor_account, t.account_user)
)

USER_COLUMNS = ["account_user_id", "account_id", "is_owner", "account_user_status", "account_name", "account_status", "user_id"]

# what each known user sees of the accounts that the user belongs to
OWN_ACCOUNTS = """
       names AS (SELECT account_id, account_status, account_name FROM x_account),
       own AS (SELECT user_id, is_owner, account_user_id, account_user_status, account_id, account_status, account_name
               FROM names JOIN x_account_user USING (account_id) WHERE user_id IS NOT NULL)"""


@query(
    "r8_user_accounts_with_vendor",
    f"""WITH {OWN_ACCOUNTS},
       channels AS (SELECT account_id, channel_mask, remit_to_duns FROM x_vendor_account)
       SELECT own.*, channel_mask, remit_to_duns FROM own LEFT JOIN channels USING (account_id) WHERE account_user_status = 1""",
)
def _(t):
    rows = plans.user_accounts(t.account_user, t.account, t.vendor_account)
    return rows.select(*USER_COLUMNS, "remit_to_duns", "channel_mask")


@query(
    "r8_user_accounts_of_one_user",
    f"WITH {OWN_ACCOUNTS} SELECT * FROM own WHERE user_id = 17",
)
def _(t):
    return plans.user_accounts(t.account_user, t.account, user_id=17).select(*USER_COLUMNS)


SELLERS = """SELECT duns AS seller_duns_number, account_name AS seller_name, STRFTIME(created_dtm, '%m/%d/%Y') AS seller_start_date
  FROM x_web_account WHERE duns IS NOT NULL AND created_dtm BETWEEN """
query("r7_sellers", SELLERS + "TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-09-15'")(
    lambda t: plans.sellers(t.web_account, dt.date(2001, 1, 1), dt.date(1997, 1, 1), dt.date(1998, 9, 15))
)
query("c8_default_dates", SELLERS + "TIMESTAMP '1999-03-09' AND TIMESTAMP '1999-03-10'")(
    lambda t: plans.sellers(t.web_account, dt.date(1999, 3, 10))
)
query("r11_account_exists", "SELECT account_id FROM x_account WHERE account_name_upper = UPPER('customer#000000007')")(
    lambda t: plans.account_exists(t.account, "customer#000000007")
)
query("r11_account_status", "SELECT account_status FROM x_account WHERE account_id = 7")(
    lambda t: plans.account_status(t.account, 7)
)
query(
    "r12_account_addresses",
    """SELECT aa.account_address_id, aa.account_id, aa.account_address_status, aa.account_address_type_cd,
              a.address_name, a.street_1, a.longitude
       FROM x_account_address aa JOIN x_address a ON a.address_id = aa.address_id
       WHERE aa.account_address_status <> 0 AND aa.account_id = 4""",
)(lambda t: plans.account_addresses(t.account_address, t.address, 4))
STORES = """SELECT l.account_store_id, l.account_id, l.external_store_id, s.store_id, s.store_name, s.store_type_id, s.operational_status
  FROM x_account_store l JOIN x_store s ON s.store_id = l.store_id WHERE s.operational_status = 1 AND l.account_id = 2"""
query("r13_stores", STORES)(lambda t: plans.account_stores(t.store, t.account_store, 2))
query("r13_stores_filtered", STORES + " AND l.external_store_id = 'S3' AND s.store_type_id = 0")(
    lambda t: plans.account_stores(t.store, t.account_store, 2, external_store_id="S3", store_type_id=0)
)
query(
    "r14_shards",
    """SELECT s.shard_id, s.shard_index, s.shard_name, ty.shard_type_name, s.db_port, s.db_host, s.shard_status
       FROM x_shard s JOIN x_shard_type ty ON ty.shard_type_id = s.shard_type_id""",
)(lambda t: plans.all_shards(t.shard, t.shard_type))
query(
    "s2_active_shards_of_a_type",
    """SELECT s.shard_index, s.db_host, s.db_port FROM x_shard s, x_shard_type ty WHERE UPPER(ty.shard_type_name) = 'AMERICA'
       AND s.shard_type_bit_value & ty.shard_type_bit_value = ty.shard_type_bit_value AND s.shard_status = 1""",
)(lambda t: plans.active_shards(t.shard, t.shard_type, "america"))
query(
    "s2_active_shard_of_house_account",
    """SELECT s.shard_index, s.db_host, s.db_port FROM x_shard s, x_shard_type ty, customer va WHERE UPPER(ty.shard_type_name) = 'AMERICA'
       AND s.shard_type_bit_value & ty.shard_type_bit_value = ty.shard_type_bit_value AND s.shard_status = 1
       AND s.shard_index = va.c_nationkey AND va.c_custkey = 1""",
)(
    lambda t: plans.active_shards(
        t.shard,
        t.shard_type,
        "america",
        t.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("catalog_shard_index")),
        account_id=1,
    )
)

HIERARCHY = """SELECT h.store_hierarchy_id, h.store_hierarchy_name, h.store_id, h.parent_store_hierarchy_id, h.external_hierarchy_id,
  h.store_hierarchy_display_path, h.external_hierarchy_id_path, h.status,
  CASE WHEN EXISTS (SELECT 1 FROM x_hierarchy c WHERE c.parent_store_hierarchy_id = h.store_hierarchy_id) THEN 1 ELSE 0 END AS has_children
  FROM x_hierarchy h"""
query("r15_store_hierarchy", HIERARCHY + " WHERE h.store_hierarchy_id <> 0")(
    lambda t: plans.store_hierarchy(t.hierarchy)
)
query(
    "r15_store_hierarchy_filtered",
    HIERARCHY + " WHERE h.store_hierarchy_id <> 0 AND h.parent_store_hierarchy_id = 3 AND h.store_id = 1",
)(lambda t: plans.store_hierarchy(t.hierarchy, parent_id=3, store_id=1))
query("j8_has_children_flag", HIERARCHY)(
    lambda t: with_children_flag(t.hierarchy, "store_hierarchy_id", "parent_store_hierarchy_id")
)

# all users of the account are pending, and a token of theirs has been out of date for more than two days
EXPIRED = """SELECT account_id FROM (
    SELECT account_id, BOOL_AND(account_user_status = 2) AS nobody_joined,
           MIN(CASE WHEN account_user_status = 2 THEN token_expiration_date END) AS oldest
    FROM x_pending_user GROUP BY account_id)
  JOIN x_web_account USING (account_id) WHERE nobody_joined AND oldest < TIMESTAMP '1999-12-30' AND account_status = 2"""
AS_OF = dt.datetime(2000, 1, 1)
query("e20_expired_accounts", EXPIRED)(
    lambda t: plans.expired_accounts(t.web_account, t.pending_user, AS_OF).select("account_id")
)
query(
    "e20_purge_accounts",
    f"SELECT account_id, account_name, account_status FROM x_web_account WHERE account_id NOT IN ({EXPIRED})",
)(
    lambda t: plans.purge_expired(t.web_account, t.pending_user, AS_OF)[0].select(
        "account_id", "account_name", "account_status"
    )
)
query(
    "e20_purge_users",
    """SELECT account_id, account_user_status, line FROM x_pending_user
       WHERE NOT (account_user_status = 2 AND TIMESTAMP '2000-01-01' > token_expiration_date + INTERVAL 2 DAY)""",
)(
    lambda t: plans.purge_expired(t.web_account, t.pending_user, AS_OF)[1].select(
        "account_id", "account_user_status", "line"
    )
)


@query(
    "e18_bulk_status_update",
    """SELECT o_orderkey AS item_id, CASE WHEN h.k IS NOT NULL THEN 2 ELSE CAST(o_orderkey % 5 AS INT) END AS catalog_status,
              CASE WHEN h.k IS NOT NULL THEN 98 ELSE o_custkey END AS modified_id
       FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') h ON h.k = o_orderkey""",
)
def _(t):
    items = t.item.select(
        "item_id", "catalog_status", F.col("content_item_id").alias("modified_id")
    )
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"))
    return plans.bulk_status(items, "item_id", returned, "catalog_status", 2, 98)


EDITS = """SELECT s_suppkey AS account_id, CASE WHEN s_acctbal > 3000 THEN s_name END AS account_name,
  CASE WHEN s_nationkey = 3 THEN 0 WHEN s_nationkey > 10 THEN s_nationkey END AS fulfillment_type_mask,
  CASE WHEN s_acctbal < 2000 THEN 'edited' END AS description FROM supplier"""


def _edits(t):
    s = t.supplier
    return s.select(
        F.col("s_suppkey").alias("account_id"),
        F.when(F.col("s_acctbal") > 3000, F.col("s_name")).alias("account_name"),
        F.when(F.col("s_nationkey") == 3, 0)
        .when(F.col("s_nationkey") > 10, F.col("s_nationkey"))
        .alias("fulfillment_type_mask"),
        F.when(F.col("s_acctbal") < 2000, "edited").alias("description"),
    )


query(
    "e19_sparse_update_accounts",
    f"""WITH e AS ({EDITS}) SELECT a.account_id, COALESCE(e.account_name, a.account_name) AS account_name,
        CASE WHEN e.account_id IS NOT NULL THEN 77 ELSE a.modified_id END AS modified_id
        FROM x_account a LEFT JOIN (SELECT * FROM e WHERE COALESCE(fulfillment_type_mask, 1) > 0) e ON e.account_id = a.account_id""",
)(
    lambda t: plans.edit_accounts(t.account, t.vendor_account, _edits(t), 77)[0].select(
        "account_id", "account_name", "modified_id"
    )
)
query(
    "e19_sparse_update_vendors",
    f"""WITH e AS ({EDITS}) SELECT v.account_id, COALESCE(e.fulfillment_type_mask, v.fulfillment_type_mask) AS fulfillment_type_mask,
        COALESCE(e.description, v.description) AS description
        FROM x_vendor_account v LEFT JOIN (SELECT * FROM e WHERE COALESCE(fulfillment_type_mask, 1) > 0) e ON e.account_id = v.account_id""",
)(
    lambda t: plans.edit_accounts(t.account, t.vendor_account, _edits(t), 77)[1].select(
        "account_id", "fulfillment_type_mask", "description"
    )
)
query(
    "e19_rejected_edits",
    f"WITH e AS ({EDITS}) SELECT account_id, -3 AS error_code FROM e WHERE fulfillment_type_mask <= 0",
)(
    lambda t: plans.edit_accounts(t.account, t.vendor_account, _edits(t), 77)[2].select("account_id", "error_code")
)

REQUESTS = """SELECT c_custkey AS account_id, c_name AS account_name, CAST(c_nationkey - 1 AS INT) AS fulfillment_type_mask,
  CAST(c_custkey % 36 AS INT) AS account_type_mask FROM customer"""
GOOD_MASK = "fulfillment_type_mask > 0 AND account_type_mask > 0 AND account_type_mask & (account_type_mask - 1) = 0 AND account_type_mask <= 16"


def _ingest(t):
    requests = t.customer.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("account_name"),
        (F.col("c_nationkey") - 1).alias("fulfillment_type_mask"),
        (F.col("c_custkey") % 36).cast("int").alias("account_type_mask"),
    )
    codes = F.when(F.col("shard_type_name") == "AFRICA", "CP").when(F.col("shard_type_name") == "ASIA", "ICE")
    types = t.shard_type.select(
        F.coalesce(codes, "shard_type_name").alias("account_type_code"),
        F.col("shard_type_bit_value").alias("account_type_bit"),
    )
    return plans.ingest_accounts(
        requests, types, t.shard, t.shard_type, 77, dt.datetime(2012, 3, 4), catalog_type="AFRICA", order_type="ASIA"
    )


STAMP = "77 AS modified_id, TIMESTAMP '2012-03-04' AS created_dtm"
query(
    "e21_ingest_accounts",
    f"WITH q AS ({REQUESTS}) SELECT account_id, account_name, account_type_mask, {STAMP} FROM q WHERE {GOOD_MASK}",
)(lambda t: _ingest(t)[0].select("account_id", "account_name", "account_type_mask", "modified_id", "created_dtm"))


@query(
    "e21_ingest_vendor_rows",
    f"""WITH q AS ({REQUESTS})
        SELECT account_id, fulfillment_type_mask, 1 AS channel_mask, 'AFRICA' AS catalog_type, 'ASIA' AS order_type, {STAMP}
        FROM q WHERE {GOOD_MASK} AND account_type_mask & 5 = 0""",
)
def _(t):
    """The type of each chosen shard, found only if the shard is active."""
    active = t.shard.where("shard_status = 1").join(t.shard_type, "shard_type_id")

    def typed(index: str, name: str):
        return active.select(F.col("shard_index").alias(index), F.col("shard_type_name").alias(name))

    rows = _ingest(t)[1]
    for index, name in (("catalog_shard_index", "catalog_type"), ("oms_shard_index", "order_type")):
        rows = rows.join(typed(index, name), index)
    return rows.select(
        "account_id", "fulfillment_type_mask", "channel_mask", "catalog_type", "order_type", "modified_id", "created_dtm"
    )


query(
    "e21_rejected_requests",
    f"WITH q AS ({REQUESTS}) SELECT account_id, -3 AS error_code FROM q WHERE NOT ({GOOD_MASK})",
)(lambda t: _ingest(t)[2].select("account_id", "error_code"))


@query(
    "e21_ingest_addresses",
    """SELECT s_suppkey AS address_id, s_nationkey AS account_id, 'S' AS account_address_type_cd, 1 AS account_address_status,
              5 AS modified_id, s_name AS address_name, 1 AS address_status FROM supplier""",
)
def _(t):
    requests = t.supplier.select(
        F.col("s_suppkey").alias("address_id"),
        F.col("s_nationkey").alias("account_id"),
        F.col("s_name").alias("address_name"),
        F.lit("S").alias("account_address_type_cd"),
    )
    addresses, links = plans.ingest_addresses(requests, 5, AS_OF)
    joined = links.drop("created_dtm").join(addresses.drop("modified_id", "created_dtm"), "address_id")
    return joined


query(
    "e21_ingest_contacts",
    """SELECT c_custkey AS account_id, c_name AS first_name, c_mktsegment AS phone, 1 AS status, 5 AS modified_id,
              TIMESTAMP '2000-01-01' AS created_dtm FROM customer""",
)(
    lambda t: plans.ingest_contacts(
        t.customer.select(
            F.col("c_custkey").alias("account_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("phone")
        ),
        5,
        AS_OF,
    )
)


@query(
    "e21_ingest_messages",
    """SELECT conv_id * 1000 + turn AS account_message_id, conv_id AS account_id, role AS account_message_subject,
              text AS account_message_body, 9 AS modified_id, 9 AS created_id, TIMESTAMP '2000-01-01' AS created_dtm FROM conversations""",
)
def _(t):
    requests = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("account_message_id"),
        F.col("conv_id").alias("account_id"),
        F.col("role").alias("account_message_subject"),
        F.col("text").alias("account_message_body"),
    )
    return plans.ingest_messages(requests, 9, AS_OF)


def _sales_sql(only: str = "true") -> str:
    """Lines by all that they show; shipped lines are counted, and of them those with a return."""
    return f"""
    WITH sold AS (
      SELECT * FROM x_purchase_order JOIN (SELECT account_id, account_name FROM x_account WHERE account_type_mask = 4) USING (account_id)
      WHERE program_type_mask = 4 AND {only}),
    back AS (SELECT return_id, account_id, strftime(return_date, '%m/%d/%Y') AS returned FROM x_return
             WHERE return_date >= TIMESTAMP '1997-01-01' AND return_date < TIMESTAMP '2000-01-01'),
    shipped AS (
      SELECT l.*, ifnull(returned, 'N/A') AS return_day FROM x_purchase_order_line l LEFT JOIN back USING (return_id, account_id)
      WHERE l.fulfillment_status_id = 2),
    lines AS (
      SELECT s.duns_number, s.account_name, d.external_product_id, h.item_number, d.name AS item_name, s.po_number,
             strftime(s.po_date, '%m/%d/%Y') AS po_date, MAP {{1: 'Open', 2: 'Invoice', 3: 'Pending'}}[s.po_status_id] AS po_status,
             strftime(s.sales_date, '%m/%d/%Y') AS sales_date, h.selling_price, h.return_day AS return_date, h.return_id
      FROM shipped h, sold s, x_com_line_detail d
      WHERE (h.purchase_order_id, h.account_id) = (s.purchase_order_id, s.account_id)
        AND (d.purchase_order_id, d.com_line_number) = (h.purchase_order_id, h.com_line_number))
    SELECT * EXCLUDE (return_id), COUNT(*) AS quantity_shipped, COUNT(return_id) AS quantity_returned FROM lines GROUP BY ALL"""


def _sales(t, account_id=None):
    return sales_and_returns(
        t.account, t.purchase_order, t.purchase_order_line, t.com_line_detail, t.__getattr__("return"),
        dt.date(1997, 1, 1), dt.date(2000, 1, 1), account_id,
    )


query("r6_sales_and_returns", _sales_sql())(lambda t: _sales(t))
query("r6_sales_and_returns_of_one_account", _sales_sql("account_id = 26"))(lambda t: _sales(t, 26))
