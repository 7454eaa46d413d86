"""Account, user, store and shard lookups, and account maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from shardline.functions.predicates import (
    between,
    covers_bits,
    equals_or_any,
    name_contains,
    name_starts,
    optional,
    shares_bits,
)
from shardline.functions.scalars import us_date
from shardline.operators.hierarchy import with_children_flag
from shardline.operators.ordered import latest, page

PENDING = 2
INVALID_MASK = -3
CONTENT_TYPES = ("CP", "ICE", "ECE")


def _account_rows(accounts: DataFrame, vendors: DataFrame, users: DataFrame) -> DataFrame:
    """Accounts with their vendor row and owner users, both optional.

    An account with several owners comes out once per owner.
    """
    vendor = vendors.withColumnRenamed("account_id", "_vendor_account")
    owners = users.where(F.col("is_owner") == 1).select(F.col("account_id").alias("_user_account"), "user_id")
    return (
        accounts.join(vendor, F.col("account_id") == F.col("_vendor_account"), "left")
        .join(owners, F.col("account_id") == F.col("_user_account"), "left")
        .drop("_vendor_account", "_user_account")
    )


def _account_filter(name_test, filters: dict) -> Column:
    get = filters.get
    known = {
        "account_id", "name", "fulfillment_mask", "external_seller_id", "parent_id", "duns", "type_mask", "active"
    }
    if set(filters) - known:
        raise TypeError(f"unknown filters {sorted(set(filters) - known)}")
    return optional(
        (get("account_id"), lambda v: F.col("account_id") == v),
        (get("name"), lambda v: name_test("account_name_upper", v)),
        (get("fulfillment_mask"), lambda v: shares_bits("fulfillment_type_mask", v)),
        (get("external_seller_id"), lambda v: F.col("external_seller_id") == v),
        (get("parent_id"), lambda v: F.col("parent_id") == v),
        (get("duns"), lambda v: F.col("remit_to_duns") == v),
        (get("type_mask"), lambda v: shares_bits("account_type_mask", v)),
        (get("active") if get("active") == 1 else None, lambda v: F.col("account_status") == v),
    )


def find_accounts(
    accounts: DataFrame, vendors: DataFrame, users: DataFrame, start: int | None = None, size: int | None = None, **filters
) -> DataFrame:
    """Accounts that pass the given filters, by name; the name filter is a prefix."""
    rows = _account_rows(accounts, vendors, users).where(_account_filter(name_starts, filters))
    return page(rows, ["account_name", "account_id", "user_id"], start, size)


def count_accounts(accounts: DataFrame, vendors: DataFrame, users: DataFrame, **filters) -> DataFrame:
    """Number of account lines that pass the filters; the name filter is a part of the name."""
    rows = _account_rows(accounts, vendors, users).where(_account_filter(name_contains, filters))
    return rows.agg(F.count("account_id").alias("out_count"))


def user_accounts(
    users: DataFrame,
    accounts: DataFrame,
    vendors: DataFrame | None = None,
    user_id: int | None = None,
    account_id: int | None = None,
) -> DataFrame:
    """Users with their account, by account name.

    With ``vendors`` only active users are listed and the vendor columns are added; without,
    all users are.
    """
    chosen = users.where(equals_or_any("user_id", user_id) & equals_or_any("account_id", account_id))
    if vendors is not None:
        chosen = chosen.where(F.col("account_user_status") == 1)
    rows = chosen.join(accounts, "account_id")
    if vendors is not None:
        rows = rows.join(vendors, "account_id", "left")
    return rows.orderBy("account_name", "account_user_id")


def sellers(accounts: DataFrame, as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Accounts with a DUNS number opened in [start, end]; yesterday to today by default."""
    first = start or as_of - dt.timedelta(days=1)
    chosen = accounts.where(F.col("duns").isNotNull() & between("created_dtm", first, end or as_of))
    return chosen.orderBy("account_name").select(
        F.col("duns").alias("seller_duns_number"),
        F.col("account_name").alias("seller_name"),
        us_date("created_dtm").alias("seller_start_date"),
    )


def account_exists(accounts: DataFrame, name: str) -> DataFrame:
    return accounts.where(F.col("account_name_upper") == name.upper()).select("account_id")


def account_status(accounts: DataFrame, account_id: int) -> DataFrame:
    return accounts.where(F.col("account_id") == account_id).select("account_status")


def account_addresses(links: DataFrame, addresses: DataFrame, account_id: int) -> DataFrame:
    used = links.where((F.col("account_address_status") != 0) & (F.col("account_id") == account_id))
    return used.join(addresses, "address_id").drop("address_id")


def account_stores(
    stores: DataFrame,
    links: DataFrame,
    account_id: int,
    external_store_id: str | None = None,
    store_name: str | None = None,
    account_store_id: int | None = None,
    store_type_id: int | None = None,
) -> DataFrame:
    """Working stores of an account."""
    rows = links.where(F.col("account_id") == account_id).join(stores.where("operational_status = 1"), "store_id")
    return rows.where(
        optional(
            (external_store_id, lambda v: F.col("external_store_id") == v),
            (store_name, lambda v: F.col("store_name") == v),
            (account_store_id, lambda v: F.col("account_store_id") == v),
            (store_type_id, lambda v: F.col("store_type_id") == v),
        )
    )


def all_shards(shards: DataFrame, types: DataFrame) -> DataFrame:
    """Shards of any status with their type name."""
    return shards.join(types, "shard_type_id").select(
        "shard_id", "shard_index", "shard_name", "shard_type_name", "db_port", "db_host", "shard_status"
    )


def active_shards(
    shards: DataFrame, types: DataFrame, type_name: str, vendors: DataFrame | None = None, account_id: int = 0
) -> DataFrame:
    """Active shards whose bits contain those of the named type.

    With ``vendors`` only the shard that holds the account's catalog (the house account by
    default).
    """
    if vendors is not None:
        holder = vendors.where(F.col("account_id") == account_id)
        shards = shards.join(holder.select(F.col("catalog_shard_index").alias("shard_index")), "shard_index", "left_semi")
    bit = types.where(F.upper("shard_type_name") == type_name.upper()).select("shard_type_bit_value").scalar()
    chosen = shards.where((F.col("shard_status") == 1) & covers_bits("shard_type_bit_value", bit))
    return chosen.select("shard_index", "db_host", "db_port")


def store_hierarchy(
    nodes: DataFrame,
    ids: list[int] | None = None,
    parent_id: int | None = None,
    store_id: int | None = None,
    external_path: str | None = None,
) -> DataFrame:
    """Hierarchy nodes with a has_children flag, ordered by the number in the external id."""
    flagged = with_children_flag(nodes, "store_hierarchy_id", "parent_store_hierarchy_id")
    kept = flagged.where(
        (F.col("store_hierarchy_id") != 0)
        & optional(
            (ids, lambda v: F.col("store_hierarchy_id").isin(v)),
            (parent_id, lambda v: F.col("parent_store_hierarchy_id") == v),
            (store_id, lambda v: F.col("store_id") == v),
            (external_path, lambda v: F.col("external_hierarchy_id_path") == v),
        )
    )
    return kept.orderBy(F.col("external_hierarchy_id").try_cast("bigint"), "store_hierarchy_id")


def expired_accounts(accounts: DataFrame, users: DataFrame, as_of: dt.datetime, grace_days: int = 2) -> DataFrame:
    """Pending accounts with an expired pending user and no user in another state."""
    late = F.col("token_expiration_date") + F.make_dt_interval(F.lit(grace_days))
    expired = users.where((F.col("account_user_status") == PENDING) & (F.lit(as_of).cast("timestamp_ntz") > late))
    others = users.where(F.col("account_user_status") != PENDING)
    return (
        accounts.where(F.col("account_status") == PENDING)
        .join(expired.select("account_id").distinct(), "account_id", "left_semi")
        .join(others.select("account_id").distinct(), "account_id", "left_anti")
    )


def purge_expired(
    accounts: DataFrame, users: DataFrame, as_of: dt.datetime, grace_days: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(accounts, users) left after the expired pending accounts and users are gone."""
    gone = expired_accounts(accounts, users, as_of, grace_days).select("account_id")
    late = F.col("token_expiration_date") + F.make_dt_interval(F.lit(grace_days))
    stale = (F.col("account_user_status") == PENDING) & (F.lit(as_of).cast("timestamp_ntz") > late)
    return accounts.join(gone, "account_id", "left_anti"), users.where(~F.coalesce(stale, F.lit(False)))


def edit_accounts(
    accounts: DataFrame, vendors: DataFrame, edits: DataFrame, editor: int, edit_order: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accounts, vendors, rejected edits) after a batch of sparse edits.

    A NULL field keeps the old value. An edit with fulfillment_type_mask <= 0 is rejected. Of
    several good edits of one account that with the greatest ``edit_order`` counts; without such a
    column they end the query with an error.
    """
    bad = F.coalesce(F.col("fulfillment_type_mask"), F.lit(1)) <= 0
    good = _one_edit(edits.where(~bad), edit_order)
    account_fields = ["account_name", "account_email_addr", "account_web_domain", "account_status"]
    vendor_fields = ["fulfillment_type_mask", "vid", "description", "channel_mask", "remit_to_duns"]
    changed = sparse_update(accounts, good, "account_id", account_fields)
    touched = changed.join(good.select("account_id", F.lit(True).alias("_hit")), "account_id", "left")
    stamped = touched.withColumn("modified_id", F.when(F.col("_hit"), F.lit(editor)).otherwise(F.col("modified_id")))
    rejected = edits.where(bad).withColumn("error_code", F.lit(INVALID_MASK))
    return stamped.drop("_hit"), sparse_update(vendors, good, "account_id", vendor_fields), rejected


def _one_edit(edits: DataFrame, order: str | None) -> DataFrame:
    if order:
        return latest(edits, ["account_id"], [F.col(order).desc()])
    whole = F.any_value(F.struct(*edits.columns))
    picked = edits.groupBy("account_id").agg(whole.alias("_edit"), F.count("*").alias("_edits"))
    more = F.raise_error(F.concat(F.lit("several edits of account "), F.col("account_id").cast("string")))
    return picked.select(F.when(F.col("_edits") == 1, F.col("_edit")).otherwise(more).alias("_edit")).select("_edit.*")


def sparse_update(df: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Overwrite the fields an edit row gives a value for; edits hold one row per key."""
    here = [c for c in fields if c in df.columns and c in edits.columns]
    new = edits.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in here])
    joined = df.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in here}).select(*df.columns)


def bulk_status(df: DataFrame, key: str, ids: DataFrame, status: str, value: int, editor: int) -> DataFrame:
    """Set a status on the rows whose key is in ``ids``."""
    hit = ids.select(F.col(key).alias("_id")).distinct()
    joined = df.join(hit, F.col(key) == F.col("_id"), "left")
    found = F.col("_id").isNotNull()
    return joined.withColumns(
        {
            status: F.when(found, F.lit(value)).otherwise(F.col(status)),
            "modified_id": F.when(found, F.lit(editor).cast("long")).otherwise(F.col("modified_id")),
        }
    ).select(*df.columns)


def ingest_accounts(
    requests: DataFrame,
    type_lookup: DataFrame,
    shards: DataFrame,
    shard_types: DataFrame,
    editor: int,
    as_of: dt.datetime,
    key: str = "account_id",
    catalog_type: str = "CATALOG_SHARD",
    order_type: str = "OMS_SHARD",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accounts, vendor accounts, rejected requests) of a batch of new accounts.

    A request is rejected when a mask is not positive, or the type mask is no power of two
    or above the largest known bit. Accounts outside the content types get a vendor row,
    placed on an active catalog shard and an active order shard by hashes of the key. Both kinds of
    rows carry the editor and the time.
    """
    largest = type_lookup.agg(F.max("account_type_bit")).scalar()
    content = type_lookup.where(F.col("account_type_code").isin(*CONTENT_TYPES))
    content_bits = F.coalesce(content.agg(F.bit_or("account_type_bit")).scalar(), F.lit(0))
    mask = F.col("account_type_mask")
    bad = (
        (F.col("fulfillment_type_mask") <= 0)
        | (mask <= 0)
        | (mask.bitwiseAND(mask - 1) != 0)
        | (mask > largest)
    )
    marked = requests.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    good = marked.where(~F.col("_bad")).drop("_bad")
    rejected = marked.where("_bad").drop("_bad").withColumn("error_code", F.lit(INVALID_MASK))
    stamp = {"modified_id": F.lit(editor), "created_dtm": F.lit(as_of).cast("timestamp_ntz")}
    vendors = good.where(mask.bitwiseAND(content_bits) == 0).withColumns({"channel_mask": F.lit(1), **stamp})
    for kind, name in ((catalog_type, "catalog_shard_index"), (order_type, "oms_shard_index")):
        of_type = shards.join(shard_types.where(F.col("shard_type_name") == kind), "shard_type_id", "left_semi")
        vendors = place_on_shard(vendors, of_type, key, name)
    return good.withColumns(stamp), vendors, rejected


def place_on_shard(df: DataFrame, shards: DataFrame, key: str, name: str = "shard_index") -> DataFrame:
    """Spread rows over the active shards by a hash of key and column; the shard list is one array."""
    active = shards.where("shard_status = 1").agg(F.array_sort(F.collect_set("shard_index")).alias("a")).scalar()
    listed = df.withColumn("_shards", active)
    at = F.pmod(F.xxhash64(F.lit(name), key), F.nullif(F.size("_shards"), F.lit(0)).cast("long"))
    return listed.withColumn(name, F.get("_shards", at.cast("int"))).drop("_shards")


def ingest_addresses(requests: DataFrame, editor: int, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(addresses, account addresses) of a batch keyed by ``address_id``, both active."""
    place = ["address_name", "street_1", "city", "postal_code", "state_province", "country", "longitude", "latitude"]
    stamp = [F.lit(editor).alias("modified_id"), F.lit(as_of).cast("timestamp_ntz").alias("created_dtm")]
    link = [c for c in requests.columns if c.startswith("account_address_")]
    addresses = requests.select(
        "address_id", *[c for c in place if c in requests.columns], F.lit(1).alias("address_status"), *stamp
    )
    links = requests.select("account_id", "address_id", *link, F.lit(1).alias("account_address_status"), *stamp)
    return addresses, links


def ingest_contacts(requests: DataFrame, editor: int, as_of: dt.datetime) -> DataFrame:
    """Active contacts stamped with the editor and time."""
    stamp = {"status": F.lit(1), "modified_id": F.lit(editor), "created_dtm": F.lit(as_of).cast("timestamp_ntz")}
    return requests.withColumns(stamp)


def ingest_messages(requests: DataFrame, editor: int, as_of: dt.datetime) -> DataFrame:
    return requests.withColumns(
        {
            "modified_id": F.lit(editor),
            "created_id": F.lit(editor),
            "created_dtm": F.lit(as_of).cast("timestamp_ntz"),
        }
    )
