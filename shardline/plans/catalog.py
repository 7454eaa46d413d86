"""Catalog reports over items, content and shards.

Frames of several shards (``sources.shards.all_shards_of``) carry ``shard_index``: the item, ban, publish and create
reports then join rows of one shard only, return the column and number their lines within a shard.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shardline.functions.predicates import ALLOCATION, CATALOG_STATUS, OWNER, code_label, last_days, on_day
from shardline.functions.scalars import (
    blank_if_null,
    excel_quote,
    later_of,
    packed_value,
    path_element,
    path_top,
)
from shardline.operators.aggregates import joined_distinct, max_where
from shardline.operators.masks import join_covering
from shardline.operators.ordered import with_first_before, with_line_number, with_rank_in_group
from shardline.operators.sets import union_all

SELLER_STATUS_LOOKUP = 19
CATALOG_STATUS_LOOKUP = 18
ENRICHMENT_LOOKUP = 20
SAVED = 1
HOUSE_ACCOUNT = 0
HOUSE_NAME = "SHC"


@dataclass(frozen=True)
class Catalog:
    """Tables of the item reports; a report uses the ones it needs."""

    items: DataFrame
    content_items: DataFrame
    accounts: DataFrame | None = None
    item_classes: DataFrame | None = None
    item_log: DataFrame | None = None
    relations: DataFrame | None = None
    relation_details: DataFrame | None = None
    relation_types: DataFrame | None = None
    lookups: DataFrame | None = None
    vendor_packages: DataFrame | None = None
    item_sites: DataFrame | None = None
    sites: DataFrame | None = None
    hierarchy: DataFrame | None = None


SHARD = "shard_index"


def _shard(*frames: DataFrame) -> list[str]:
    """The shard column if all frames have it."""
    return [SHARD] if all(SHARD in df.columns for df in frames) else []


def _join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key, and within a shard if both sides tell theirs."""
    return left.join(right, [*_shard(left, right), key], how)


def _numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    by = _shard(lines)
    return with_rank_in_group(lines, by, order, "line_num") if by else with_line_number(lines, order)


def lookup_of(lookups: DataFrame, kind: int, value: str, label: str) -> DataFrame:
    """(value, label) of one lookup type."""
    return lookups.where(F.col("lookup_type_id") == kind).select(
        F.col("lookup_value").alias(value), F.col("lookup_description").alias(label)
    )


def _of_relations(chosen: DataFrame, details: DataFrame, relations: DataFrame) -> DataFrame:
    """The chosen items and all that share a relation with one of them: what a report of the chosen ones looks at."""
    members = details.select(*_shard(details), "item_id", "item_relation_id").unionByName(
        relations.select(*_shard(relations), F.col("base_item_id").alias("item_id"), "item_relation_id")
    )
    touched = _join(members, chosen, "item_id", "left_semi").drop("item_id")
    beside = _join(members, touched, "item_relation_id", "left_semi").drop("item_relation_id")
    return chosen.unionByName(beside.select(*chosen.columns))  # for a semi join, so repeats do no harm


def related_items(
    items: DataFrame, details: DataFrame, relations: DataFrame, chosen: DataFrame | None = None
) -> DataFrame:
    """Items with their relation, its status, and the parent's pid, websku, item and mask.

    Children take the values of the dummy parent; the first row of a relation has none, and
    items outside any relation stand for themselves. With ``chosen`` (item_id, and the shard) only these items are right
    and the rest of their relations is there to carry from; all others are left out before anything is joined.
    """
    if chosen is not None:
        items = _join(items, _of_relations(chosen, details, relations), "item_id", "left_semi")
    by_detail = details.select(
        *_shard(details), "item_id", F.col("item_relation_id").alias("_d_rel"), F.col("status").alias("_d_status")
    )
    by_base = relations.select(
        *_shard(relations),
        F.col("base_item_id").alias("item_id"),
        "base_item_id",
        F.col("item_relation_id").alias("_b_rel"),
        F.col("status").alias("_b_status"),
    )
    rows = _join(_join(items, by_detail, "item_id", "left"), by_base, "item_id", "left")
    dummy = F.col("dummy_item_flag") == 1
    off = F.coalesce(F.col("_d_status") == 0, F.lit(False))
    single = F.coalesce(F.col("relation_type_mask") == 1, F.lit(False))
    status = F.coalesce(F.when(dummy & off, F.col("_b_status")).otherwise(F.col("_d_status")), F.col("_b_status"))
    rows = rows.withColumns(
        {
            "base_pid": F.when(dummy, F.col("pid")),
            "base_websku": F.when(dummy, F.col("websku")),
            "item_relation_id": F.when(~(single & off), F.coalesce("_d_rel", "_b_rel")),
            "_rel_status": status,
        }
    )
    relation = F.struct(*_shard(rows), "item_relation_id")  # relations of two shards may share an id
    rows = rows.withColumn("_relation", F.when(F.col("item_relation_id").isNotNull(), relation))
    carried = with_first_before(
        rows,
        "_relation",
        [F.coalesce(-F.col("dummy_item_flag"), F.lit(1)), F.col("item_id")],
        {
            "base_pid": "base1_pid",
            "base_websku": "base1_websku",
            "base_item_id": "_carried_item",
            "relation_type_mask": "_carried_mask",
        },
    )
    grouped = F.col("item_relation_id").isNotNull()
    child = grouped & (F.col("relation_type_mask") > 1)
    own = ~F.col("_is_first")
    return carried.withColumns(
        {
            "base_of_item": F.when(own, F.when(child, F.col("_carried_item")).otherwise(F.col("item_id"))),
            "base_mask": F.when(own, F.when(child, F.col("_carried_mask")).otherwise(F.col("relation_type_mask"))),
            "item_relation_status": F.when(F.col("relation_type_mask") > 1, F.col("_rel_status")).otherwise(
                F.col("seller_item_status")
            ),
            "dummy_item_flag": F.coalesce("dummy_item_flag", F.lit(0)),
        }
    ).drop("_carried_item", "_carried_mask", "_relation", "_d_rel", "_d_status", "_b_rel", "_b_status", "_rel_status")


def logged_items(item_log: DataFrame, day: dt.date, statuses: tuple[int, ...]) -> DataFrame:
    """Items logged on a day in one of the given states."""
    return item_log.where(on_day("log_created_dtm", day) & F.col("catalog_status").isin(*statuses)).select(*_shard(item_log), "item_id")


def _described(rows: DataFrame, c: Catalog, seller: Column | None = None, status: Column | None = None) -> DataFrame:
    """Join content, class and the two status lookups (inner)."""
    sellers = lookup_of(c.lookups, SELLER_STATUS_LOOKUP, "seller_item_status", "seller_status_text")
    states = lookup_of(c.lookups, CATALOG_STATUS_LOOKUP, "catalog_status", "catalog_status_text")
    own = _shard(c.content_items)
    content = c.content_items.select(*own, "content_item_id", "upc", F.col("name").alias("item_title"))
    named = (
        rows.join(sellers if seller is None else sellers.where(seller), "seller_item_status")
        .join(states if status is None else states.where(status), "catalog_status")
        .join(c.item_classes.select("content_item_class_id", "content_item_class_display_path"), "content_item_class_id")
    )
    return _join(named, content, "content_item_id")


def _masks(c: Catalog) -> DataFrame:
    return c.items.select(F.col("relation_type_mask").alias("base_mask"))


def _item_columns() -> list[Column]:
    path = "content_item_class_display_path"
    return [
        blank_if_null("websku").alias("websku"),
        blank_if_null(excel_quote("pid")).alias("pid"),
        blank_if_null("item_relation_type_name").alias("item_type"),
        blank_if_null("base1_pid").alias("dummy_pid"),
        blank_if_null("base1_websku").alias("dummy_websku"),
        blank_if_null(excel_quote("upc")).alias("upc"),
        blank_if_null("item_title").alias("item_title"),
        blank_if_null(path).alias(path),
        F.coalesce(path_top(path), F.lit("")).alias("content_item_class_top"),
        blank_if_null("seller_status_text").alias("seller_item_status"),
        blank_if_null("catalog_status_text").alias("catalog_status"),
        "created_dtm",
        "modified_dtm",
    ]


def publish_report(c: Catalog, day: dt.date) -> DataFrame:
    """Numbered lines of seller items saved on the day, active and published now."""
    saved = logged_items(c.item_log, day, (SAVED,)).distinct()
    rows = related_items(c.items, c.relation_details, c.relations, saved)
    rows = rows.where((F.col("account_id") != HOUSE_ACCOUNT) & (F.col("item_relation_status") != 0))
    rows = _join(rows, saved, "item_id", "left_semi")
    rows = _described(rows, c, F.col("seller_item_status") == 1, F.col("catalog_status") == 2)
    rows = join_covering(rows, "base_mask", c.relation_types, "bit_value", _masks(c))
    named = rows.join(c.accounts.select("account_id", "account_name"), "account_id")
    lines = named.select(
        *_shard(named), blank_if_null(excel_quote("account_name")).alias("account_name"), "item_id", *_item_columns()
    ).distinct()
    return _numbered(lines, ["account_name", "item_id", "websku", "item_type"])


def create_report(c: Catalog, day: dt.date) -> DataFrame:
    """Numbered lines of seller items created on the day, per site and all that a line shows.

    An item of several relation kinds has a line for each.
    """
    created = c.items.where((F.col("account_id") != HOUSE_ACCOUNT) & on_day("created_dtm", day))
    rows = related_items(c.items, c.relation_details, c.relations, created.select(*_shard(created), "item_id"))
    rows = rows.where(
        (F.col("account_id") != HOUSE_ACCOUNT)
        & (F.col("dummy_item_flag") != 1)
        & (F.col("item_relation_status") != 0)
        & on_day("created_dtm", day)
    )
    rows = join_covering(_described(rows, c), "base_mask", c.relation_types, "bit_value", _masks(c))
    at = c.item_sites.where("status = 1")
    at = at.select(*_shard(at), F.col("item_id").alias("base_of_item"), "site_id")
    rows = _join(rows, at, "base_of_item").join(c.sites.select("site_id", "site_name"), "site_id")
    packages = c.vendor_packages.where("status = 1")
    packages = packages.select(*_shard(packages), "item_id", "store_id", "order_duns_number")
    named = _join(rows, packages, "item_id", "left").join(c.accounts.select("account_id", "account_name"), "account_id")
    lines = named.groupBy(
        *_shard(named),
        blank_if_null(excel_quote("account_name")).alias("account_name"),
        blank_if_null("site_name").alias("site_name"),
        "item_id",
        "site_id",
        *_item_columns(),
    ).agg(site_order_number().alias("order_duns_number"))
    return _numbered(lines.drop("site_id"), ["account_name", "site_name", "item_id", "item_type"])


def site_order_number() -> Column:
    """Order number of the site's own store; site 3 uses store 1 and higher sites store 2."""
    site, store = F.col("site_id"), F.col("store_id")
    match = (site == store) | ((site == 3) & (store == 1)) | ((site > 3) & (store == 2))
    return max_where(match, "order_duns_number")


def house_create_report(c: Catalog, day: dt.date, house: str = HOUSE_NAME) -> DataFrame:
    """Items of the house account created on the day."""
    items = c.items.where(
        (F.col("account_id") == HOUSE_ACCOUNT)
        & (F.col("account_type") == 1)
        & (F.col("fulfillment_type") == 3)
        & on_day("created_dtm", day)
    )
    content = c.content_items.where("status = 1").select(
        *_shard(c.content_items), "content_item_id", "upc", F.col("name").alias("item_title"), "enrichment_status"
    )
    sites = c.item_sites.where("status = 1").select(*_shard(c.item_sites), "item_id", "site_id")
    shipped = c.vendor_packages.where("status = 1").select(*_shard(c.vendor_packages), "item_id").distinct()
    tree = c.hierarchy.where("status = 1 AND store_id = 1").select(
        F.col("store_hierarchy_id").alias("shc_hierarchy_id"), "store_hierarchy_display_path"
    )
    path = "store_hierarchy_display_path"
    stocked = _join(_join(items, content, "content_item_id"), shipped, "item_id", "left_semi")
    rows = (
        _join(stocked, sites, "item_id", "left")
        .join(lookup_of(c.lookups, SELLER_STATUS_LOOKUP, "seller_item_status", "_seller"), "seller_item_status", "left")
        .join(lookup_of(c.lookups, CATALOG_STATUS_LOOKUP, "catalog_status", "_state"), "catalog_status", "left")
        .join(lookup_of(c.lookups, ENRICHMENT_LOOKUP, "enrichment_status", "_enrich"), "enrichment_status", "left")
        .join(tree, "shc_hierarchy_id", "left")
    )
    return rows.select(
        "site_id",
        *_shard(rows),
        F.lit(house).alias("account_name"),
        "item_id",
        blank_if_null(excel_quote("upc")).alias("upc"),
        blank_if_null("item_title").alias("item_title"),
        blank_if_null(path).alias("hierarchy"),
        blank_if_null(path_element(path, 1)).alias("division_name"),
        blank_if_null("shc_division_nbr").alias("division_nbr"),
        blank_if_null("_seller").alias("seller_item_status"),
        blank_if_null("_state").alias("catalog_status"),
        blank_if_null("_enrich").alias("enrichment_status"),
        "created_dtm",
        "modified_dtm",
    ).distinct().drop("site_id")


def house_publish_report(c: Catalog, day: dt.date, house: str = HOUSE_NAME) -> DataFrame:
    """Published items of the house account that were saved, new or excluded on the day."""
    logged = logged_items(c.item_log, day, (1, 4, 5)).distinct()
    rows = related_items(c.items, c.relation_details, c.relations, logged).where(
        (F.col("account_id") == HOUSE_ACCOUNT)
        & (F.col("account_type") == 1)
        & (F.col("fulfillment_type") == 3)
        & (F.col("catalog_status") == 2)
        & (F.col("item_relation_status") != 0)
    )
    rows = _join(rows, logged, "item_id", "left_semi")
    enriched = c.content_items.where("status = 1").select(*_shard(c.content_items), "content_item_id", "enrichment_status")
    tree = c.hierarchy.where("status = 1 AND store_id = 1").select(
        F.col("store_hierarchy_id").alias("shc_hierarchy_id"), "store_hierarchy_display_path"
    )
    rows = _described(rows, c, F.col("seller_item_status") == 1, F.col("catalog_status") == 2)
    rows = _join(rows, enriched, "content_item_id").join(tree, "shc_hierarchy_id")
    rows = join_covering(rows, "base_mask", c.relation_types, "bit_value", _masks(c))
    path = "store_hierarchy_display_path"
    return rows.select(
        *_shard(rows),
        F.lit(house).alias("account_name"),
        "item_id",
        *_item_columns(),
        blank_if_null(path).alias("hierarchy"),
        blank_if_null(path_element(path, 1)).alias("division_name"),
        blank_if_null("shc_division_nbr").alias("division_nbr"),
        blank_if_null(code_label("enrichment_status", {2: "Enriched", 1: "Needs Enrichment"})).alias("enrichment_status"),
    ).distinct()


def ban_reasons(rules: DataFrame, item_rules: DataFrame, sticky: DataFrame) -> DataFrame:
    """(item_id, ban_rule_name): the item's distinct ban reasons in order, as one text."""
    key = [*_shard(item_rules, sticky), "item_id"]
    by_rule = item_rules.where("status = 1").join(rules, "ban_rule_id").select(*key, "ban_rule_name")
    by_item = sticky.where("sticky_ban_state = 1").select(*key, F.lit("Item level ban").alias("ban_rule_name"))
    reasons = union_all([by_rule, by_item])  # the set below drops repeats
    return reasons.groupBy(*key).agg(joined_distinct("ban_rule_name").alias("ban_rule_name"))


def banned_items(c: Catalog, rules: DataFrame, item_rules: DataFrame, sticky: DataFrame, house: bool) -> DataFrame:
    """Active banned items of the sellers, or of the house account."""
    tree = c.hierarchy.where("status = 1").select(
        F.col("store_hierarchy_id").alias("shc_hierarchy_id"), "store_hierarchy_display_path"
    )
    items = c.items.where("seller_item_status = 1")
    if house:
        named = items.where(F.col("account_id") == HOUSE_ACCOUNT).withColumn("account_name", F.lit(HOUSE_NAME))
    else:
        sellers = c.accounts.where(F.col("account_id") != HOUSE_ACCOUNT)
        named = items.join(sellers.select("account_id", excel_quote("account_name").alias("account_name")), "account_id")
    content = c.content_items.select(*_shard(c.content_items), "content_item_id", "upc", "enrichment_status")
    rows = _join(_join(named, ban_reasons(rules, item_rules, sticky), "item_id"), content, "content_item_id")
    rows = rows.join(tree, "shc_hierarchy_id", "left")
    return rows.select(
        *_shard(rows),
        "account_name",
        blank_if_null(path_element("store_hierarchy_display_path", 1)).alias("shc_div_name"),
        blank_if_null("shc_division_nbr").alias("shc_division_nbr"),
        "item_id",
        blank_if_null(excel_quote("pid")).alias("pid"),
        blank_if_null(excel_quote("websku")).alias("websku"),
        blank_if_null(excel_quote("upc")).alias("upc"),
        excel_quote("ban_rule_name").alias("ban_description"),
        code_label("catalog_status", CATALOG_STATUS).alias("catalog_status"),
        F.when(F.col("enrichment_status") == 2, "Enriched").otherwise("Needs Enrichment").alias("enrichment_status"),
        F.col("created_dtm").alias("item_created_dtm"),
        F.col("modified_dtm").alias("item_modified_dtm"),
    ).distinct()


def over_threshold(df: DataFrame, value: str, profiles: DataFrame, values: DataFrame, term: str, profile: str) -> DataFrame:
    """Rows whose ``value`` in days exceeds the threshold kept (in seconds) in a profile."""
    owner = profiles.where(F.col("profile_name") == profile).select("profile_id")
    setting = values.where(F.col("profile_term_type") == term).join(owner, "profile_id", "left_semi")
    return df.where(F.col(value) > (setting.select("profile_term_value").scalar() / 86400))


def pending_items(c: Catalog, profiles: DataFrame, values: DataFrame, as_of: dt.date) -> DataFrame:
    """Seller packages waiting for the exchange longer than the threshold."""
    packages = c.vendor_packages.where("status = 1 AND ima_exchange_status = 2").select(
        "item_id", "item_vendor_package_id", "store_id", later_of("ima_timestamp", "modified_dtm").alias("_latest")
    )
    aged = packages.withColumn("number_of_days_in_ima_pending", F.date_diff(F.lit(as_of), F.to_date("_latest")))
    late = over_threshold(
        aged, "number_of_days_in_ima_pending", profiles, values, "IMA_PENDING_THRESHOLD", "INTERNAL_SETTINGS"
    )
    items = c.items.where((F.col("account_id") != HOUSE_ACCOUNT) & (F.col("seller_item_status") == 1)).select(
        "item_id", "account_id", "content_item_id", "content_item_class_id"
    )
    return (
        late.join(items, "item_id")
        .join(c.content_items.where("status = 1").select("content_item_id", "upc"), "content_item_id")
        .join(c.sites.select(F.col("site_id").alias("store_id"), "site_name"), "store_id")
        .join(c.item_classes.select("content_item_class_id", "content_item_class_display_path"), "content_item_class_id")
        .join(c.accounts.select("account_id", excel_quote("account_name").alias("account_name")), "account_id")
        .select(
            "account_name",
            "account_id",
            "content_item_class_display_path",
            "upc",
            "item_vendor_package_id",
            "site_name",
            "number_of_days_in_ima_pending",
        )
    )


@dataclass(frozen=True)
class OuterContent:
    """Tables of the outside product feed."""

    items: DataFrame
    attribute_values: DataFrame
    attributes: DataFrame
    values: DataFrame
    accounts: DataFrame
    mapping: DataFrame


def shop_report(o: OuterContent, c: Catalog, brands: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Feed items changed in the last days with their quality score and catalog match."""
    scored = (
        o.attribute_values.where("status = 1")
        .join(
            o.attributes.where("attribute_name = 'Shop Data Quality Score' AND status = 1").select("external_attribute_id"),
            "external_attribute_id",
        )
        .join(o.values.where("status = 1").select("external_value_id", "value_name"), "external_value_id")
        .select("external_item_id", "value_name")
    )
    feed = o.items.where((F.col("status") == 1) & last_days("modified_dtm", as_of, days)).join(
        o.accounts.where("account_name = 'Shop' AND status = 1").select("external_account_id"), "external_account_id"
    )
    content = c.content_items.select(
        "content_item_id", "brand_id", "manufacturer_model_num", "enrichment_status",
        F.col("upc").alias("content_upc"), F.col("name").alias("product_title"),
    )
    items = c.items.withColumnsRenamed(
        {"modified_dtm": "_item_modified", "created_dtm": "_item_created", "modified_id": "_item_editor"}
    )
    first_store = c.hierarchy.where("store_id = 1").select(
        F.col("store_hierarchy_id").alias("shc_hierarchy_id"), F.col("store_hierarchy_display_path").alias("_path1")
    )
    second_store = c.hierarchy.where("store_id = 2").select(
        F.col("store_hierarchy_id").alias("core_hierarchy_id"), F.col("store_hierarchy_display_path").alias("_path2")
    )
    rows = (
        feed.join(scored, "external_item_id")
        .join(o.mapping.select("external_item_id", "content_item_id"), "external_item_id", "left")
        .join(content, "content_item_id", "left")
        .join(items, "content_item_id", "left")
        .join(c.item_classes.select("content_item_class_id", "content_item_class_display_path"), "content_item_class_id", "left")
        .join(c.vendor_packages.select("item_id", "vendor_stk_number"), "item_id", "left")
        .join(first_store, "shc_hierarchy_id", "left")
        .join(second_store, "core_hierarchy_id", "left")
        .join(brands.select("brand_id", "brand_name"), "brand_id", "left")
    )
    packed = "ima_attribute_values"
    return rows.select(
        "external_item_id",
        excel_quote("product_id").alias("product_id"),
        excel_quote("upc").alias("upc"),
        "title",
        excel_quote("manufacturer_part_number").alias("manufacturer_part_number"),
        "manufacturer_name",
        "lastdeliverydate",
        "modified_dtm",
        "created_dtm",
        F.col("value_name").alias("quality_score"),
        "item_id",
        F.col("content_item_class_display_path").alias("item_class"),
        F.col("_item_editor").alias("merchant"),
        F.col("ksn_id").alias("ksn"),
        excel_quote("pid").alias("pid"),
        excel_quote("websku").alias("websku"),
        "ima_item_id",
        "core_item_number",
        packed_value(packed, "mfgname").alias("ima_manufacturer"),
        F.coalesce(code_label("allocation_mask", ALLOCATION), F.lit("")).alias("online_allocation"),
        F.coalesce(code_label("owner_code", OWNER), F.lit("")).alias("site"),
        path_element("_path1", 1).alias("site1_division"),
        path_element("_path1", 3).alias("site1_category"),
        path_element("_path1", -1).alias("site1_subcategory"),
        path_element("_path2", 1).alias("site2_vertical"),
        path_element("_path2", 2).alias("site2_subline"),
        path_element("_path2", 3).alias("site2_variable"),
        packed_value(packed, "brand").alias("ima_brand"),
        F.col("brand_name").alias("brand"),
        "vendor_stk_number",
        excel_quote("manufacturer_model_num").alias("model_number"),
        excel_quote("content_upc").alias("content_upc"),
        code_label("catalog_status", CATALOG_STATUS).alias("offer_status"),
        F.when(F.col("enrichment_status") == 2, "Enriched").otherwise("Need Enrichment").alias("content_status"),
        packed_value(packed, "title", anchored=False).alias("ima_title"),
        "product_title",
        F.when(F.col("item_id").isNotNull(), "Yes").otherwise("No").alias("ab_match"),
    )
