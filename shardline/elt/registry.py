"""Source catalog: register, validate and choose the load mode of source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardline.functions.scalars import table_alias
from shardline.operators.aggregates import max_where

# Column names and comments the rules look for and leave.
CHANGE_COLUMNS = ("modified_dtm", "last_mod_time", "log_created_dtm", "log_modified_dtm")
NO_TABLE = "The table <table_name> has been removed from the schema"
NO_PK = "There is no PK on Master table"
NO_DTM = "There is no column for data processing"
NO_FK = "There is no FK to Master table"
MASTER_DTM = {"db1": ("modified_dtm",), "db2": ("modified_dtm", "last_mod_time")}
LOG_DTM = {"db1": ("log_modified_dtm",), "db2": ("log_created_dtm",)}
SHARDING = {"db1": ("dummy_account_id",), "db2": ("account_id", "owner_account_id")}
WHOLE_TABLE, NO_BLOCKS, MASTER_BLOCK, LOG_BLOCK = -1, 0, 100_000, 1_000_000


def _is_log(name: str = "table_name") -> Column:
    return F.col(name).endswith("_log")


def register_sources(columns: DataFrame, shards: DataFrame, host: str, name_filter: Column) -> DataFrame:
    """One row per table of the host's catalog that passes the filter, and active shard."""
    log = _is_log()
    name, key = F.col("column_name"), F.col("column_key")
    pk = F.when(log, F.replace(name, F.lit("_log"), F.lit(""))).otherwise(name)
    change = name.isin(*CHANGE_COLUMNS) & (~log | name.startswith("log_"))
    tables = (
        columns.where(name_filter)
        .groupBy("table_schema", "table_name")
        .agg(
            F.min(F.when(key == "PRI", F.struct("ordinal_position", name.alias("n"), pk.alias("pk"))))["pk"].alias("pk_column"),
            max_where(F.col("ordinal_position") == 1, name).alias("first_column"),
            max_where(name.isin(*SHARDING[host]) & (key != "PRI"), name).alias("sharding_column_name"),
            max_where(change, name).alias("dtm_column_name"),
        )
    )
    block = (
        F.when(F.col("dtm_column_name").isNull(), WHOLE_TABLE)
        .when(F.col("pk_column").isNull(), NO_BLOCKS)
        .when(log, LOG_BLOCK)
        .otherwise(NO_BLOCKS if host == "db1" else MASTER_BLOCK)
    )
    active = shards.where((F.col("host_alias") == host) & (F.col("status") == 1))
    listed = active.agg(F.collect_list(F.struct("shard_profile_id", "shard_number")).alias("a")).scalar()
    described = tables.select(
        F.col("table_schema").alias("src_schema_name"),
        F.col("table_name").alias("src_table_name"),
        table_alias("table_name").alias("src_table_alias"),
        F.when(F.col("table_name").contains("_log"), "LOG").otherwise("MASTER").alias("src_table_type"),
        F.lit(1).alias("src_table_load_status"),
        F.lit(0).alias("src_table_valid_status"),
        "dtm_column_name",
        "sharding_column_name",
        F.coalesce("pk_column", "first_column").alias("proc_pk_column_name"),
        block.alias("proc_block_size"),
        F.lit(host).alias("host_alias"),
    )
    return described.withColumn("_shards", listed).select(
        *described.columns, F.inline("_shards").alias("shard_profile_id", "shard_number")
    )


def validate_sources(sources: DataFrame, columns: DataFrame, host: str) -> DataFrame:
    """Sources with src_table_valid_status (the table exists) and the flaws in ``comments``."""
    name = F.col("column_name")
    facts = columns.groupBy("table_schema", "table_name").agg(
        F.max(F.lower(name).isin(*MASTER_DTM[host])).alias("_master_dtm"),
        F.max(F.lower(name).isin(*LOG_DTM[host])).alias("_log_dtm"),
        F.max(F.col("column_key") == "PRI").alias("_pk"),
    )
    master = columns.where("column_key = 'PRI'").select("table_schema", F.col("table_name").alias("_master"), "column_name")
    links = (
        columns.select(
            "table_schema", "table_name", F.replace("table_name", F.lit("_log"), F.lit("")).alias("_master"), "column_name"
        )
        .join(master, ["table_schema", "_master", "column_name"], "left_semi")
        .select("table_schema", "table_name", F.lit(True).alias("_fk"))
        .distinct()
    )
    known = facts.join(links, ["table_schema", "table_name"], "left")
    joined = sources.drop("src_table_valid_status").join(
        known,
        (F.col("src_schema_name") == F.col("table_schema")) & (F.col("src_table_name") == F.col("table_name")),
        "left",
    )
    exists = F.col("table_name").isNotNull()
    log = F.col("src_table_type") == "LOG"
    dtm = F.when(log, F.col("_log_dtm")).otherwise(F.col("_master_dtm"))
    reasons = F.concat_ws(
        "; ",
        F.when(~dtm, NO_DTM),
        F.when(~log & ~F.col("_pk"), NO_PK),
        F.when(log & F.col("_fk").isNull(), NO_FK),
    )
    gone = F.replace(F.lit(NO_TABLE), F.lit("<table_name>"), F.col("src_table_name"))
    comments = F.when(~exists, gone).when(reasons != "", reasons)
    return joined.select(
        *[c for c in sources.columns if c != "src_table_valid_status"],
        F.when(exists, 1).otherwise(0).alias("src_table_valid_status"),
        comments.alias("comments"),
    )


def choose_load_mode(sources: DataFrame) -> DataFrame:
    """Make the fixable sources valid: no key loads in one go, no change column copies all."""
    whole = F.col("dtm_column_name").isNull()
    no_pk = F.coalesce(F.col("comments").contains(NO_PK), F.lit(False))
    size = F.when(whole, WHOLE_TABLE).when(no_pk, NO_BLOCKS).otherwise(F.col("proc_block_size"))
    valid = F.when(whole | no_pk, 1).otherwise(F.col("src_table_valid_status"))
    return sources.withColumns({"proc_block_size": size, "src_table_valid_status": valid})
