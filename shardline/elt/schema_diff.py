"""Differences between two catalogs, as rows with the statement that settles each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shardline.operators.aggregates import joined_by_position
from shardline.operators.sets import one_sided

LOCAL, REMOTE = "Local Table", "Remote Table"
# A zero default is not valid here, so it becomes the first day of 2000.
ZERO_TIME, FIRST_TIME = "0000-00-00 00:00:00", "2000-01-01 00:00:00"


def schema_columns(df: DataFrame, schema: str, table: str) -> DataFrame:
    """Column metadata of a DataFrame in the catalog's layout."""
    rows = [
        (schema, table, f.name, f.dataType.simpleString(), "", "YES" if f.nullable else "NO", None, i + 1)
        for i, f in enumerate(df.schema.fields)
    ]
    layout = (
        "table_schema string, table_name string, column_name string, column_type string, column_key string, "
        "is_nullable string, column_default string, ordinal_position int"
    )
    return df.sparkSession.createDataFrame(rows, layout)


def _attributes() -> Column:
    return F.concat(
        F.upper("column_type"),
        F.when(F.col("is_nullable") == "NO", " NOT NULL").otherwise(" NULL"),
        F.coalesce(F.concat(F.lit(" DEFAULT '"), F.col("column_default"), F.lit("'")), F.lit("")),
        F.when(F.col("column_key") == "PRI", " PRIMARY KEY").otherwise(""),
    )


def column_actions(local: DataFrame, remote: DataFrame, target_schema: str) -> DataFrame:
    """ADD and DROP COLUMN actions; a changed type or key gives one of each."""
    def side(df: DataFrame) -> DataFrame:
        plain = F.when(F.col("column_key") == "MUL", "").otherwise(F.col("column_key"))
        return df.withColumn("column_key", plain)

    zero = (F.col("column_type") == "timestamp") & (F.col("column_default") == ZERO_TIME)
    there = side(remote).withColumn("column_default", F.when(zero, FIRST_TIME).otherwise(F.col("column_default")))
    keys = ["table_name", "column_name", "column_type", "column_key"]
    odd = one_sided(side(local), there, keys, ["is_nullable", "column_default", "ordinal_position"], (LOCAL, REMOTE))
    action = F.when(F.col("table_location") == LOCAL, "DROP").otherwise("ADD")
    statement = F.concat(
        F.lit(f"ALTER TABLE {target_schema}."), "table_name", F.lit(" "), "action", F.lit(" COLUMN "),
        "column_name", F.lit(" "), _attributes(),
    )
    return odd.withColumn("action", action).select("action", *keys, "ordinal_position", statement.alias("statement"))


def changed_columns(actions: DataFrame) -> DataFrame:
    """Columns with both an ADD and a DROP: a MODIFY from the old to the new type."""
    both = actions.groupBy("table_name", "column_name").agg(
        F.max(F.when(F.col("action") == "DROP", F.col("column_type"))).alias("old_type"),
        F.max(F.when(F.col("action") == "ADD", F.col("column_type"))).alias("new_type"),
    )
    return both.where("old_type IS NOT NULL AND new_type IS NOT NULL")


def index_columns(statistics: DataFrame) -> DataFrame:
    """(table_name, index_name, uniq, columns): the ordered column list of each index."""
    uniq = F.when(F.col("non_unique") == 0, "UNIQUE").otherwise("")
    chosen = statistics.where(F.col("index_name") != "PRIMARY")
    return chosen.groupBy("table_name", "index_name", uniq.alias("uniq")).agg(
        joined_by_position("column_name", "seq_in_index").alias("columns")
    )


def index_actions(local: DataFrame, remote: DataFrame, target_schema: str, prefix: str = "") -> DataFrame:
    """ADD and DROP INDEX actions for column lists that only one side indexes."""
    keys = ["table_name", "columns"]
    odd = one_sided(index_columns(local), index_columns(remote), keys, ["index_name", "uniq"], (LOCAL, REMOTE))
    drop = F.col("table_location") == LOCAL
    name = F.replace(F.col("index_name"), F.lit(prefix), F.lit("")) if prefix else F.col("index_name")
    mark = F.when(F.col("uniq") != "", F.concat(F.lit(" [ "), "uniq", F.lit(" ]"))).otherwise("")
    head = F.concat(F.lit(f"ALTER TABLE {target_schema}."), "table_name")
    statement = F.when(
        drop, F.concat(head, F.lit(" DROP INDEX "), "index_name", mark, F.lit(" ("), "columns", F.lit(")"))
    ).otherwise(F.concat(head, F.lit(" ADD "), "uniq", F.lit(" INDEX "), name, F.lit(" ("), "columns", F.lit(")")))
    return odd.select(F.when(drop, "DROP").otherwise("ADD").alias("action"), *keys, statement.alias("statement"))


def table_actions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """CREATE for tables only here, DROP for tables only there."""
    keys = ["table_schema", "table_name"]
    odd = one_sided(local.select(*keys).distinct(), remote.select(*keys).distinct(), keys, (), (LOCAL, REMOTE))
    verb = F.when(F.col("table_location") == LOCAL, "CREATE TABLE ").otherwise("DROP TABLE ")
    return odd.select(*keys, F.concat(verb, "table_schema", F.lit("."), "table_name", F.lit("()")).alias("statement"))
