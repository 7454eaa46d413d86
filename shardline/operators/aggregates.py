"""Aggregation building blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StructType

from shardline.functions.scalars import EXACT, ratio


def bit_rate(octets: Column, seconds: Column) -> Column:
    return ratio(8 * octets.cast(EXACT), seconds)


def efficiency(octets: Column, resent: Column) -> Column:
    return ratio(100 * (octets.cast(EXACT) - resent.cast(EXACT)), octets)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(ratio(100 * part.cast(EXACT), whole, 6), digits)


def joined_distinct(c: Column | str, sep: str = ", ") -> Column:
    """Distinct values in order, as one text. Meant for values from a small domain."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def joined_by_position(c: str, position: str, sep: str = ", ") -> Column:
    """Values ordered by their position, as one text (an index's column list)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(c).cast("string").alias("v"))))
    return F.array_join(F.transform(pairs, lambda s: s["v"]), sep)


def max_where(condition: Column, value: Column | str) -> Column:
    return F.max(F.when(condition, F.col(value) if isinstance(value, str) else value))


def sum_named(name: str, value: str, *wanted: str) -> Column:
    """Sum of ``value`` over the rows whose ``name`` is one of the wanted."""
    return F.sum(F.when(F.col(name).isin(*wanted), F.col(value)).otherwise(0))


def with_total_row(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], label: str = "Total") -> DataFrame:
    """Report lines per ``keys`` and one last line with the grand totals."""
    grouped = df.rollup(F.struct(*keys).alias("_key")).agg(*[c.alias(n) for n, c in sums.items()])
    total = F.col("_key").isNull()
    first, *rest = keys
    return grouped.select(
        F.when(total, label).otherwise(F.col("_key")[first].cast("string")).alias(first),
        *[F.col("_key")[k].alias(k) for k in rest],
        *sums,
    )


def _cell(df: DataFrame, c: str) -> Column:
    """A value as text that is equal for equal values only."""
    kind, value = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, (FloatType, DoubleType)):
        value = F.when(value == 0, 0.0).otherwise(value)  # one zero
    if isinstance(kind, BinaryType):
        return F.hex(value)
    return F.when(value.isNotNull(), F.to_json(F.struct(value))) if isinstance(kind, (ArrayType, StructType)) else value.cast("string")


def cells(df: DataFrame, columns: Sequence[str], *kept: str) -> DataFrame:
    """(kept columns, column_name, value, length) for every row and column, from one scan.

    Grouped by value right away, so that each task sends a value of a column once, and the repetition by the
    number of columns stays within the task.
    """
    each = [
        F.struct(F.lit(c).alias("column_name"), _cell(df, c).alias("value"), F.length(F.col(f"`{c}`").cast("string")).alias("length"))
        for c in dict.fromkeys(columns)
    ]
    return df.select(*kept, F.inline(F.array(*each)))


def _of_columns(df: DataFrame, columns: Sequence[str], counted: DataFrame) -> DataFrame:
    """A line for each column, those without rows too."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(counted, "column_name", "left")


def distinct_counts(df: DataFrame, columns: Sequence[str], prefix: str = "nd_") -> DataFrame:
    """(column_name, distinct_count) exactly, from one scan of all columns."""
    values = cells(df, columns).groupBy("column_name", "value").agg(F.lit(1).alias("_one"))
    counted = values.groupBy("column_name").agg(F.count("value").alias("_n"))
    return _of_columns(df, columns, counted).select(
        F.concat(F.lit(prefix), "column_name").alias("column_name"), F.coalesce("_n", F.lit(0)).alias("distinct_count")
    )


def column_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows, distinct, nulls, density (1 / distinct) and mean length of each column, from one scan of all of them.

    Exact counts group by value first; approximate ones keep a sketch for each column instead.
    """
    each = cells(df, columns)
    if approximate:
        values, times, distinct = each, F.lit(1), F.approx_count_distinct("value")
    else:
        values = each.groupBy("column_name", "value").agg(F.count("*").alias("_times"), F.min("length").alias("length"))
        times, distinct = F.col("_times"), F.count("value")
    present = F.col("value").isNotNull()
    counted = values.groupBy("column_name").agg(
        F.sum(times).alias("num_rows"),
        distinct.alias("num_distinct"),
        F.coalesce(F.sum(F.when(~present, times)), F.lit(0)).alias("num_nulls"),
        ratio(F.sum(F.when(present, times * F.col("length"))), F.sum(F.when(present, times))).alias("avg_length"),
    )
    density = F.when(F.col("num_distinct") > 0, F.lit(1.0) / F.col("num_distinct"))
    none = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("num_rows", "num_distinct", "num_nulls")}
    return _of_columns(df, columns, counted).withColumns(none).withColumn("density", density)
