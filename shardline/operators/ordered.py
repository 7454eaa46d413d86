"""Order-dependent operators that stay spread out when one key holds most rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DatetimeType, NumericType, StringType

from shardline.session import cut_lineage

SPANS = 32
#: Rows that a range of ordered rows holds about.
SPAN_ROWS = 1_000_000


def _scale(df: DataFrame, name: str) -> Column | None:
    """A number or time that rises with the column; text counts by its first seven bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, (NumericType, DatetimeType)):
        return F.col(name)
    if isinstance(kind, StringType):
        digits = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 7)), 14, "0")
        return F.conv(digits, 16, 10).cast("bigint")
    return None


def with_span(df: DataFrame, order: Sequence[str], spans: int = SPANS, name: str = "_span") -> DataFrame:
    """Number each row by the quantile interval its order values fall in, rising with the order.

    The bounds come from one pass of mergeable sketches over the order columns, so a
    (key, span) group holds about 1/spans of the table at most, however skewed the keys and
    the first column are: a value so frequent that it fills whole intervals is cut further by
    the second column, when that is a number or a time.
    """
    points = [i / spans for i in range(1, spans)]
    first, *rest = order
    scale = _scale(df, first)
    if scale is None:
        raise TypeError(f"cannot spread rows by {first}: {df.schema[first].dataType.simpleString()}")
    df, lead = df.withColumn("_lead", scale), "_lead"
    second = rest[0] if rest and isinstance(df.schema[rest[0]].dataType, (NumericType, DatetimeType)) else lead
    sketches = df.agg(*[F.percentile_approx(c, points, 1000).alias(b) for b, c in (("_b0", lead), ("_b1", second))])
    repeated = F.filter("_b0", lambda x, i: (i > 0) & (x == F.element_at("_b0", F.greatest(i, F.lit(1)))))
    bounds = sketches.select(F.struct("_b0", "_b1", repeated.alias("_frequent")).alias("_bounds")).scalar()
    edges = F.col("_bounds")
    span = F.expr(" + ".join(f"coalesce(cast(_bounds._b0[{i}] < `{lead}` AS int), 0)" for i in range(spans - 1)))
    if second != lead:
        cut = 1 + F.size(F.filter(edges["_b1"], lambda x: x < F.col(second)))
        frequent = F.array_contains(edges["_frequent"], F.col(lead))
        span = span * (spans + 1) + F.when(frequent, cut).otherwise(0)
    return df.withColumn("_bounds", bounds).withColumn(name, span).drop("_bounds", "_lead")


def in_ranges(df: DataFrame, order: Sequence[str], spans: int | None = None, rows_a_span: int = SPAN_ROWS) -> DataFrame:
    """The rows, written once in ranges of ``order`` of about ``rows_a_span`` rows (or ``spans`` ranges).

    ``_span`` numbers the ranges and ``_slot`` the rows, both rising with the order.
    """
    spans = spans or max(1, math.ceil(df.count() / rows_a_span))
    ranged = df.repartitionByRange(spans, *order).sortWithinPartitions(*order)
    base = cut_lineage(ranged.withColumn("_slot", F.monotonically_increasing_id()), "ranges")
    return base.withColumn("_span", F.shiftright("_slot", 33))


def with_sum_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, rows_a_span: int = SPAN_ROWS
) -> DataFrame:
    """Add the sum of ``value`` over the rows before within ``keys``, for groups of any size; 0 for the first.

    Sums run over all rows, by ranges: within each, and over the ranges before it (one row a range). What had been
    summed up at the first row of a group is taken off again. ``order`` should tell the rows of a group apart.
    """
    base = in_ranges(df, [*keys, *order], None, rows_a_span)
    whole = Window.unboundedPreceding
    inside = F.sum(value).over(Window.partitionBy("_span").orderBy("_slot").rowsBetween(whole, -1))
    rows = base.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    totals = base.groupBy("_span").agg(F.sum(value).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_span").rowsBetween(whole, -1))  # one row a range
    shifts = totals.select("_span", F.coalesce(before, F.lit(0)).alias("_shift"))
    summed = rows.join(shifts, "_span").withColumn("_sum", F.col("_inside") + F.col("_shift"))
    firsts = summed.groupBy(*keys).agg(F.min_by("_sum", "_slot").alias("_first"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = summed.alias("s").join(firsts.alias("f"), same)
    return joined.select(*[F.col(f"s.{c}") for c in df.columns], (F.col("s._sum") - F.col("f._first")).alias(name))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    spans: int | None = None,
    rows_a_span: int = SPAN_ROWS,
) -> DataFrame:
    """Add the previous row's values within ``keys``: {source column: new column}.

    The rows are dealt out in ranges of (keys, order), of any types that can be sorted: about ``rows_a_span`` rows each, or
    ``spans`` ranges. A hot key thus covers as many ranges as its rows fill. They are written once; ``lag`` runs within a
    range, and its first row looks at the last row of the range before, of which there is one a range. Only rows
    equal in all of ``keys`` and ``order`` stay together. ``_has_previous`` tells a missing row from a NULL value.
    """
    base = in_ranges(df, [*keys, *order], spans, rows_a_span)
    kept = F.struct(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    owner = F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    seen = F.struct(owner.alias("owner"), kept.alias("kept"))
    rows = base.withColumn("_lag", F.lag(seen).over(Window.partitionBy("_span").orderBy("_slot")))
    last = base.groupBy("_span").agg(F.max_by(seen, "_slot").alias("_last"))
    carried = last.select("_span", F.lag("_last").over(Window.orderBy("_span")).alias("_carry"))  # one row a range
    joined = rows.join(carried, "_span").withColumn("_previous", F.coalesce("_lag", "_carry"))
    same = F.col("_previous.owner").eqNullSafe(owner)
    return joined.withColumn("_has_previous", F.col("_previous").isNotNull() & same).select(
        *df.columns,
        *[F.when(F.col("_has_previous"), F.col(f"_previous.kept._v{i}")).alias(new) for i, new in enumerate(columns.values())],
        "_has_previous",
    )


def with_line_number(df: DataFrame, order: Sequence[Column | str], name: str = "line_num") -> DataFrame:
    """Number rows 1..n in ``order`` without pulling them into one task.

    A range sort spreads the rows; each partition is numbered on its own and shifted by the
    row count of the partitions before it (one small row per partition). The sorted rows
    are written once, so both reads see the same numbers.
    """
    base = cut_lineage(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    base = base.withColumn("_part", F.shiftright("_slot", 33)).withColumn(
        "_pos", F.col("_slot").bitwiseAND((1 << 33) - 1)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = base.groupBy("_part").agg(F.count("*").alias("_rows"))
    # one row per sort partition: bounded by the number of shuffle partitions
    shifts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    numbered = base.join(F.broadcast(shifts), "_part")
    number = (F.col("_shift") + F.col("_pos") + 1).cast("long").alias(name)
    return numbered.select(number, *df.columns)


def with_rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """1, 2, 3 ... within each group, for groups of any size."""
    numbered = with_line_number(df, [*[F.col(g).asc_nulls_first() for g in group], *order], "_line")
    first = numbered.groupBy(*group).agg(F.min("_line").alias("_first"))
    same = [F.col(f"n.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    joined = numbered.alias("n").join(first.alias("f"), same)
    return joined.select(
        *[F.col(f"n.{c}") for c in df.columns], (F.col("n._line") - F.col("f._first") + 1).alias(name)
    )


def page(df: DataFrame, order: Sequence[Column | str], start: int | None, size: int | None) -> DataFrame:
    """Rows start+1 .. start+size in ``order``; all rows in order when either is missing."""
    ranked = df.orderBy(*order)
    return ranked if start is None or size is None else ranked.offset(start).limit(size)


def top(df: DataFrame, measure: str, n: int | None, *ties: str) -> DataFrame:
    """Top n by measure, or all in that order; ``ties`` make the choice repeatable."""
    ranked = df.orderBy(F.col(measure).desc(), *ties)
    return ranked if n is None else ranked.limit(n)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in ``order``.

    The rank filter is also applied before the shuffle, so a hot key sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_first_before(
    df: DataFrame, group: str, order: Sequence[Column], columns: dict[str, str], first_flag: str = "_is_first"
) -> DataFrame:
    """Add the first non-NULL value among the rows before this one: {source: new}.

    Reads like ``first(ignorenulls)`` over the preceding rows, but the first value per group
    comes from a map-side combined aggregate and is joined back, so no task needs a whole
    group in order. Rows with a NULL group get NULLs and are nobody's first.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    placed = df.withColumn("_at", at)
    firsts = placed.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_group")).agg(
        F.min("_at").alias("_start"),
        *[
            F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).alias("v")))).alias(f"_f_{c}")
            for c in columns
        ],
    )
    # rows without group match nothing; their own salt keeps them from meeting in one task
    apart = F.when(F.col(group).isNull(), F.pmod(F.xxhash64("_at"), F.lit(4096)) + 1).otherwise(F.lit(0))
    placed = placed.withColumn("_apart", apart.cast("long"))
    firsts = firsts.withColumn("_together", F.lit(0).cast("long"))
    joined = placed.join(
        firsts, (F.col(group) == F.col("_group")) & (F.col("_apart") == F.col("_together")), "left"
    )
    carried = {new: F.when(F.col("_at") > F.col(f"_f_{c}")["at"], F.col(f"_f_{c}")["v"]) for c, new in columns.items()}
    return joined.withColumns({**carried, first_flag: F.coalesce(F.col("_at") == F.col("_start"), F.lit(False))}).select(
        *df.columns, *columns.values(), first_flag
    )
