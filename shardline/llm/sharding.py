"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A ring has ``cells`` positions. Every shard owns ``vnodes`` of them; a key belongs to the first
virtual node at or after its own position. A shard takes keys up to its quota; the keys beyond it
go on clockwise to the next shard with room. Which keys go on depends on counts alone, so the walk
is made once over the arcs between virtual nodes (``shards * vnodes`` of them, whatever the rows)
and each row finds its shard by its rank within its arc.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def _ring(spark: SparkSession, shards: int, vnodes: int, cells: int) -> DataFrame:
    """One row: the virtual nodes in ring order. A shard's nodes don't depend on how many shards there are."""
    nodes = f"""
        sort_array(transform(sequence(0, {shards * vnodes - 1}), i -> named_struct(
            'cell', pmod(xxhash64('virtual node', i % {shards}, i div {shards}), {cells}),
            'shard', i % {shards})))"""
    ordered = spark.range(1).select(F.expr(nodes).alias("nodes"))
    # of nodes that share a cell the lowest shard's stays
    return ordered.select(F.expr("filter(nodes, (x, i) -> i = 0 or nodes[i - 1].cell < x.cell)").alias("nodes"))


def _arcs(ring: DataFrame, cells: int) -> DataFrame:
    """A row per cell: its arc, and the shards in the order in which that arc's keys try them."""
    # keys behind the last node wrap round to the first
    arcs = f"""
        transform(nodes, (x, i) -> named_struct(
            'arc', i,
            'tries', array_distinct(transform(
                concat(slice(nodes, i + 1, size(nodes)), slice(nodes, 1, i)), y -> y.shard)),
            'cells', concat(
                sequence(if(i = 0, 0L, nodes[i - 1].cell + 1), x.cell),
                if(i = 0 and nodes[size(nodes) - 1].cell < {cells - 1},
                   sequence(nodes[size(nodes) - 1].cell + 1, {cells - 1}L), array()))))"""
    rows = ring.select(F.explode(F.expr(arcs)).alias("a"))
    return rows.select("a.arc", "a.tries", F.explode("a.cells").alias("cell"))


# One step of the walk: the keys of arc x.arc that are still without a shard try x.shard.
_TAKE = "least(s.left[x.arc], s.free[x.shard])"
_STEP = f"""
    if({_TAKE} = 0, s, named_struct(
        'left', transform(s.left, (v, i) -> if(i = x.arc, v - {_TAKE}, v)),
        'free', transform(s.free, (v, i) -> if(i = x.shard, v - {_TAKE}, v)),
        'out', concat(s.out, array(named_struct(
            'arc', x.arc, 'shard', x.shard,
            'lo', keys[x.arc] - s.left[x.arc],
            'hi', keys[x.arc] - s.left[x.arc] + {_TAKE},
            'slot', quota[x.shard] - s.free[x.shard])))))"""


def _walk(arc_counts: DataFrame, shards: int, slack: float) -> DataFrame:
    """Per arc the ranks that each shard takes: ``takes`` of (shard, lo, hi, slot of the first).

    Round by round every arc tries its next shard, in ring order, and fills what is free there.
    """
    size = (
        f"transform(sequence(0, {shards - 1}), s -> n div {shards} + if(s < n % {shards}, 1L, 0L))"
        if slack == 0
        else f"array_repeat(cast(ceil((1 + {slack}D) * n / {shards}) as bigint), {shards})"
    )
    one = (
        arc_counts.groupBy()  # shards * vnodes rows
        .agg(
            F.sort_array(F.collect_list(F.struct("arc", "n", "tries"))).alias("arcs"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        )
        .select(
            F.expr("transform(arcs, a -> a.n)").alias("keys"),
            F.expr(size).alias("quota"),
            F.expr(
                f"""flatten(transform(sequence(0, {shards - 1}), t ->
                    transform(arcs, a -> named_struct('arc', a.arc, 'shard', a.tries[t]))))"""
            ).alias("steps"),
        )
    )
    start = """named_struct('left', keys, 'free', quota, 'out', cast(array() as
        array<struct<arc: int, shard: int, lo: bigint, hi: bigint, slot: bigint>>))"""
    took = one.select(F.explode(F.expr(f"aggregate(steps, {start}, (s, x) -> {_STEP}).out")).alias("t"))
    return took.groupBy("t.arc").agg(F.collect_list(F.struct("t.shard", "t.lo", "t.hi", "t.slot")).alias("takes"))


def ring_shards(
    rows: DataFrame,
    key: str,
    carry: Sequence[str] = (),
    shards: int = 8,
    vnodes: int = 64,
    slack: float = 0.0,
    cells: int = 1 << 16,
) -> DataFrame:
    """Every row's key, carried columns, ``shard``, ``slot`` (gapless from 0 in a shard) and ``home_shard``.

    ``home_shard`` is the shard without bounds. A shard holds at most ``ceil((1 + slack) * n / shards)``
    rows; with no slack the counts are at most one apart. ``carry`` names further columns to
    return (of hashable types). Rows without a key are placed by what they carry, so that they don't meet in one task; repeated rows
    are counted before the shuffle and spread out again, so none is a hot key. An empty table
    gives an empty one. Columns that aren't named are left out, so their names can't clash.
    """
    if shards < 1 or vnodes < 1 or slack < 0 or cells < 2:
        raise ValueError("shards, vnodes and cells must be positive and slack not negative")
    names = [f"c{i}" for i in range(1 + len(carry))]
    plain = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip([key, *carry], names, strict=True)))
    by_key, by_row = F.xxhash64(F.lit("key"), "c0"), F.xxhash64(F.lit("key"), *names)
    position = F.when(F.col("c0").isNull(), by_row).otherwise(by_key)
    plain = plain.withColumn("cell", F.pmod(position, F.lit(cells)))

    place = _arcs(_ring(rows.sparkSession, shards, vnodes, cells), cells)
    counted = place.join(plain.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", "left")
    counted = counted.withColumn("n", F.coalesce("n", F.lit(0)))
    takes = _walk(
        counted.groupBy("arc").agg(F.sum("n").alias("n"), F.first("tries").alias("tries")), shards, slack
    )
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        counted.filter("n > 0")
        .select(
            "cell",
            "arc",
            F.col("tries")[0].alias("home_shard"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        )
        .join(takes, "arc")
        .select("cell", "home_shard", "first", "takes")
    )

    sofar = Window.partitionBy("cell").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        plain.groupBy("cell", *names)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rank", F.coalesce(F.sum("n").over(sofar), F.lit(0)))
    )
    return (
        ranked.join(placed, "cell")
        .select(
            *names,
            "home_shard",
            "takes",
            F.explode(F.expr("sequence(first + rank, first + rank + n - 1)")).alias("rank"),
        )
        .withColumn("take", F.expr("filter(takes, t -> t.lo <= rank and rank < t.hi)[0]"))
        .select(
            *(F.col(n).alias(c) for c, n in zip([key, *carry], names, strict=True)),
            F.col("take.shard").cast("int").alias("shard"),
            (F.col("take.slot") + F.col("rank") - F.col("take.lo")).alias("slot"),
            F.col("home_shard").cast("int").alias("home_shard"),
        )
    )
