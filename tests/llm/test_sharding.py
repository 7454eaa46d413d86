"""The bounded-load ring against a plain walk over the same positions."""

import math

from pyspark.sql import functions as F

from shardline.llm.sharding import ring_shards


def walk(keys, nodes, cells, shards, slack):
    """{(key, copy): (shard, slot)} by trying the shards arc by arc; keys: (cell, key) in any order."""
    ring = {}
    for cell, shard in sorted(nodes):
        ring.setdefault(cell, shard)
    arcs = sorted(ring.items())
    n = len(keys)
    quota = (
        [n // shards + (s < n % shards) for s in range(shards)]
        if slack == 0
        else [math.ceil((1 + slack) * n / shards)] * shards
    )
    waiting = []
    for i, (cell, _) in enumerate(arcs):
        low = arcs[i - 1][0] if i else -1
        own = [k for k in keys if low < k[0] <= cell or i == 0 and k[0] > arcs[-1][0]]
        waiting.append(sorted(own, key=lambda k: (k[0], k[1] is not None, k[1])))
    tries = [list(dict.fromkeys(s for _, s in arcs[i:] + arcs[:i])) for i in range(len(arcs))]
    out, used = [], [0] * shards
    for turn in range(shards):
        for i in range(len(arcs)):
            shard = tries[i][turn]
            take = min(len(waiting[i]), quota[shard] - used[shard])
            for k in waiting[i][:take]:
                out.append((k[1], shard, used[shard], tries[i][0]))
                used[shard] += 1
            waiting[i] = waiting[i][take:]
    return sorted(out, key=str)


def positions(spark, df, shards, vnodes, cells):
    keys = [(r[0], r[1]) for r in df.select(F.pmod(F.xxhash64(F.lit("key"), "k"), F.lit(cells)), "k").collect()]
    nodes = spark.range(shards * vnodes).selectExpr(
        f"pmod(xxhash64('virtual node', cast(id % {shards} as int), cast(id div {shards} as bigint)), {cells}) AS cell",
        f"cast(id % {shards} as int) AS shard",
    )
    return keys, [(r.cell, r.shard) for r in nodes.collect()]


def test_equals_the_plain_walk(spark):
    values = [*range(150), 3, 3, 3, None, None]  # repeated and null keys
    df = spark.createDataFrame([(v,) for v in values], "k long")
    for shards, vnodes, slack in ((5, 4, 0.0), (3, 2, 0.2)):
        keys, nodes = positions(spark, df, shards, vnodes, 64)
        got = ring_shards(df, "k", shards=shards, vnodes=vnodes, slack=slack, cells=64)
        rows = sorted(((r.k, r.shard, r.slot, r.home_shard) for r in got.collect()), key=str)
        assert rows == walk(keys, nodes, 64, shards, slack)


def test_balance_and_slots(spark):
    got = ring_shards(spark.range(1001), "id").collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert {len(v) for v in by.values()} == {125, 126}
    assert all(v == list(range(len(v))) for v in by.values())


def test_another_shard_moves_few_keys(spark):
    ids = spark.range(4000)
    a = ring_shards(ids, "id", slack=0.5)
    b = ring_shards(ids, "id", shards=9, slack=0.5).select("id", F.col("shard").alias("then"))
    moved = a.join(b, "id").filter("shard <> then").count()
    assert 0 < moved < 4000 * 0.25


def test_empty_single_and_clashing_names(spark):
    assert ring_shards(spark.range(0), "id").count() == 0
    odd = spark.createDataFrame([(1, "x", 5)], "cell long, n string, shard int")
    row = ring_shards(odd, "cell", ["n"]).collect()
    assert [(r.cell, r.n, r.slot) for r in row] == [(1, "x", 0)]


def test_plan_is_native(spark):
    plan = ring_shards(spark.range(10), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_rows_without_a_key_spread_over_the_ring(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("k"), "id")
    got = ring_shards(rows, "k", ["id"])
    homes = {r["home_shard"]: r["count"] for r in got.groupBy("home_shard").count().collect()}
    assert len(homes) == 8 and max(homes.values()) < 1200
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {500}
    assert got.select("id").distinct().count() == 4000
