import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shardline.functions.predicates import leaf
from shardline.functions.scalars import ratio
from shardline.operators import aggregates, hierarchy, masks, ordered, sets

START = dt.datetime(2020, 1, 1)


def skewed_rows(n=400, seed=1):
    """(id, key, time, value): one key holds most rows, times repeat, some values are NULL."""
    rng = random.Random(seed)
    return [
        (
            i,
            0 if rng.random() < 0.6 else rng.randrange(1, 30),
            START + dt.timedelta(minutes=rng.randrange(60)),
            rng.choice([None, "a", "b"]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("spans", [2, 8, 32])
def test_with_previous_equals_walking_each_key(spark, spans):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id int, key int, t timestamp_ntz, v string").repartition(7)
    df = df.withColumn("t", F.when(F.col("id") % 2 == 0, F.lit(START).cast("timestamp_ntz")).otherwise(F.col("t")))
    rows = [(i, k, START if i % 2 == 0 else t, v) for i, k, t, v in rows]
    got = {
        r["id"]: (r["_has_previous"], r["p"])
        for r in ordered.with_previous(df, ["key"], ["t", "id"], {"v": "p"}, spans).collect()
    }
    want, last = {}, {}
    for i, key, t, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = (key in last, last.get(key))
        last[key] = v
    assert got == want


def test_line_numbers_are_whole_and_in_order(spark):
    rows = skewed_rows(300)
    df = spark.createDataFrame(rows, "id int, key int, t timestamp_ntz, v string").repartition(9)
    got = sorted(ordered.with_line_number(df, ["key", "t", "id"]).select("line_num", "id").collect())
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]))]
    assert [r["line_num"] for r in got] == list(range(1, 301))
    assert [r["id"] for r in got] == want


def test_line_numbers_of_nothing(spark):
    assert ordered.with_line_number(spark.range(0), ["id"]).count() == 0


def test_rank_in_group_with_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5)], "id int, g int")
    got = {r["id"]: r["rank"] for r in ordered.with_rank_in_group(df, ["g"], ["id"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}


def test_first_before_equals_walking_the_group(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 0, 0, 1, 2]), rng.choice([0, 1]), rng.choice([None, "x", "y"])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g int, flag int, v string").repartition(5)
    got = {
        r["id"]: (r["c"], r["_is_first"])
        for r in ordered.with_first_before(df, "g", [-F.col("flag"), F.col("id")], {"v": "c"}).collect()
    }
    want, seen, started = {}, {}, set()
    for i, g, flag, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[i] = (None, False) if g is None else (seen.get(g), g not in started)
        if g is not None:
            started.add(g)
            if v is not None:
                seen.setdefault(g, v)
    assert got == want


def test_latest_takes_one_row_per_key(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id int, key int, t timestamp_ntz, v string")
    got = {r["key"]: r["id"] for r in ordered.latest(df, ["key"], [F.col("t").desc(), F.col("id").desc()]).collect()}
    want = {}
    for i, key, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[key] = i
    assert got == want


def test_latest_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = ordered.latest(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_page(spark):
    df = spark.range(20)
    assert [r[0] for r in ordered.page(df, ["id"], 5, 3).collect()] == [5, 6, 7]
    assert ordered.page(df, ["id"], None, 3).count() == 20


def test_masks_equal_the_nested_loop(spark):
    wanted = [0, 1, 2, 3, 5, 6, 12, 64, None]
    lookup = [(0, "none"), (1, "a"), (3, "ab"), (7, "abc"), (14, "bcd"), (127, "all")]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(wanted * 3)], "id int, mask int")
    types = spark.createDataFrame(lookup, "bits int, name string")
    got = sorted((r["id"], r["name"]) for r in masks.join_covering(df, "mask", types, "bits").collect())
    want = sorted((i, n) for i, m in enumerate(wanted * 3) if m is not None for b, n in lookup if b & m == m)
    assert got == want


def test_masks_with_high_bits_and_repeated_rows(spark):
    top = 1 << 40
    wanted = [top, top | 1, -1, -(1 << 63), 0]
    lookup = [(top, "t"), (top | 3, "t3"), (-1, "all"), (-1, "all"), (1, "a"), (1, "a"), (None, "none")]
    df = spark.createDataFrame([(m,) for m in wanted], "mask long")
    types = spark.createDataFrame(lookup, "bits long, name string")
    pairs = masks.join_covering(df, "mask", types, "bits")
    got = sorted((r["mask"], r["name"]) for r in pairs.collect())
    assert got == sorted((m, n) for m in wanted for b, n in lookup if b is not None and b & m == m)


def test_nested_set_of_a_deep_tree_and_odd_ids(spark):
    chain = spark.createDataFrame([(1, None), *((i, i - 1) for i in range(2, 81))], "node_id long, parent_id long")
    got = {r["node_id"]: (r["l_idx"], r["r_idx"]) for r in hierarchy.nested_set(chain).collect()}
    assert got == {i: (i, 161 - i) for i in range(1, 81)}
    negative = spark.createDataFrame([(0, None), (-15, 0), (-12, 0)], "node_id long, parent_id long")
    got = {r["node_id"]: r["l_idx"] for r in hierarchy.nested_set(negative).collect()}
    assert got == {0: 1, -15: 2, -12: 4}
    long = "x" * 30
    texts = spark.createDataFrame([("r", None), (long + "a", "r"), (long + "b", "r"), ("c", long + "a")], "node_id string, parent_id string")
    got = {r["node_id"]: (r["l_idx"], r["r_idx"]) for r in hierarchy.nested_set(texts).collect()}
    assert got == {"r": (1, 8), long + "a": (2, 5), "c": (3, 4), long + "b": (6, 7)}


def test_previous_by_a_text_order(spark):
    rows = [("k", f"{i:03}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, at string, v int")
    got = {r["at"]: r["before"] for r in ordered.with_previous(df, ["k"], ["at"], {"v": "before"}).collect()}
    assert got == {f"{i:03}": i - 1 if i else None for i in range(50)}
    with pytest.raises(TypeError):
        ordered.with_span(df.withColumn("at", F.array("at")), ["at"])


def test_rates_of_fractions_and_large_sums(spark):
    row = spark.range(1).select(
        ratio(F.lit(1.5), F.lit(2.5)).alias("a"),
        ratio(F.lit(0.4), F.lit(0.4)).alias("b"),
        ratio(F.lit(1), F.lit(0.0)).alias("c"),
        aggregates.bit_rate(F.lit(2 * 10**18), F.lit(2)).alias("d"),
        aggregates.efficiency(F.lit(10**18), F.lit(10**17)).alias("e"),
    ).first()
    assert [float(x) for x in row] == [0.6, 1.0, 0.0, 8e18, 90.0]


def test_nested_set_golden(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "node_id long, parent_id long")
    got = {r["node_id"]: (r["l_idx"], r["r_idx"]) for r in hierarchy.nested_set(edges).collect()}
    assert got == {1: (1, 8), 2: (2, 5), 4: (3, 4), 3: (6, 7)}
    below = {r["node_id"]: (r["l_idx"], r["r_idx"]) for r in hierarchy.nested_set(edges, root=2, start=10).collect()}
    assert below == {2: (10, 13), 4: (11, 12)}


def test_nested_set_of_a_random_tree(spark):
    rng = random.Random(5)
    parents = {1: None, **{i: rng.choice([1, 1, rng.randrange(1, i)]) for i in range(2, 120)}}
    edges = spark.createDataFrame(list(parents.items()), "node_id long, parent_id long")
    rows = hierarchy.nested_set(edges).collect()
    got = {r["node_id"]: (r["l_idx"], r["r_idx"]) for r in rows}

    def walk(node, left):
        right = left + 1
        for child in sorted(c for c, p in parents.items() if p == node):
            right = walk(child, right)
        want[node] = (left, right)
        return right + 1

    want: dict = {}
    walk(1, 1)
    assert got == want
    children = {p for p in parents.values() if p}
    leaves = {r["node_id"] for r in hierarchy.nested_set(edges).where(leaf()).collect()}
    assert leaves == set(parents) - children


def test_nested_set_refuses_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long")
    with pytest.raises(ValueError):
        hierarchy.nested_set(edges, root=1)


def test_one_sided_is_empty_for_equal_sides(spark):
    df = spark.range(5)
    assert sets.one_sided(df, df, ["id"]).count() == 0
    odd = sets.one_sided(spark.range(3), spark.range(1, 4), ["id"]).collect()
    assert {(r["table_location"], r["id"]) for r in odd} == {("Local Table", 0), ("Remote Table", 3)}


def test_listing_diff_counts_repeats(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], ["line"])
    b = spark.createDataFrame([("x",), ("z",)], ["line"])
    got = {(r["side"], r["line"], r["copies"]) for r in sets.listing_diff(a, b).collect()}
    assert got == {("<", "x", 1), ("<", "y", 1), (">", "z", 1)}


def test_column_profile(spark):
    df = spark.createDataFrame([("aa", 1), ("b", None), (None, 1)], "s string, n int")
    got = {r["column_name"]: r for r in aggregates.column_profile(df, ["s", "n"]).collect()}
    assert (got["s"]["num_distinct"], got["s"]["num_nulls"], float(got["s"]["avg_length"])) == (2, 1, 1.5)
    assert (got["n"]["num_rows"], got["n"]["density"]) == (3, 1.0)
    rough = aggregates.column_profile(df, ["s"], approximate=True).first()
    assert rough["num_distinct"] == 2


def test_total_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 4)], "k string, v int")
    got = {(r["k"], r["s"]) for r in aggregates.with_total_row(df, ["k"], {"s": F.sum("v")}).collect()}
    assert got == {("a", 3), (None, 4), ("Total", 7)}
