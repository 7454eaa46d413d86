"""Plans and sizes that must hold however large the tables are."""

import datetime as dt
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shardline.elt import ledger
from shardline.gallery import QUERIES
from shardline.gallery.base import Tables
from shardline.operators import aggregates, hierarchy, ordered
from shardline.plans import catalog, flow
from shardline.sources import sinks

SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).parents[1]


@pytest.fixture
def shuffled(spark):
    """Joins without broadcasts, plans as first made."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def scans(df):
    return sum("FileScan" in x for x in lines(df))


def test_one_scan_for_all_columns(shuffled):
    t = Tables(shuffled, SMALL)
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "l_returnflag"]
    assert scans(aggregates.column_profile(t.lineitem, columns)) == 1
    assert scans(aggregates.column_profile(t.lineitem, columns, approximate=True)) == 1
    assert scans(aggregates.distinct_counts(t.lineitem, columns)) == 1
    facts = t.lineitem.select(
        F.year("l_shipdate").cast("long").alias("period_id"), F.col("l_shipdate").alias("datetime"), "l_partkey", "l_suppkey"
    )
    assert scans(flow.period_stats(facts, ["l_partkey", "l_suppkey"])) == 1


def test_profile_of_odd_values(spark):
    rows = [(None, 0.0, b"a", ["a, b"]), ("", -0.0, b"a", ["a", "b"]), ("xy", 1.5, None, None), ("xy", None, b"\x00", ["a, b"])]
    df = spark.createDataFrame(rows, "s string, d double, b binary, a array<string>")
    got = {r.column_name: r for r in aggregates.column_profile(df, df.columns).collect()}
    assert {c: (r.num_rows, r.num_distinct, r.num_nulls) for c, r in got.items()} == {
        "s": (4, 2, 1), "d": (4, 2, 1), "b": (4, 2, 1), "a": (4, 2, 1)
    }
    assert float(got["s"].avg_length) == pytest.approx(4 / 3, abs=1e-3)
    none = aggregates.column_profile(df.limit(0), ["s", "d"]).collect()
    assert sorted((r.column_name, r.num_rows, r.num_distinct, r.num_nulls, r.density) for r in none) == [
        ("d", 0, 0, 0, None), ("s", 0, 0, 0, None)
    ]
    assert aggregates.distinct_counts(df.limit(0), ["s"]).first().distinct_count == 0


@pytest.mark.parametrize("name", ["r2_top_n_child_classes", "r3_top_n_sites"])
def test_facts_are_summed_before_they_meet_a_bridge(shuffled, name, monkeypatch):
    """Between the scan of the facts and the first join above it there is an aggregate of them."""
    plans = []
    whole = flow._reduced

    def seen(rows, *keys):
        out = whole(rows, *keys)
        plans.append(lines(out))
        return out

    monkeypatch.setattr(flow, "_reduced", seen)
    QUERIES[name](shuffled, SMALL)
    first, second = plans[:2]
    assert not any("Join" in x for x in first) and any("partial_sum" in x for x in first)
    at = next(i for i, x in enumerate(second) if "FileScan" in x and "l_" in x)
    join = max(i for i, x in enumerate(second[:at]) if "Join" in x)
    assert any("partial_sum" in x for x in second[join:at])


def test_top_sites_over_time_gather_no_lists(shuffled):
    plan = "\n".join(lines(QUERIES["r4_top_n_sites_timeseries"](shuffled, SMALL)))
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    ranked = plan[plan.index("dense_rank") :]
    assert "WindowGroupLimit" in ranked and ranked.index("Partial") < ranked.index("Scan")  # limited in each task


def test_reconciliation_lets_spark_choose_the_join(shuffled):
    windows = [(1, "DELTA", 1, 1, f"t{i % 40}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 3, 1) for i in range(3000)]
    entries = shuffled.createDataFrame(
        [(d, c, s, a, t, at, at + dt.timedelta(minutes=59), n, k) for d, c, s, a, t, at, n, k in windows],
        "download_num int, control_type string, download_status int, append_status int, src_table_name string,"
        "control_start_dtm timestamp_ntz, control_end_dtm timestamp_ntz, proc_rows long, proc_duration long",
    )
    moments = [(f"t{i % 41}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(5000)]
    got = ledger.appended_rows(entries, shuffled.createDataFrame(moments, "src_table_name string, dtm timestamp_ntz"))
    assert not any("Broadcast" in x for x in lines(got))
    hours = {(w[4], w[5]) for w in windows}
    want = sum((t, m.replace(minute=0)) in hours for t, m in moments)  # windows are an hour less a minute long
    assert got.first().appended_rows == want - sum((t, m.replace(minute=0)) in hours and m.minute == 59 and m.second > 0 for t, m in moments)


@pytest.mark.parametrize("rows", [3_000, 24_000])
def test_ranges_of_ordered_rows_stay_small(spark, rows, monkeypatch):
    """Half of the rows have one key and all times share a long text prefix; ranges keep their size at any number of rows."""
    df = spark.range(rows).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.concat(F.lit("2024-03-00000"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("at"),
        F.col("id").alias("v"),
    )
    written = []
    cut = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda d, name: written.append(cut(d, name)) or written[-1])
    got = ordered.with_previous(df.repartition(5), ["k"], ["at"], {"v": "p"}, rows_a_span=1000)
    answers = {r.v: r.p for r in got.collect()}
    sizes = written[0].groupBy(F.shiftright("_slot", 33)).count().agg(F.max("count")).first()[0]
    assert sizes <= 2_000
    last, want = {}, {}
    for i in range(rows):
        k = "hot" if i % 2 == 0 else i % 50
        want[i] = last.get(k)
        last[k] = i
    assert answers == want


def test_previous_row_of_any_type(spark):
    df = spark.createDataFrame([(None, [2], 1), (None, [1], 2), ("a", [1], 3), ("a", None, 4)], "k string, at array<int>, v int")
    got = {r.v: (r.p, r._has_previous) for r in ordered.with_previous(df, ["k"], ["at"], {"v": "p"}, 3).collect()}
    assert got == {2: (None, False), 1: (2, True), 4: (None, False), 3: (4, True)}
    assert ordered.with_previous(df.limit(0), ["k"], ["at"], {"v": "p"}).collect() == []


def test_rollup_steps(spark):
    start = dt.datetime(2024, 1, 1)
    steps = [
        (1, 0, "n", None), (1, 1, "c", None), (1, 4, "f", None), (1, 5, "c", None), (1, 9, "r", None), (1, 10, "l", None), (1, 17, "d", 8),
        (2, 0, "c", None), (2, 2, "r", None), (2, 3, "l", None), (2, 4, "d", 0),
        (3, 0, "n", None), (3, 1, "l", None),
        (4, 0, "n", None), (4, 1, "c", None), (4, 2, "r", None), (4, 3, "l", None), (4, 8, "f", None), (9, 0, "c", None),
    ]
    rows = [(p, start + dt.timedelta(seconds=s), x, n) for p, s, x, n in steps]
    got = flow.rollup_ledger(
        spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "period_id long"),
        spark.createDataFrame(rows, "period_id long, at timestamp_ntz, state string, roll_rows long"),
    )
    assert sorted((r.period_id, r.state, r.copy_time, r.rollup_time, r.illegal, r.roll_rows) for r in got.collect()) == [
        (1, "d", 7, 7, 0, 8), (2, "e", 2, 1, 0, 0), (3, "n", 0, 0, 1, 0), (4, "f", 1, 5, 0, 0), (5, "n", 0, 0, 0, 0)
    ]


def test_entry_without_the_subpackage(tmp_path):
    """With its folders deleted, the pipeline's file still there or not, all other queries are left."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    asked = "import __spark_entry__ as e; print(len(e.queries()), sum(n == 'pipeline' or bool(__import__('re').match(r'op\\d+_', n)) for n in e.queries()))"
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", asked], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
        assert int(said[-2]) > 150 and said[-1] == "0"
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert not re.search("llm", (copy / "shardline" / "gallery" / "__init__.py").read_text())


def test_nested_set_of_a_deep_chain_and_a_wide_tree(spark, monkeypatch):
    """Rounds grow with the logarithm of the depth."""
    written = []
    cut = hierarchy.cut_lineage
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda d, name: written.append(name) or cut(d, name))
    deep = 5000
    chain = spark.createDataFrame([(1, None), *((i, i - 1) for i in range(2, deep + 1))], "node_id long, parent_id long")
    got = hierarchy.nested_set(chain)
    assert len(written) <= 2 * (deep.bit_length() + 2)
    assert got.where("l_idx <> node_id OR r_idx <> 10001 - node_id OR depth <> node_id - 1").isEmpty() and got.count() == deep
    wide = spark.range(2, 20_002).select(F.col("id").alias("node_id"), F.lit(1).cast("long").alias("parent_id"))
    wide = wide.unionByName(spark.createDataFrame([(1, None)], "node_id long, parent_id long"))
    got = hierarchy.nested_set(wide)
    assert got.where("node_id > 1 AND (l_idx <> 2 * (node_id - 1) OR r_idx <> l_idx + 1)").isEmpty()
    assert got.where("node_id = 1").select("l_idx", "r_idx").first() == (1, 40_002)


def test_nested_set_of_a_forest_with_strays(spark):
    """Two trees; a node that is its own parent, one of an unknown parent and a ring are reached from no start."""
    rows = [(5, None), (2, None), (9, 5), (3, 2), (4, 3), (7, 7), (8, 77), (10, 11), (11, 10), (12, 11)]
    edges = spark.createDataFrame(rows, "node_id long, parent_id long")
    got = {r.node_id: (r.depth, r.l_idx, r.r_idx) for r in hierarchy.nested_set(edges).collect()}
    assert got == {2: (0, 1, 6), 3: (1, 2, 5), 4: (2, 3, 4), 5: (0, 7, 10), 9: (1, 8, 9)}
    assert hierarchy.nested_set(edges.limit(0)).collect() == []


def test_sums_before_in_groups_of_any_size(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.s for r in ordered.with_sum_before(df.repartition(6), ["k"], ["id"], "v", "s", rows_a_span=300).collect()}
    sums, want = {}, {}
    for i in range(5000):
        want[i] = sums.get(i % 3 > 0, 0)
        sums[i % 3 > 0] = want[i] + i % 7
    assert got == want


def test_reports_of_a_day_look_at_its_relations_only(spark, monkeypatch):
    items = spark.createDataFrame(
        [(i, 1 if i % 10 == 0 else 0, f"p{i}", f"w{i}", 2, 1) for i in range(100)],
        "item_id int, dummy_item_flag int, pid string, websku string, relation_type_mask int, seller_item_status int",
    )
    details = spark.createDataFrame([(i, i // 10, 1) for i in range(90)], "item_id int, item_relation_id int, status int")
    relations = spark.createDataFrame([(10 * r, r, 1) for r in range(9)], "base_item_id int, item_relation_id int, status int")
    whole = {r.item_id: r for r in catalog.related_items(items, details, relations).collect()}
    looked = []
    carry = catalog.with_first_before
    monkeypatch.setattr(catalog, "with_first_before", lambda rows, *a: looked.append(rows) or carry(rows, *a))
    chosen = spark.createDataFrame([(13,), (14,), (50,), (95,), (500,)], "item_id int")
    got = {r.item_id: r for r in catalog.related_items(items, details, relations, chosen).collect()}
    assert {r.item_id for r in looked[0].collect()} == {*range(10, 20), *range(50, 60), 95}
    assert all(got[i] == whole[i] for i in (13, 14, 50, 95))


def test_bucketed_tables_meet_without_an_exchange(shuffled):
    plan = lines(QUERIES["s7_join_of_bucketed_tables"](shuffled, SMALL))
    assert any("SortMergeJoin" in x for x in plan)
    assert not any("Exchange" in x for x in plan)
    table = sinks.bucketed(shuffled.range(0, 5000, 1, 8), "spread", 4, "id")
    assert len(table.inputFiles()) == 4  # one file a bucket, not one a task


def test_shapes_keep_every_row(spark):
    t = Tables(spark, SMALL)
    for shape, table in (("sites", "nation"), ("partitions", "part"), ("vendor_account", "customer"), ("outer_mapping", "events")):
        assert getattr(t, shape).count() == getattr(t, table).count()
    assert t.extents.count() == t.lineitem.count()
    owners = t.account.join(t.vendor_account, "account_id", "left_anti")
    assert 0 < owners.count() < t.account.count()  # misses come from the keys
