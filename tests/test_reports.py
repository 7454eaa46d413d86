import datetime as dt
import random

import pytest

from shardline.plans import catalog, flow, metrics, storage

P1, P2 = dt.datetime(2008, 6, 15, 10), dt.datetime(2008, 6, 15, 11)
LAYOUT = (
    "grain string, period_id long, datetime timestamp_ntz, device_id long, class_id long, bytes long, pkts long, "
    "tcp_retx_bytes long, sample_interval_secs long, peak_bps long, guar_rate_fails long"
)


@pytest.fixture(scope="module")
def dims(spark):
    return flow.Bridges(
        classes=spark.createDataFrame(
            [(1, None, "in", "/In", 1, 8), (2, 1, "web", "/In/Web", 2, 3), (3, 1, "mail", "/In/Mail", 4, 5)],
            "class_id long, parent_id long, name string, path string, l_idx long, r_idx long",
        ),
        group_devices=spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "group_id int, device_id long"),
        dev_classes=spark.createDataFrame(
            [(d, c, c) for d in (10, 11, 12) for c in (1, 2, 3)], "device_id long, class_id long, ud_class_id long"
        ),
        site_classes=spark.createDataFrame([(7, 2), (8, 3), (9, 3), (9, 1)], "site_id int, class_id long"),
        sites=spark.createDataFrame([(7, "  Web"), (8, "Mail")], "site_id int, name string"),
    )


def facts(spark, rows):
    full = [("hour", 1, t, d, c, b, 1, b // 10, 60, b * 2, 0) for t, d, c, b in rows]
    return spark.createDataFrame(full, LAYOUT)


def run(spark, dims, rows, **options):
    settings = dict(group_id=1, measure="bytes", start=P1, end=P2 + dt.timedelta(hours=1), n=5, grain="hour") | options
    return flow.top_n_sites(facts(spark, rows), dims, **settings).collect()


def test_total_counts_unnamed_sites_and_other_sites_than_the_top(spark, dims):
    rows = [(P1, 10, 2, 600), (P2, 11, 2, 200), (P1, 10, 3, 100), (P1, 12, 3, 999), (P1, 10, 1, 5000)]
    got = run(spark, dims, rows, n=1)
    assert len(got) == 1
    # sites 8 and 9 share class 3; class 1 is no leaf and device 12 is in another group
    assert (got[0]["total"], got[0]["site_id"], got[0]["site_name"], got[0]["bytes"]) == (1000, 7, "Web", 800)
    assert float(got[0]["avg_rate"]) == round((8 * 600 / 60 + 8 * 200 / 60) / 2, 2)
    assert got[0]["peak_rate"] == 1200
    everyone = run(spark, dims, rows, group_id=0)
    assert {r["site_id"]: r["bytes"] for r in everyone} == {7: 800, 8: 1099}


def test_equal_periods_merge_only_on_request(spark, dims):
    rows = [(P1, 10, 2, 600), (P2, 10, 2, 600)]
    assert [(r["total"], r["bytes"]) for r in run(spark, dims, rows)] == [(1200, 1200)]
    assert [(r["total"], r["bytes"]) for r in run(spark, dims, rows, distinct_periods=True)] == [(600, 600)]


def test_sites_without_traffic_are_left_out(spark, dims):
    assert run(spark, dims, [(P1, 10, 2, 0)]) == []


def test_end_before_start(spark, dims):
    with pytest.raises(ValueError):
        run(spark, dims, [(P1, 10, 2, 1)], end=P1 - dt.timedelta(hours=1))


def test_timeseries_order(spark, dims):
    rows = [(P2, 10, 2, 60), (P1, 10, 2, 60), (P1, 10, 3, 600)]
    got = flow.top_n_sites_timeseries(
        facts(spark, rows), dims, group_id=1, measure="bytes", start=P1, end=P2 + dt.timedelta(hours=1), n=5, grain="hour"
    ).collect()
    assert [(r["ord_num"], r["site_id"], r["start_time"], float(r["avg_rate"])) for r in got] == [
        (1, 8, P1, 80.0),
        (2, 7, P1, 8.0),
        (2, 7, P2, 8.0),
    ]


def test_flow_details_of_binary_addresses(spark):
    rng = random.Random(2)
    layout = (
        "grain string, period_id long, datetime timestamp_ntz, device_id long, ud_class_id long, src_ip binary, dst_ip binary, "
        "vlan_id int, tos int, service_id int, ftype_num int, bytes long, pkts long, flow_num long, retrans_bytes long, "
        "measure_1 long, measure_2 long, measure_3 long"
    )
    rows = [
        ("raw", 0, P1, 1, 1, bytearray([10, 0, 0, rng.randrange(2)]), bytearray([10, 0, 1, rng.randrange(3)]), 1, 0, 0,
         rng.choice([1, 4, 5]), 100, 1, 1, 1, 8, 6, 2)
        for _ in range(200)
    ]
    got = flow.top_n_flow_details(
        spark.createDataFrame(rows, layout), flow_type="talker", measure="bytes", value="10.0.0.1",
        start=P1, end=P2, grain="raw", binary_ip=True,
    ).collect()
    mine = [r for r in rows if r[5][3] == 1]
    assert sum(r["flows"] for r in got) == len(mine)
    by_peer = {r["entity"]: r for r in got}
    for last in range(3):
        peer = [r for r in mine if r[6][3] == last]
        line = by_peer[f"10.0.1.{last}"]
        assert line["bytes"] == 100 * len(peer)
        assert line["total_rtm_trans"] == sum(2 for r in peer if r[10] == 4)
        assert line["pet_server"] == sum(6 for r in peer if r[10] == 5)
        assert float(line["avg_total_delay"]) == (4.0 if any(r[10] == 4 for r in peer) else 0.0)
        assert float(line["efficiency_pct"]) == 99.0


@pytest.mark.parametrize(
    "start,end",
    [
        ("2024-01-01 00:00:00", "2024-03-01 00:00:00"),
        ("2024-01-15 10:20:00", "2024-04-02 03:05:00"),
        ("2024-01-15 10:20:00", "2024-01-15 10:40:00"),
        ("2023-12-31 23:00:00", "2024-01-01 01:00:00"),
        ("2024-02-01 00:00:00", "2024-02-01 00:00:00"),
    ],
)
def test_grains_cover_a_range_once(spark, start, end):
    start, end = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
    times = [dt.datetime(2023, 12, 31, 22) + dt.timedelta(minutes=35 * i) for i in range(4000)]
    raw = spark.createDataFrame([("raw", 0, t, 1, 1, 1, 1, 0, 1, 1, 0) for t in times], LAYOUT)
    stored = raw
    for grain in ("hour", "day", "month"):
        stored = stored.unionByName(flow.rollup_facts(raw, grain).select(*raw.columns))
    got = flow.in_periods(stored, start, end, ("month", "day", "hour", "raw")).agg({"bytes": "sum"}).first()[0]
    assert (got or 0) == sum(start <= t < end for t in times)


def test_metric_ratios_by_hand(spark):
    figures = [("physical reads", 10), ("db block gets", 5), ("consistent gets", 3), ("parse count", 7), ("physical writes", 4)]
    row = metrics.metric_ratios(spark.createDataFrame(figures, "name string, value long")).first()
    assert float(row["hr"]) == 1 + (10 / 5 + 3)
    assert float(row["hit_ratio"]) == (5 + 3 - 10) / (5 + 3)
    assert (float(row["rwr"]), float(row["pcc"])) == (2.5, 0)


def test_usage_has_a_grand_total(spark):
    spaces = spark.createDataFrame([(1, "users", 1), (2, "old", 2)], "ts int, name string, online int")
    files = spark.createDataFrame([(1, 1, "f1", 2, 128), (2, 1, "f2", 2, 256)], "ts int, file int, file_name string, status int, blocks long")
    extents = spark.createDataFrame([(1, 1, 64), (1, 1, 32)], "ts int, file int, length long")
    got = {r["tablespace"]: (float(r["total"]), float(r["used_mb"]), float(r["free_mb"]), r["use_pct"]) for r in storage.usage_by_file(spaces, files, extents, 8192).collect()}
    assert got["Total"] == (3.0, 0.75, 2.25, None)

def test_reports_keep_shards_apart(spark):
    """Two shards that reuse item and relation ids give the lines of each on its own."""
    from shardline.sources.shards import all_shards_of

    day = dt.date(2020, 5, 1)
    at = dt.datetime(2020, 5, 1)

    def frames(k):
        items = [
            (i, 5, 1, 3, f"W{i}{k}", f"P{i}{k}", 1 if i % 4 == 0 else 0, 2, 1, 10 + (i + k) % 3, 1, 2, at, at, 1, 1)
            for i in range(1, 13)
        ]
        layout = (
            "item_id int, account_id int, account_type int, fulfillment_type int, websku string, pid string, dummy_item_flag int, "
            "relation_type_mask int, content_item_class_id int, content_item_id int, seller_item_status int, catalog_status int, "
            "created_dtm timestamp_ntz, modified_dtm timestamp_ntz, shc_division_nbr int, shc_hierarchy_id int"
        )
        return {
            "items": spark.createDataFrame(items, layout),
            "content_items": spark.createDataFrame([(10 + j, f"u{j}{k}", f"n{j}{k}", 1, 2) for j in range(3)], "content_item_id int, upc string, name string, status int, enrichment_status int"),
            "item_log": spark.createDataFrame([(i, 1, at) for i in range(1 + k, 13)], "item_id int, catalog_status int, log_created_dtm timestamp_ntz"),
            "relations": spark.createDataFrame([(i // 4, i, 1) for i in (4, 8, 12)], "item_relation_id int, base_item_id int, status int"),
            "relation_details": spark.createDataFrame([(i, i // 4, 1) for i in range(5, 12) if i % 4], "item_id int, item_relation_id int, status int"),
            "vendor_packages": spark.createDataFrame([(i, 1, 1, 100 + k) for i in range(1, 13)], "item_id int, store_id int, status int, order_duns_number int"),
            "item_sites": spark.createDataFrame([(i, 1, 1) for i in range(1, 13)], "item_id int, site_id int, status int"),
        }

    fixed = {
        "accounts": spark.createDataFrame([(5, "shop")], "account_id int, account_name string"),
        "item_classes": spark.createDataFrame([(1, "a|b")], "content_item_class_id int, content_item_class_display_path string"),
        "relation_types": spark.createDataFrame([(2, "set"), (3, "pair")], "bit_value int, item_relation_type_name string"),
        "lookups": spark.createDataFrame([(18, 2, "live"), (19, 1, "on")], "lookup_type_id int, lookup_value int, lookup_description string"),
        "sites": spark.createDataFrame([(1, "site")], "site_id int, site_name string"),
    }
    own = {k: frames(k) for k in (0, 1)}
    both = {name: all_shards_of({k: own[k][name] for k in own}) for name in own[0]}
    for report in (catalog.publish_report, catalog.create_report):
        together = report(catalog.Catalog(**both, **fixed), day)
        columns = [c for c in together.columns if c != "shard_index"]
        for k in own:
            alone = report(catalog.Catalog(**own[k], **fixed), day).select(*columns).collect()
            assert alone and sorted(map(str, together.where(f"shard_index = {k}").select(*columns).collect())) == sorted(map(str, alone))
