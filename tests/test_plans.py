"""Plans that must keep their shape: one fact scan, pushed filters, spread-out groups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardline.elt.load import upsert
from shardline.functions import predicates as P
from shardline.gallery.base import Tables
from shardline.gallery.flow import END, GROUP, START, bridges
from shardline.operators import ordered
from shardline.plans import flow
from shardline.sources import sinks
from shardline.streaming import delta

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    """Class facts as they would be stored: files partitioned by grain and month."""
    path = str(tmp_path_factory.mktemp("facts") / "class_facts")
    rows = Tables(spark, FOLDER).class_facts.withColumn("month", F.date_format("datetime", "yyyyMM"))
    rows.write.partitionBy("grain", "month").parquet(path)
    return spark.read.parquet(path)


def test_site_report_scans_the_facts_once_and_takes_the_top_in_order(spark, facts):
    report = flow.top_n_sites(
        facts, bridges(Tables(spark, FOLDER)), group_id=GROUP, measure="bytes", start=START, end=END, n=3, grain="month"
    )
    plan = plan_of(report)
    assert plan.count("class_facts") == 1
    assert "TakeOrderedAndProject" in plan and "SinglePartition" not in plan


def test_timeseries_scans_the_facts_once(spark, facts):
    report = flow.top_n_sites_timeseries(
        facts, bridges(Tables(spark, FOLDER)), group_id=GROUP, measure="bytes", start=START, end=END, n=3, grain="month"
    )
    assert plan_of(report).count("class_facts") == 1


def test_period_filter_prunes_partitions_and_is_pushed_down(spark, facts):
    rows = flow.in_periods(facts, dt.datetime(1996, 1, 1), dt.datetime(1996, 2, 1), "month").select("bytes")
    plan = plan_of(rows)
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "grain" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "datetime" in scan.split("PushedFilters:")[1]
    assert "peak_bps" not in scan.split("ReadSchema:")[1]


def test_day_filter_is_pushed_down(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    plan = plan_of(orders.where(P.on_day("o_orderdate", dt.date(1997, 5, 28))).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_orde" in plan


def test_spans_split_a_hot_key(spark):
    moment = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id"))
    rows = spark.range(8000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), moment.alias("t"))
    groups = ordered.with_span(rows, ["t"], 16).groupBy("k", "_span").count()
    assert groups.agg(F.max("count")).first()[0] < 8000 / 16 * 1.2


def test_spans_split_a_hot_moment(spark):
    moment = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(4000)
    rows = spark.range(8000).select("id", F.lit(1).alias("k"), moment.alias("t"))
    spanned = ordered.with_span(rows, ["t", "id"], 16)
    assert spanned.groupBy("k", "_span").count().agg(F.max("count")).first()[0] < 8000 / 16 * 1.2
    in_order = spanned.orderBy("t", "id").select("_span").collect()
    assert [r[0] for r in in_order] == sorted(r[0] for r in in_order)


def test_rows_without_group_do_not_meet(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 9 == 0, 1).alias("g"), F.lit("x").alias("v"))
    plan = plan_of(ordered.with_first_before(rows, "g", [F.col("id")], {"v": "c"}))
    assert "_apart" in plan


def test_upsert_of_a_small_delta_leaves_the_stage_unshuffled(spark, tmp_path):
    spark.range(5000).withColumn("v", F.lit(1)).write.parquet(str(tmp_path / "stage"))
    spark.range(10).withColumn("v", F.lit(2)).write.parquet(str(tmp_path / "delta"))
    stage, new = (spark.read.parquet(str(tmp_path / n)) for n in ("stage", "delta"))
    plan = plan_of(upsert(stage, new, ["id"], ["v"]))
    branch = plan[: plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in branch and "Exchange hashpartitioning" not in branch


def test_archive_is_read_by_month(spark, tmp_path):
    path = str(tmp_path / "archive")
    sinks.archive_months(spark.read.parquet(f"{FOLDER}/orders.parquet"), "o_orderdate", path)
    plan = plan_of(spark.read.parquet(path).where("yyyymm = 199705"))
    assert "yyyymm" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_rate_windows_aggregate_before_the_shuffle(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    plan = plan_of(delta.rate_windows(events, "ts", "15 minutes", "1 hour", ["event_type"], "value"))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
