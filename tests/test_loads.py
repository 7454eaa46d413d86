import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardline.elt import compaction, ledger, load, registry, schema_diff
from shardline.plans import accounts
from shardline.sources import shards, sinks
from shardline.streaming import delta

VERSIONS = [  # invented: (log id, time, name, mask); 12 versions of which 4 changed something
    (11, "2020-03-01 08:00:00", "north depot", 1),
    (14, "2020-03-01 08:00:05", "depot", 6),
    (20, "2020-05-10 12:30:00", "depot", 17),
    *((20 + 3 * i, f"2020-06-{i + 1:02} 09:15:00", "depot", 17) for i in range(1, 8)),
    (50, "2020-09-09 10:00:00", "depot", 33),
    (58, "2020-10-01 07:45:00", "depot", 33),
]
KEYS = ("account_id", "account_log_id", "log_modified_dtm")


@pytest.fixture
def account_log(spark):
    rows = [(i, 0, dt.datetime.fromisoformat(t), -1, n, None, m) for i, t, n, m in VERSIONS]
    layout = (
        "account_log_id int, account_id int, log_modified_dtm timestamp_ntz, modified_id int, account_name string, "
        "domain string, account_type_mask int"
    )
    return spark.createDataFrame(rows, layout)


def ids(df):
    return sorted(r["account_log_id"] for r in df.collect())


def test_compaction_keeps_the_changes(account_log):
    assert ids(compaction.compact_log(account_log, *KEYS)) == [11, 14, 20, 50]


def test_compaction_twice_changes_nothing(account_log):
    once = compaction.compact_log(account_log, *KEYS)
    assert ids(compaction.compact_log(once, *KEYS)) == ids(once)


def test_compaction_keeps_a_return_to_an_old_value_and_null_changes(spark):
    rows = [(1, "a"), (2, None), (3, None), (4, "a"), (5, "NULL"), (6, None)]
    log = spark.createDataFrame(
        [(i, 7, dt.datetime(2020, 1, 1, i), v) for i, v in rows], "log_id int, id int, t timestamp_ntz, v string"
    )
    kept = compaction.compact_log(log, "id", "log_id", "t", spans=3)
    assert sorted(r["log_id"] for r in kept.collect()) == [1, 2, 4, 5, 6]


def test_compaction_stats(account_log):
    marked = compaction.mark_repeats(account_log, *KEYS)
    assert compaction.compaction_stats(marked, "account_id").first().asDict() == {
        "entries_num": 1,
        "total_rows": 12,
        "deleted_rows": 8,
    }


def test_upsert_and_append(spark):
    stage = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 2)], "k int, v string, t int")
    order = [F.col("t").desc()]
    merged = load.upsert(stage, new, ["k"], order)
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 2)]
    assert sorted(map(tuple, load.upsert(merged, new, ["k"], order).collect())) == sorted(map(tuple, merged.collect()))
    assert load.upsert_counts(stage, new, ["k"]).first().asDict() == {"inserted": 1, "updated": 1}
    grown = load.append_new(stage, new, ["k"], order)
    assert sorted(map(tuple, grown.collect())) == [(1, "a", 1), (2, "b", 1), (3, "e", 2)]
    assert load.append_new(grown, new, ["k"], order).count() == 3


def test_before_images_skip_audit_columns(spark):
    layout = "k int, v string, modified_id int"
    old = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 1)], layout)
    new = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, "c", 1)], layout)
    assert [r["k"] for r in load.before_images(old, new, ["k"]).collect()] == [2]


def test_before_images_of_an_upsert_without_broadcasts(spark, tmp_path):
    """As with large tables: both sides of the upsert's union and the old rows come from exchanges, and plans adapt."""
    spark.range(1000).selectExpr("id AS k", "id AS v").write.parquet(f"{tmp_path}/old")
    spark.range(900, 1100).selectExpr("id AS k", "id + id % 2 AS v").write.parquet(f"{tmp_path}/delta")
    old, delta = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("old", "delta"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = load.upsert(old, delta.unionByName(delta), ["k"], ["v"])
        assert sorted(r.k for r in load.before_images(old, new, ["k"]).collect()) == list(range(901, 1000, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize(
    "last,now,due,start,end",
    [
        (None, "2011-10-31 10:20:00", True, "2011-10-30 10:30:00", "2011-10-31 10:30:00"),
        ("2011-10-31 10:30:00", "2011-10-31 12:29:59", False, "2011-10-31 09:30:00", "2011-10-31 12:30:00"),
        ("2011-10-31 10:30:00", "2011-10-31 14:29:00", True, "2011-10-31 09:30:00", "2011-10-31 12:30:00"),
        ("2011-10-31 10:30:00", "2011-10-31 14:31:00", True, "2011-10-31 09:30:00", "2011-10-31 14:30:00"),
        ("2011-10-31 00:14:00", "2011-10-31 02:20:00", True, "2011-10-30 00:00:00", "2011-10-31 02:00:00"),
        ("2011-10-31 01:10:00", "2011-10-31 09:00:00", True, "2011-10-30 01:00:00", "2011-10-31 09:00:00"),
    ],
)
def test_delta_window(spark, last, now, due, start, end):
    row = spark.createDataFrame([(last, now)], "l string, n string").select(
        F.col("l").cast("timestamp_ntz").alias("l"), F.col("n").cast("timestamp_ntz").alias("n")
    )
    got = row.select(*[c.alias(k) for k, c in ledger.delta_window("l", "n").items()]).first()
    assert (got["is_due"], str(got["start"]), str(got["end"])) == (due, start, end)


def test_appended_rows_line(spark):
    at = [dt.datetime(2011, 11, 12, h) for h in range(3)]
    entries = spark.createDataFrame(
        [(5, "t1", "DELTA", 1, 1, at[0], at[1], 1410, 70), (5, "t2", "DELTA", 1, 1, at[0], at[1], 25, 9),
         (5, "t3", "DELTA", 0, 0, at[0], at[1], 7, 7), (4, "t1", "DELTA", 1, 1, at[0], at[1], 9, 9)],
        "download_num int, src_table_name string, control_type string, download_status int, append_status int, "
        "control_start_dtm timestamp_ntz, control_end_dtm timestamp_ntz, proc_rows long, proc_duration long",
    )
    rows = [("t1", at[1])] * 1200 + [("t2", at[0])] * 31 + [("t2", at[2])] * 9
    stage = spark.createDataFrame(rows, "src_table_name string, dtm timestamp_ntz")
    line = ledger.appended_rows(entries, stage).first()
    assert line["summary"] == "Download # 5; Rows= 1,435; Duration= 79 sec; Appended Rows= 1,231"


def test_sources_are_validated_and_made_loadable(spark):
    layout = "table_schema string, table_name string, column_name string, column_key string, ordinal_position int"
    columns = spark.createDataFrame(
        [
            ("a", "item", "item_id", "PRI", 1), ("a", "item", "modified_dtm", "", 2), ("a", "item", "account_id", "", 3),
            ("a", "item_log", "item_log_id", "PRI", 1), ("a", "item_log", "item_id", "", 2), ("a", "item_log", "log_created_dtm", "", 3),
            ("a", "plain", "x", "", 1), ("a", "odd_log", "odd_log_id", "PRI", 1),
        ],
        layout,
    )
    profiles = spark.createDataFrame([(1, "db2", "01", 1), (2, "db2", "02", 0)], "shard_profile_id int, host_alias string, shard_number string, status int")
    sources = registry.register_sources(columns, profiles, "db2", F.lit(True))
    got = {r["src_table_name"]: r for r in sources.collect()}
    assert got["item"]["proc_block_size"] == 100_000 and got["item"]["sharding_column_name"] == "account_id"
    assert got["item_log"]["proc_pk_column_name"] == "item_id" and got["item_log"]["src_table_alias"] == "il"
    assert got["plain"]["proc_block_size"] == -1 and got["plain"]["proc_pk_column_name"] == "x"
    checked = registry.validate_sources(sources, columns.where("table_name <> 'odd_log'"), "db2")
    notes = {r["src_table_name"]: (r["src_table_valid_status"], r["comments"]) for r in checked.collect()}
    assert notes["item"] == notes["item_log"] == (1, None)
    assert notes["plain"] == (1, f"{registry.NO_DTM}; {registry.NO_PK}")
    assert notes["odd_log"] == (0, "The table odd_log has been removed from the schema")
    modes = {r["src_table_name"]: r for r in registry.choose_load_mode(checked).collect()}
    assert modes["plain"]["proc_block_size"] == -1 and modes["odd_log"]["src_table_valid_status"] == 1


def test_equal_schemas_need_no_action(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    here = schema_diff.schema_columns(df, "s", "t")
    assert schema_diff.column_actions(here, here, "db_stage").count() == 0
    there = schema_diff.schema_columns(df.withColumn("id", F.col("id").cast("long")).drop("name"), "s", "t")
    got = {r["statement"] for r in schema_diff.column_actions(here, there, "db_stage").collect()}
    assert got == {
        "ALTER TABLE db_stage.t DROP COLUMN id INT NULL",
        "ALTER TABLE db_stage.t ADD COLUMN id BIGINT NULL",
        "ALTER TABLE db_stage.t DROP COLUMN name STRING NULL",
    }
    changed = schema_diff.changed_columns(schema_diff.column_actions(here, there, "db_stage")).collect()
    assert [(r["column_name"], r["old_type"], r["new_type"]) for r in changed] == [("id", "int", "bigint")]


def test_accounts_ingest_masks(spark):
    requests = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 2), (3, 0, 1), (4, 1, 3), (5, 1, 8), (6, 1, 0)],
        "account_id int, fulfillment_type_mask int, account_type_mask int",
    )
    types = spark.createDataFrame([("CP", 1), ("VD", 2), ("ICE", 4)], "account_type_code string, account_type_bit int")
    kinds = spark.createDataFrame([(1, "CATALOG_SHARD"), (2, "OMS_SHARD")], "shard_type_id int, shard_type_name string")
    rows = [(3, 1, 1), (5, 1, 1), (9, 0, 1), (7, 1, 2), (8, 0, 2)]
    shard_list = spark.createDataFrame(rows, "shard_index int, shard_status int, shard_type_id int")
    at = dt.datetime(2020, 1, 1)
    good, vendors, bad = accounts.ingest_accounts(requests, types, shard_list, kinds, 42, at)
    assert sorted(r["account_id"] for r in good.collect()) == [1, 2]
    assert [r["account_id"] for r in vendors.collect()] == [2]
    placed = vendors.first()
    assert placed["catalog_shard_index"] in (3, 5) and placed["oms_shard_index"] == 7
    assert {(r["modified_id"], r["created_dtm"]) for r in [placed, *good.collect()]} == {(42, at)}
    assert {(r["account_id"], r["error_code"]) for r in bad.collect()} == {(3, -3), (4, -3), (5, -3), (6, -3)}


def test_jdbc_options():
    options = shards.jdbc_options("item", "jdbc:mysql://host/db", "item_id", (0, 900), 9)
    assert options["partitionColumn"] == "item_id" and options["numPartitions"] == "9"
    assert "partitionColumn" not in shards.jdbc_options("item", "u", None, None, 1)


def test_report_file_is_quoted(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame([(1, 'a "b"', None)], "id int, t string, n string").coalesce(1), path)
    text = next((tmp_path / "report").glob("part-*.csv")).read_text()
    assert text == '"id","t","n"\n"1","a ""b""","NULL"\n'


def test_promote_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "final")
    sinks.promote(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    sinks.promote(spark.createDataFrame([(3, "b")], "v int, p string"), path, "p")
    assert sorted((r["v"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_bucketed_tables_join_without_shuffle(spark):
    for name in ("left_items", "right_items"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        sinks.write_bucketed(spark.range(1000).withColumnRenamed("id", "item_id"), name, 4, "item_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_items").join(spark.table("right_items"), "item_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


@pytest.mark.parametrize("ignore_known", [False, True])
def test_stream_takes_new_files_once(spark, tmp_path, ignore_known):
    source, stage, progress = (str(tmp_path / n) for n in ("in", "stage", "progress"))
    layout = "k int, v string, t int"
    schema = spark.createDataFrame([], layout).schema

    def newest():
        return [F.col("t").desc()]

    def rows(df):
        return sorted(map(tuple, df.collect()))

    def take():
        return rows(delta.merge_files(spark, source, schema, stage, progress, ["k"], newest, ignore_known))

    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "old", 0)], layout).write.parquet(source)
    assert take() == [(1, "a", 1), (2, "b", 1)]
    spark.createDataFrame([(2, "c", 2), (3, "d", 2)], layout).write.mode("append").parquet(source)
    merged = [(1, "a", 1), (2, "b", 1) if ignore_known else (2, "c", 2), (3, "d", 2)]
    assert take() == merged
    # a replayed batch replaces itself
    again = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], layout)
    delta.write_batch(stage, ["k"], newest)(again, 1)
    assert take() == merged
    delta.fold(spark, stage, schema, ["k"], ignore_known)
    assert take() == merged
    spark.createDataFrame([(3, "e", 3), (4, "f", 3)], layout).write.mode("append").parquet(source)
    assert take() == merged[:2] + [(3, "d", 2) if ignore_known else (3, "e", 3), (4, "f", 3)]


def test_rate_windows_on_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a", m) for m in (1, 14, 15, 40)]
    events = spark.createDataFrame(rows, "ts timestamp, kind string, n int")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    windows = delta.rate_windows(stream, "ts", "15 minutes", "1 hour", ["kind"], "n")
    query = (
        windows.writeStream.outputMode("complete").format("memory").queryName("rates")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r["start_time"].minute, r["events"], r["total"]) for r in spark.table("rates").collect()}
    assert got == {(0, 2, 15), (15, 1, 15), (30, 1, 40)}


def test_one_edit_of_an_account_counts(spark):
    layout = "account_id int, account_name string, account_email_addr string, account_web_domain string, account_status int, modified_id int"
    old = spark.createDataFrame([(1, "a", "m", "w", 1, 0), (2, "b", "m", "w", 1, 0)], layout)
    vendors = spark.createDataFrame([(1, 1), (2, 1)], "account_id int, fulfillment_type_mask int")
    edits = spark.createDataFrame(
        [(1, "x", 2, 1), (1, "y", 3, 2), (2, None, 0, 3)], "account_id int, account_name string, fulfillment_type_mask int, at int"
    )
    changed, sellers, rejected = accounts.edit_accounts(old, vendors, edits, 9, edit_order="at")
    assert sorted((r["account_id"], r["account_name"], r["modified_id"]) for r in changed.collect()) == [(1, "y", 9), (2, "b", 0)]
    assert sorted(map(tuple, sellers.collect())) == [(1, 3), (2, 1)]
    assert [r["account_id"] for r in rejected.collect()] == [2]
    with pytest.raises(Exception, match="several edits of account 1"):
        accounts.edit_accounts(old, vendors, edits, 9)[0].collect()
