"""The load from ledger to stage, run after run, against plain bookkeeping."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shardline.elt import incremental, registry
from shardline.streaming import delta

T1, T2, T3 = dt.datetime(2024, 3, 5, 10), dt.datetime(2024, 3, 5, 16), dt.datetime(2024, 3, 6, 12)
WHOLE, PLAIN, BLOCKS = registry.WHOLE_TABLE, registry.NO_BLOCKS, 3


def sources(spark, override=dt.datetime(2000, 1, 1)):
    rows = [
        (i, "db2", shard, shard, "db", name, "dtm" if size != WHOLE else None, "id", size, 1, 1, override)
        for i, (name, size) in enumerate((("codes", WHOLE), ("plain", PLAIN), ("sales", BLOCKS)), 1)
        for shard in (1, 2)
    ]
    return spark.createDataFrame(
        rows,
        "src_table_id long, host_alias string, shard_number int, shard_profile_id int, src_schema_name string, src_table_name string,"
        "dtm_column_name string, proc_pk_column_name string, proc_block_size int, src_table_load_status int, src_table_valid_status int,"
        "override_dtm timestamp_ntz",
    )


def profiles(spark, active=(1, 2)):
    return spark.createDataFrame(
        [(i, "accounts", int(i in active)) for i in (1, 2)], "shard_profile_id int, shard_table_name string, status int"
    )


class Remote:
    """Link tables by name and shard, as plain rows (id, dtm, v), and how often each was read."""

    def __init__(self, spark, **tables):
        self.spark, self.tables, self.reads = spark, tables, []

    def __call__(self, name, shard):
        self.reads.append((name, shard))
        rows = self.tables.get(name, {}).get(shard, [])
        if rows == "broken":
            raise OSError("the link is down")
        return self.spark.createDataFrame(rows, "id int, dtm timestamp_ntz, v string")


def rows(stage, name, keys=("id",)):
    return sorted((r.shard_number, r.id, r.v) for r in stage.table(name, list(keys)).collect())


def entries(stage):
    return sorted(
        (r.download_num, r.src_table_name, r.shard_number, r.download_status, r.append_status, r.proc_rows)
        for r in stage.ledger().collect()
    )


def at(hours, day=5):
    return dt.datetime(2024, 3, day) + dt.timedelta(hours=hours)


def test_two_downloads_with_a_broken_one_between(spark, tmp_path):
    stage = incremental.Stage(spark, str(tmp_path / "stage"))
    assert entries(stage) == [] and stage.state() == incremental.State()
    link = Remote(
        spark,
        codes={1: [(1, None, "a"), (1, None, "a")], 2: [(7, None, "z")]},
        plain={1: [(1, at(1), "old"), (1, at(2), "new"), (2, at(11), "later")], 2: []},
        sales={1: [(i, at(i % 9), f"s{i}") for i in range(10)], 2: "broken"},
    )
    with pytest.raises(OSError, match="down"):
        incremental.run_load(stage, sources(spark), profiles(spark), link, T1)
    half = [(1, "codes", 1, 1, 1, 2), (1, "codes", 2, 1, 1, 1), (1, "plain", 1, 1, 1, 1), (1, "plain", 2, 1, 1, 0)]
    assert entries(stage) == [*half, (1, "sales", 1, 0, 0, 0), (1, "sales", 2, 0, 0, 0)]
    assert rows(stage, "plain") == [(1, 1, "new")] and rows(stage, "codes") == [(1, 1, "a"), (1, 1, "a"), (2, 7, "z")]

    link.tables["sales"][2], link.reads = [(3, at(3), "other shard")], []
    incremental.run_load(stage, sources(spark), profiles(spark), link, T1 + dt.timedelta(minutes=30))
    assert link.reads == [("sales", 1), ("sales", 2)]  # nothing twice
    assert entries(stage) == [*half, (1, "sales", 1, 1, 1, 10), (1, "sales", 2, 1, 1, 1)]

    done, link.reads = stage.state(), []
    assert incremental.run_load(stage, sources(spark), profiles(spark), link, T1 + dt.timedelta(minutes=90)) == done
    assert link.reads == []  # the next window isn't due

    link.tables["codes"][1] = [(9, None, "all new")]
    link.tables["sales"] = {1: [(3, at(15), "changed"), (99, at(9.5), "late"), (4, at(2), "outside")], 2: []}
    incremental.run_load(stage, sources(spark, None), profiles(spark), link, T2)
    assert rows(stage, "codes") == [(1, 9, "all new"), (2, 7, "z")]
    sold = {(1, i): f"s{i}" for i in range(10)} | {(1, 3): "changed", (1, 99): "late", (2, 3): "other shard"}
    assert rows(stage, "sales") == sorted((*k, v) for k, v in sold.items())
    assert entries(stage)[6:] == [
        (2, "codes", 1, 1, 1, 1), (2, "codes", 2, 1, 1, 1), (2, "plain", 1, 1, 1, 1), (2, "plain", 2, 1, 1, 0),
        (2, "sales", 1, 1, 1, 2), (2, "sales", 2, 1, 1, 0),
    ]
    # an earlier state reads as it was
    assert (1, 3, "s3") in sorted((r.shard_number, r.id, r.v) for r in stage.table("sales", ["id"], done).collect())
    # a shard that is switched off keeps its rows
    incremental.run_load(stage, sources(spark, None), profiles(spark, active=(1,)), link, T3)
    assert rows(stage, "codes") == [(1, 9, "all new"), (2, 7, "z")]


def test_a_commit_that_did_not_finish_is_not_read(spark, tmp_path):
    stage = incremental.Stage(spark, str(tmp_path / "stage"))
    link = Remote(spark, sales={1: [(1, at(1), "a")]})
    state = incremental.run_load(stage, sources(spark), profiles(spark), link, T1)
    lost = tmp_path / "stage" / "commits" / f"version={state.version + 1}"
    lost.mkdir()
    (lost / "part-0.parquet").write_bytes(b"half")
    assert stage.state() == state and rows(stage, "sales") == [(1, 1, "a")]


def test_parts_are_folded_by_their_share(spark, tmp_path):
    stage = incremental.Stage(spark, str(tmp_path / "stage"), fold_share=0.5)
    now, want = T1, {}
    for turn in range(6):
        fresh = {i: (now - dt.timedelta(minutes=5), f"{turn}") for i in ([*range(20)] if not turn else [turn, 100 + turn, 50, 51])}
        want |= {i: v for i, (_, v) in fresh.items()}
        link = Remote(spark, sales={1: [(i, t, v) for i, (t, v) in fresh.items()]})
        incremental.run_load(stage, sources(spark, None), profiles(spark), link, now)
        parts = stage.state().tables["sales"]
        assert sum(p.rows for p in parts[1:]) <= 0.5 * parts[0].rows
        now += dt.timedelta(hours=4)
    assert len(parts) < 6 and rows(stage, "sales") == sorted((1, i, v) for i, v in want.items())


def test_stream_over_a_stage_reads_few_files(spark, tmp_path):
    path, schema = str(tmp_path / "stage"), "id int, v string"
    base = spark.createDataFrame([(i, "base") for i in range(100)], schema)
    delta.start_stage(base, path)
    want = {i: "base" for i in range(100)}
    for turn in range(5):
        new = {i: f"{turn}" for i in range(turn * 10, turn * 10 + 30)}
        want |= new
        spark.createDataFrame(list(new.items()), schema).write.parquet(str(tmp_path / "in" / f"{turn}"))
        got = delta.merge_files(
            spark, str(tmp_path / "in" / "*"), base.schema, path, str(tmp_path / "progress"), ["id"], lambda: [F.col("v").desc()]
        )
        assert dict(map(tuple, got.collect())) == want
        based, waiting = delta.unfolded(spark, path, base.schema)
        assert based >= 100 and waiting <= 0.5 * based
