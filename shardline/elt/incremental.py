"""The incremental load as one resumable operation: ledger, link rows, stage.

State is a manifest of Parquet snapshots. A step writes its snapshots beside the others and then one commit that
names all current ones; only commits that Spark finished are read, so a lost job leaves the state before its step. An
entry of the ledger goes from planned (``download_status`` 0) to loaded (1, with its rows in the stage) in one commit:
a run that stops between tables is taken up again at the first planned entry, and none is loaded twice.

A commit writes only the rows loaded, as one more part of the table. Reading puts later parts over earlier ones;
when the parts hold more than a share of the base's rows they are folded into a new base. One load writes at a time.
"""

from __future__ import annotations

import datetime as dt
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardline.elt.ledger import DELTA, close_processed, delta_window, last_end, next_entries, unfinished
from shardline.elt.load import in_window, upsert
from shardline.elt.registry import WHOLE_TABLE
from shardline.operators.ordered import latest
from shardline.streaming.delta import finished

LEDGER = """control_download_id long, download_num int, src_table_id long, host_alias string, shard_number int, src_schema_name string,
    src_table_name string, download_status int, append_status int, control_type string, control_start_dtm timestamp_ntz,
    control_end_dtm timestamp_ntz, proc_rows long, proc_duration long"""
MANIFEST = "name string, version long, path string, rows long, whole array<int>"


@dataclass(frozen=True)
class Part:
    """Rows of a table that one commit added; of the shards in ``whole`` nothing older counts."""

    version: int
    path: str
    rows: int
    whole: tuple[int, ...] = ()


@dataclass(frozen=True)
class State:
    """A committed version: where the ledger is, and the parts of every table, the base first."""

    version: int = 0
    ledger: str | None = None
    tables: dict[str, tuple[Part, ...]] = field(default_factory=dict)


class Stage:
    """Versions of ledger and tables below one folder."""

    def __init__(self, spark: SparkSession, path: str, fold_share: float = 0.5):
        self.spark, self.path, self.fold_share = spark, path, fold_share

    def state(self) -> State:
        """The newest finished commit; the manifest has a row for each part."""
        done = finished(self.spark, f"{self.path}/commits", "version")
        if not done:
            return State()
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/commits/version={done[-1]}").orderBy("version").collect()
        tables: dict[str, tuple[Part, ...]] = {}
        for r in rows:
            if r["name"]:
                part = Part(r["version"], r["path"], r["rows"], tuple(r["whole"]))
                tables[r["name"]] = (*tables.get(r["name"], ()), part)
        return State(done[-1], next(r["path"] for r in rows if not r["name"]), tables)

    def commit(self, state: State, ledger: DataFrame) -> State:
        """Make a state the current one, with the ledger written anew."""
        version = state.version + 1
        path = f"{self.path}/ledger/version={version}"
        ledger.write.mode("overwrite").parquet(path)
        rows = [("", version, path, 0, [])]
        rows += [(n, p.version, p.path, p.rows, list(p.whole)) for n, parts in state.tables.items() for p in parts]
        manifest = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")
        return replace(state, version=version, ledger=path)

    def ledger(self, state: State | None = None) -> DataFrame:
        state = state or self.state()
        reader = self.spark.read.schema(LEDGER)
        return reader.parquet(state.ledger) if state.ledger else self.spark.createDataFrame([], LEDGER)

    def table(self, name: str, keys: Sequence[str], state: State | None = None) -> DataFrame:
        """Rows of a table as of a state: of equal keys in a shard the part that came last counts."""
        return self._merged((state or self.state()).tables[name], keys)

    def _merged(self, parts: Sequence[Part], keys: Sequence[str]) -> DataFrame:
        frames = []
        for i, part in enumerate(parts):
            gone = sorted({s for later in parts[i + 1 :] for s in later.whole})
            rows = self.spark.read.parquet(part.path)
            frames.append((rows.where(~F.col("shard_number").isin(gone)) if gone else rows, part))
        base, *changes = frames
        if not changes:
            return base[0]
        changed = changes[0][0].withColumn("_part", F.lit(changes[0][1].version))
        for rows, part in changes[1:]:
            changed = changed.unionByName(rows.withColumn("_part", F.lit(part.version)))
        if any(part.whole for _, part in frames):  # copied as they are: keys may repeat
            return base[0].unionByName(changed.drop("_part"))
        return upsert(base[0], changed, ["shard_number", *keys], [F.col("_part").desc()])

    def add(self, state: State, name: str, rows: DataFrame, keys: Sequence[str], whole: Sequence[int]) -> tuple[State, DataFrame]:
        """The state with one more part (not committed), and the part as it was written."""
        version = state.version + 1
        path = f"{self.path}/parts/{name}/version={version}"
        rows.write.mode("overwrite").parquet(path)
        written = self.spark.read.parquet(path)
        parts = (*state.tables.get(name, ()), Part(version, path, written.count(), tuple(whole)))
        if len(parts) > 1 and sum(p.rows for p in parts[1:]) > self.fold_share * parts[0].rows:
            base = f"{self.path}/bases/{name}/version={version}"
            self._merged(parts, keys).write.mode("overwrite").parquet(base)
            folded = tuple(sorted({s for p in parts for s in p.whole}))
            parts = (Part(version, base, self.spark.read.parquet(base).count(), folded),)
        return replace(state, tables={**state.tables, name: parts}), written


def plan_download(stage: Stage, state: State, sources: DataFrame, profiles: DataFrame, now: dt.datetime) -> State | None:
    """Commit the entries of the next download, or None where the last end is too near."""
    ledger = stage.ledger(state)
    moments = stage.spark.range(1).select(last_end(ledger).alias("last"), F.lit(now).cast("timestamp_ntz").alias("now"))
    window = delta_window("last", "now")
    due = moments.select(window["is_due"].alias("due"), window["start"].alias("start"), window["end"].alias("end")).first()
    if not due["due"]:
        return None
    start, end = (F.lit(due[n]).cast("timestamp_ntz") for n in ("start", "end"))
    entries = next_entries(ledger, sources, profiles, start, end, DELTA)
    known = ledger.agg(F.coalesce(F.max("control_download_id"), F.lit(0))).first()[0]
    # one row for each registered source and shard
    number = F.expr("row_number() OVER (ORDER BY src_table_id, shard_number)") + F.lit(known)
    entries = entries.withColumn("control_download_id", number.cast("long"))
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in ledger.schema]
    typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in columns]
    return stage.commit(state, ledger.unionByName(entries.select(*typed)))


def link_rows(
    entries: Sequence, source, link: Callable[[str, int], DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Rows to load of one table: those of every entry's shard, in the mode that its source asks for.

    A source to be copied whole is read as it is. Others give the rows changed in their entry's window, one for each key and
    shard, the one changed last; with a block size they are dealt out in key ranges of about so many rows.
    """
    frames = []
    for e in entries:
        rows = link(e["src_table_name"], e["shard_number"]).withColumn("shard_number", F.lit(e["shard_number"]))
        if source["proc_block_size"] != WHOLE_TABLE:
            bounds = (F.lit(e[n]).cast("timestamp_ntz") for n in ("control_start_dtm", "control_end_dtm"))
            rows = in_window(rows, source["dtm_column_name"], *bounds)
        frames.append(rows)
    every = frames[0]
    for rows in frames[1:]:
        every = every.unionByName(rows)
    if source["proc_block_size"] == WHOLE_TABLE:
        return every
    newest = latest(every, ["shard_number", *keys], [F.col(source["dtm_column_name"]).desc()])
    if not source["proc_block_size"]:
        return newest
    blocks = math.ceil(every.count() / source["proc_block_size"])
    return newest.repartitionByRange(max(1, blocks), *keys)


def run_load(
    stage: Stage,
    sources: DataFrame,
    profiles: DataFrame,
    link: Callable[[str, int], DataFrame],
    now: dt.datetime,
    max_tables: int | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> State:
    """One run of the load at ``now``: finish what the last download left, or plan and load the next one.

    ``link`` gives the remote rows of a table and shard. ``sources`` are the registered ones with the load mode chosen for each
    (``proc_block_size``: whole copy, no blocks, or keys in a block) and the key in ``proc_pk_column_name``. Each
    table is one commit, so a run that ``max_tables`` or a failure ends early goes on where it stopped when called again. A run
    before the next window is due changes nothing.
    """
    state = stage.state()
    ledger = close_processed(stage.ledger(state))
    if unfinished(ledger).isEmpty():
        planned = plan_download(stage, state, sources, profiles, now)
        if planned is None:
            return state
        state = planned
        ledger = stage.ledger(state)
    open_ = unfinished(ledger).orderBy("src_table_name", "shard_number").collect()  # one for each source and shard
    facts = {s["src_table_name"]: s for s in sources.collect()}
    for name in list(dict.fromkeys(e["src_table_name"] for e in open_))[:max_tables]:
        began, entries, source = clock(), [e for e in open_ if e["src_table_name"] == name], facts[name]
        keys = [source["proc_pk_column_name"]]
        whole = [e["shard_number"] for e in entries] if source["proc_block_size"] == WHOLE_TABLE else []
        state, written = stage.add(state, name, link_rows(entries, source, link, keys), keys, whole)
        loaded = written.groupBy("shard_number").agg(F.count("*").alias("_rows"))
        here = (F.col("src_table_name") == name) & F.col("control_download_id").isin([e["control_download_id"] for e in entries])
        seconds = F.lit(max(1, math.ceil(clock() - began))).cast("long")
        ledger = close_processed(stage.ledger(state)).join(loaded, "shard_number", "left").withColumns(
            {
                "proc_rows": F.when(here, F.coalesce("_rows", F.lit(0))).otherwise(F.col("proc_rows")),
                "proc_duration": F.when(here, seconds).otherwise(F.col("proc_duration")),
                "download_status": F.when(here, 1).otherwise(F.col("download_status")),
                "append_status": F.when(here, 1).otherwise(F.col("append_status")),
            }
        )
        state = stage.commit(state, ledger.select(*stage.ledger(state).columns))
    return state
