"""Incremental forms: delta files merged into a stage, and windowed rates.

A batch only writes its own rows (``changes/batch=N``), so its cost follows the delta, not
the stage. Reading puts the changes over the newest base; ``fold`` writes a new base
(``base/upto=N``) now and then. Writing batch N again replaces it, so a replay is harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shardline.elt.load import append_new, upsert
from shardline.operators.ordered import latest


def finished(spark: SparkSession, folder: str, label: str) -> list[int]:
    """Numbers of the completely written ``label=N`` folders, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [status.getPath().getName() for status in files.listStatus(root)]
    done = [n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{label}="))


def write_batch(path: str, keys: Sequence[str], order: Callable[[], Sequence[Column]]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: one row per key of the batch, written beside the others."""

    def run(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order()).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    return run


def read_stage(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], ignore_known: bool = False
) -> DataFrame:
    """The stage as of the last batch: later batches win, or earlier ones with ``ignore_known``."""
    bases = finished(spark, f"{path}/base", "upto")
    upto = bases[-1] if bases else -1
    base = spark.read.schema(schema).parquet(f"{path}/base/upto={upto}") if bases else spark.createDataFrame([], schema)
    batches = [n for n in finished(spark, f"{path}/changes", "batch") if n > upto]
    if not batches:
        return base
    layout = StructType([*schema.fields, StructField("batch", IntegerType())])
    paths = [f"{path}/changes/batch={n}" for n in batches]
    changes = spark.read.schema(layout).option("basePath", f"{path}/changes").parquet(*paths)
    merge = append_new if ignore_known else upsert
    return merge(base, changes, keys, [F.col("batch").asc() if ignore_known else F.col("batch").desc()])


def start_stage(stage: DataFrame, path: str) -> None:
    """Make the rows, one for each key, the base that later batches are put over."""
    stage.write.mode("overwrite").parquet(f"{path}/base/upto=-1")


def unfolded(spark: SparkSession, path: str, schema: StructType) -> tuple[int, int]:
    """Rows of the newest base, and of the batches since; counted from the files' footers."""
    bases = finished(spark, f"{path}/base", "upto")
    upto = bases[-1] if bases else -1
    base = spark.read.schema(schema).parquet(f"{path}/base/upto={upto}").count() if bases else 0
    paths = [f"{path}/changes/batch={n}" for n in finished(spark, f"{path}/changes", "batch") if n > upto]
    return base, spark.read.schema(schema).parquet(*paths).count() if paths else 0


def fold(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], ignore_known: bool = False
) -> None:
    """Write the stage as a new base; the old base and the folded batches are no longer read."""
    batches = finished(spark, f"{path}/changes", "batch")
    if batches and batches[-1] not in finished(spark, f"{path}/base", "upto"):
        stage = read_stage(spark, path, schema, keys, ignore_known)
        stage.write.mode("overwrite").parquet(f"{path}/base/upto={batches[-1]}")


def merge_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    path: str,
    progress: str,
    keys: Sequence[str],
    order: Callable[[], Sequence[Column]],
    ignore_known: bool = False,
    file_filter: str | None = None,
    fold_share: float = 0.5,
) -> DataFrame:
    """Take in all new files below ``source`` and return the stage after them.

    When the batches since the base hold more than ``fold_share`` of its rows they are folded in, so that reading
    the stage never costs much more than its base.
    """
    reader = spark.readStream.schema(schema)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(write_batch(path, keys, order))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    based, waiting = unfolded(spark, path, schema)
    if waiting > fold_share * based:
        fold(spark, path, schema, keys, ignore_known)
    return read_stage(spark, path, schema, keys, ignore_known)


def rate_windows(events: DataFrame, ts: str, size: str, late: str, keys: Sequence[str], measure: str) -> DataFrame:
    """Event count, sum and maximum per time window and key; works on batch and stream."""
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    return (
        stamped.groupBy(F.window(ts, size).alias("_w"), *keys)
        .agg(F.count("*").alias("events"), F.sum(measure).alias("total"), F.max(measure).alias("peak"))
        .select(F.col("_w.start").alias("start_time"), *keys, "events", "total", "peak")
    )
