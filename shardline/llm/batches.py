"""Arrow batches bounded in bytes, so that a worker's memory doesn't grow with the length of texts."""

from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Limit what a Python worker gets at a time; one larger row is still a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def unused(columns: list[str], name: str) -> str:
    """``name``, longer by as many underscores as it takes to be none of the columns (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
