"""A corpus made ready for training: each stage takes the documents that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shardline.llm import bpe, langid, secret_scan
from shardline.llm.batches import bounded_batches, unused
from shardline.llm.decontaminate import contamination
from shardline.llm.simhash import keep_one
from shardline.session import cut_lineage

#: The fitted stages have no SQL.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those without text or letters. A doubtful language is no reason.

    Null, empty and letterless texts go, very long ones are read whole; repeated rows are judged alike and all stay. An empty
    table stays empty. Columns come back as they are, whatever their names.
    """
    bounded_batches(spark)
    model = langid.train(docs.filter(~langid.held_out("doc_id")))
    if not model.langs:  # nothing to learn from
        return docs.filter(langid.has_letter(F.col("text")))
    name = unused(docs.columns, "found")
    found = docs.withColumn(name, langid.predict(F.col("text"), model))
    kept = found.filter(F.col(name)["lang"] != langid.UNKNOWN)
    return kept.select(*(f"`{c}`" for c in docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays.

    Null and wordless texts have fingerprint zero and link like any other; repeated rows leave one, and so does a group
    without ids. An empty table stays empty. Columns come back as they are, whatever their names.
    """
    bounded_batches(spark)
    return keep_one(docs, "doc_id", "text", bits=2).select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Null and empty texts hold none and stay, very long ones are searched whole; repeated rows are judged alike. Without documents or items
    nothing goes. Columns come back as they are, whatever their names.
    """
    items = bounded_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    name = unused(docs.columns, "found")
    found = contamination(docs, items, into=name)
    return found.filter(~F.col(name)["contaminated"]).select(*(f"`{c}`" for c in docs.columns))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay.

    Null and empty texts hold none and a null one stays null, very long ones are searched whole; repeated rows change alike. An empty table
    stays empty. ``n_chars``, where there is one, is counted again; other columns come back as they are, whatever their names.
    """
    bounded_batches(spark)
    field = secret_scan.train(docs)
    spans = secret_scan.find_secrets(F.col("text"), field)
    name = unused(docs.columns, "spans")
    out = docs.withColumn(name, spans).withColumn("text", secret_scan.redact(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of them and of the text that they decode to.

    Null texts are empty and have no ids, very long ones are encoded whole; repeated rows have a row each. An empty table gives
    an empty one. Columns other than the id are left out, so their names can't clash.
    """
    bounded_batches(spark)
    packed = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    return docs.select("doc_id", bpe.round_trip(F.col("text"), packed).alias("b")).select(
        "doc_id",
        F.col("b.ids").alias("ids"),
        F.size("b.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("b.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("b.decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", hide_secrets),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
