"""The operators on their whole tables: one query each, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shardline.llm import alignment, bpe, langid, pii, secret_scan, whitening
from shardline.llm.ann import nearest
from shardline.llm.batches import bounded_batches
from shardline.llm.chat import format_chats, read_chats
from shardline.llm.decontaminate import contamination
from shardline.llm.sharding import ring_shards
from shardline.llm.simhash import near_duplicates
from shardline.llm.suffix_dedup import remove_repeats
from shardline.llm.warc import records, write_archive
from shardline.session import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{folder}/{name}.parquet")


@query("op1_ring_shards")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Documents on a ring of 8 shards; a null text has size 1 and the checksum of no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return ring_shards(docs, "doc_id", ["size", "text_crc32"], shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )


@query(
    "op2_warc_archive",
    """
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    d AS (
        SELECT page_id, url, html, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               list_transform(range(0, 40), lambda i: CAST('0x' || substr(sha1(html), CAST(i + 1 AS INT), 1) AS INT)) AS h
        FROM p),
    b AS (
        SELECT page_id, url, html, payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
                   ((h[5 * i // 4 + 1] * 16 + coalesce(h[5 * i // 4 + 2], 0)) // CAST(pow(2, 3 - (5 * i) % 4) AS INT)) % 32
                   AS INT), 1)), 'string_agg', '') AS payload_digest
        FROM d),
    m AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
    r AS (
        SELECT page_id, url, html, payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to,
               concat_ws(chr(13) || chr(10), 'HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8',
                         'Content-Length: ' || payload_bytes, '', CASE WHEN page_id = first THEN html ELSE '' END) AS block
        FROM b JOIN m USING (html)),
    w AS (
        SELECT *, concat_ws(chr(13) || chr(10),
            'WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: <urn:page:' || page_id || '>',
            'WARC-Date: 1970-01-01T00:00:00Z',
            'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A'),
            'WARC-Payload-Digest: sha1:' || payload_digest,
            CASE WHEN refers_to IS NOT NULL THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
            'WARC-Refers-To: <urn:page:' || refers_to || '>',
            'Content-Type: application/http; msgtype=response', 'Content-Length: ' || strlen(block), '', block, '', '') AS record
        FROM r)
    SELECT page_id, payload_bytes, payload_digest, record_type, refers_to,
           CAST(strlen(record) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256
    FROM w
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as an archive in the shared folder and read back, with each original record put together again."""
    path = scratch_path(spark, "archive")
    write_archive(table(spark, folder, "pages"), path)
    return records(spark, path).select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        F.octet_length("record").cast("long").alias("record_bytes"),
        F.sha2("record", 256).alias("record_sha256"),
    )


_WORDS = """regexp_extract_all(
    translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


@query(
    "op3_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
    i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
    seen AS (
        SELECT s.doc_id, s.p, x.n, x.item_id
        FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words
              FROM starts, (SELECT DISTINCT n FROM windows) WHERE p + n - 1 <= len(w)) s
        JOIN windows x ON x.n = s.n AND x.words = s.words),
    hits AS (
        SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM seen) GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM seen) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of 13 words in whole documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        "found.contaminated",
    )


@query("op4_word_bpe")
def op4(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """Ids of whole texts and the text that they decode to; ``path`` names the tokenizer file."""
    packed = bpe.load(path or public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", bpe.round_trip(F.col("text"), packed).alias("b")).select(
        "doc_id",
        F.size("b.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("b.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("b.decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op8_chat_format",
    r"""
    WITH t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('<turn role="' || role || '">..</turn>.') + length(text) + len(regexp_extract_all(text, '</?turn')))
               AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations, and one that holds the template's own strings, formatted and read back."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.sql(
        "SELECT -7L AS conv_id, turn, if(turn = 0, 'user', 'assistant') AS role, :text AS text FROM (SELECT explode(array(0L, 1L)) AS turn)",
        args={"text": text},
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = format_chats(turns).withColumn("back", read_chats(F.col("formatted"), F.col("mask")))
    each = F.transform("back.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("back.turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("back.loss").cast("long").alias("loss_chars"),
        F.sha2("back.loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_simhash_anchors")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their fingerprint and component at two bits."""
    found = near_duplicates(table(spark, folder, "documents"), "doc_id", "text", bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by a network fitted on documents outside the held-out quarter."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out("doc_id")
    model = langid.train(docs.filter(~held_out))
    return docs.select(
        "doc_id", held_out.alias("held_out"), langid.predict(F.col("text"), model).alias("found")
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


@query("op7_secret_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in whole documents: counts and digest of the patterns' spans, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = secret_scan.train(docs)
    found = docs.select("doc_id", secret_scan.find_secrets(F.col("text"), field).alias("found"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, secret_scan.BASE),
        F.sha2(told(F.filter("found", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
    )


@query("op6_posting_lists")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, from posting lists over all vectors."""
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op9_suffix_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of whole documents outside strings of 200 bytes that occur more than once."""
    found = remove_repeats(table(spark, folder, "documents"), "doc_id", "text", length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_exact_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each vector and component: the vector's whitened coordinate, and figures of the fit.

    Vectors that are null or hold null or non-finite entries are left out. No rows if all vectors are equal. A
    deviation that a long can't hold is null.
    """
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, F.col("embedding"), scale=64.0, most=32)
    if model is None:
        model = whitening.Whitening.nothing()
    found = rows.select("vec_id", whitening.apply(F.col("embedding"), model).alias("f")).filter("f IS NOT NULL")
    each = found.select("vec_id", "f.deviation", F.posexplode("f.whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        "whitened",
        F.get(shares, "at").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query("op13_pair_bitmaps")
def op13(spark: SparkSession, folder: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, weighed by the corpus; ``a`` and ``b`` name the files."""
    index = alignment.index_pairs(
        table(spark, folder, "documents"),
        "doc_id",
        "text",
        alignment.load(a or public_tokenizers.path("byte_bpe_50k.json")),
        alignment.load(b or public_tokenizers.path("piece_bpe_32k.model")),
    )
    counts = cut_lineage(alignment.pair_counts(index), "counts")
    found = alignment.document_scores(index, counts)
    return found.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query("op12_disclosing_terms")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in whole documents: counts and digest of the patterns' spans, all spans, and the text without them."""
    found = pii.sanitise(table(spark, folder, "documents").select("doc_id", "text"), "text")

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, pii.BASE),
        F.sha2(told(F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )
