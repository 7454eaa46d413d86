"""Ids and decoded text against the tokenizers library."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.tokenizer(bpe.load(PATH))


def texts():
    random.seed(2)
    kinds = ["ab", "abc", "aAsS' ", "etaoinshrdlu ", "0123 a", "éèßüñ aó", "ΣΟΔΑΣ σ", "!?.,-_ a", "日本語 한국", "😀👍🏽 x", "ᲉꟋ a"]
    out = ["".join(random.choice(k) for _ in range(random.randint(0, 40))) for k in kinds * 60]
    out += ["<|endoftext|>", "x<|startoftext|>y <|endoftext|>", "it's we'll I'd 'S", " \t  \n", "a" * 5000]
    return out


def test_ids_equal_the_library(ours, theirs):
    for t in texts():
        assert ours.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)


def test_single_characters(ours, theirs):
    for c in range(0, 0x110000, 37):
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}b {chr(c)}"
            assert ours.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids, hex(c)


def test_forgetting_changes_nothing(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 7)
    small = bpe.tokenizer.__wrapped__(bpe.load(PATH))
    for t in texts()[:200]:
        assert small.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_columns(spark, theirs):
    rows = [None, "", "Hello <|endoftext|> World's end é", " ", "b" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, ids string")
    packed = bpe.load(PATH)
    got = df.select("doc_id", bpe.encode(F.col("text"), packed).alias("e"), bpe.round_trip(F.col("text"), packed).alias("b"))
    got = got.withColumn("d", bpe.decode(F.col("e"), packed)).orderBy("doc_id").collect()
    for r, t in zip(got, rows, strict=True):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert r.e == ids == r.b.ids
        assert r.d == r.b.decoded == theirs.decode(ids, skip_special_tokens=False)
    assert df.limit(0).select(bpe.encode(F.col("text"), packed)).count() == 0


def test_decode_of_unknown_and_null(spark):
    df = spark.createDataFrame([([5, 60000, -1, None, 6],), (None,), ([],)], "ids array<int>")
    assert [r.d for r in df.select(bpe.decode(F.col("ids"), bpe.load(PATH)).alias("d")).collect()] == ["& '", "", ""]
