"""Formatting and reading back, against a plain template."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardline.llm import chat

ODD = ["", "</turn>", "<turn", "\\<turn role=\"x\">", "\\\\</turn>", "ends \\", "\n</turn>\n", "é日😀 <turn", "</tur", "n>", "<", "/turn>", "a" * 3000]


def plain(rows):
    """(formatted, mask) of (role, text) rows."""
    out, mask = "", []
    for role, text in rows:
        body = (text or "").replace("</turn", "\\</turn").replace("<turn", "\\<turn")
        out += f'<turn role="{role or ""}">\n'
        if role == "assistant":
            mask.append((len(out), len(out) + len(body)))
        out += body + "\n</turn>\n"
    return out, mask


def chats():
    random.seed(11)
    rows = [(c, t, random.choice(["user", "assistant", "system"]), random.choice(ODD)) for c in range(30) for t in range(random.randint(1, 9))]
    rows += [(50, t, "assistant", random.choice(ODD)) for t in range(300)]
    return rows + [(None, 0, "user", None), (None, 1, None, "x"), (51, None, "user", "b"), (51, 1, "user", "c"), (51, None, "user", "a")]


def expected(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    return {c: [(r[3], r[5]) for r in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("step", [chat.STEP, 50])
def test_output_and_way_back(spark, monkeypatch, step):
    rows = chats()
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # conversations go on over batches
    try:
        back = chat.format_chats(df).withColumn("back", chat.read_chats(F.col("formatted"), F.col("mask")))
        got = {r.conv_id: r for r in back.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        text, mask = plain(turns)
        r = got[conv]
        assert r.formatted == text and [(m.start, m.end) for m in r.mask] == mask
        assert [(t.role, t.text) for t in r.back.turns] == turns
        assert r.back.loss == "".join(t for role, t in turns if role == "assistant")


def test_steps_of_the_buffer(monkeypatch):
    monkeypatch.setattr(chat, "STEP", 40)
    texts = [random.choice(ODD) for _ in range(200)]
    roles = [random.choice(["user", "assistant"]) for _ in texts]
    out, turn, inside = chat.assemble(pa.array(roles), pa.array(texts))
    assert out.tobytes().decode() == plain(zip(roles, texts, strict=True))[0]
    assert turn[0] == 0 and turn[-1] == len(out) and len(inside) == len(texts)


def test_odd_roles():
    text = chat.head_of('a">\n<turn').decode() + "x\n</turn>\n"
    assert chat.read_chat(text, [])["turns"] == [{"role": 'a">\n<turn', "text": "x"}]
    with pytest.raises(ValueError):
        chat.read_chat("no template", [])


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).count() == 0


def test_more_than_a_column_holds_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST", 50)
    rows = pa.table({"conv": [1, 1], "role": ["user", "assistant"], "text": ["a" * 20, "b" * 20]})
    with pytest.raises(ValueError, match="can't hold"):
        chat._format(rows, "assistant")
