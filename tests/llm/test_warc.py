"""Archives written and read back: kinds, digests, exact records, verification."""

import base64
import datetime as dt
import hashlib

import pytest

from shardline.llm.warc import export, records, write_archive

ROWS = [
    (1, "http://a/", "<p>same</p>"),
    (2, "http://b/", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (4, "http://c/\r\nX: y", "äöü €"),
    (5, "http://d/", ""),
    (6, "http://e/", None),
    (None, "http://f/", "lone"),
    (7, "http://g/", "WARC/1.1\r\n\r\n" * 3000),
    (8, "http://h/", "twice"),
    (8, "http://h/", "twice"),
]


def written(spark, tmp_path, rows, **kw):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    write_archive(df, str(tmp_path / "a"), **kw)
    return records(spark, str(tmp_path / "a"))


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_kinds_and_digests(spark, tmp_path):
    got = {(r.id, r.payload.decode(), r.record_type, r.refers_to) for r in written(spark, tmp_path, ROWS).collect()}
    same = "<p>same</p>"
    assert {x for x in got if x[1] == same} == {(1, same, "revisit", 9), (2, same, "revisit", 9), (9, same, "response", None)}
    assert {x for x in got if x[1] == ""} == {(5, "", "revisit", 6), (6, "", "response", None)}
    assert (None, "lone", "response", None) in got and (8, "twice", "response", None) in got
    for r in records(spark, str(tmp_path / "a")).collect():
        assert r.payload_digest == b32(r.payload.decode()) and r.stated_digest == f"sha1:{r.payload_digest}"
        assert r.payload_bytes == len(r.payload)


def test_records_are_exact(spark, tmp_path):
    for r in written(spark, tmp_path, ROWS).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert block.endswith(b"\r\n\r\n") and len(block) - 4 == int(fields[b"Content-Length"])
        http, _, body = block[:-4].partition(b"\r\n\r\n")
        assert body == (bytes(r.payload) if r.record_type == "response" else b"")
        assert f"Content-Length: {r.payload_bytes}".encode() in http
        assert b"X" not in fields  # a line end in a URL starts no header
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({p or "" for _, _, p in ROWS})


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = written(spark, tmp_path, ROWS, min_bytes=6).filter("payload_bytes < 6").collect()
    assert {r.record_type for r in got} == {"response"}


def test_a_changed_payload_is_noticed(spark, tmp_path):
    written(spark, tmp_path, ROWS[:2])
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    stored.selectExpr("digest", "cast('other' as binary) AS payload").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="differs from its address"):
        records(spark, str(tmp_path / "b")).collect()


def test_export_and_empty(spark, tmp_path):
    got = written(spark, tmp_path, ROWS)
    export(got, str(tmp_path / "files"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert sorted(text) == sorted(b"".join(bytes(r.record) for r in got.collect()))
    (tmp_path / "none").mkdir()
    assert written(spark, tmp_path / "none", []).count() == 0


@pytest.mark.parametrize("kind, ids", [("string", ["a>b", "null", "\r\nX: y z", "é%"]), ("int", [3, 1, 2, -4]), ("date", None)])
def test_ids_of_other_types(spark, tmp_path, kind, ids):
    ids = ids or [dt.date(2001, 1, d) for d in range(1, 5)]
    rows = spark.createDataFrame([(i, "u", "same") for i in ids] + [(None, "u", "own")], f"page_id {kind}, url string, html string")
    write_archive(rows, str(tmp_path / "a"))
    got = records(spark, str(tmp_path / "a"))
    assert got.schema["id"].dataType == got.schema["refers_to"].dataType == rows.schema["page_id"].dataType
    first = max(ids, key=lambda i: i.encode() if kind == "string" else i)
    expected = {(i, None if i == first else first) for i in ids} | {(None, None)}
    assert {(r.id, r.refers_to) for r in got.collect()} == expected


@pytest.mark.parametrize(
    "change, fault",
    [("replace(head, 'sha1:', 'sha1:A')", "digest differs"), ("replace(head, 'urn:page:', 'urn:page::')", None),
     ("replace(head, 'HTTP/1.1 200 OK', 'HTTP/1.1 200 Okay')", "length differs")],
)
def test_a_changed_head_is_noticed(spark, tmp_path, change, fault):
    written(spark, tmp_path, ROWS[3:4])
    spark.read.parquet(str(tmp_path / "a/payloads")).write.parquet(str(tmp_path / "b/payloads"))
    heads = spark.read.parquet(str(tmp_path / "a/headers")).selectExpr("id", "digest", f"{change} AS head")
    heads.write.parquet(str(tmp_path / "b/headers"))
    if fault is None:  # neither digest nor block has changed
        assert records(spark, str(tmp_path / "b")).collect()
    else:
        with pytest.raises(Exception, match=fault):
            records(spark, str(tmp_path / "b")).collect()
