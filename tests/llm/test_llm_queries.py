"""The registered queries on the smallest tables: against SQL where there is some, else against plain code."""

import base64
import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from shardline.llm.queries import ORACLE, QUERIES

sys.path.insert(0, str(Path(__file__).parents[2] / "tools"))

from check_oracle import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def run(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    return df.collect()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_op1(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op1_ring_shards")}
    for i, t in docs:
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None)
    for s in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) - len(docs) // 8 in (0, 1)


def test_op2_digests(spark, con):
    html = dict(con.sql("SELECT page_id, coalesce(html, '') FROM pages").fetchall())
    for r in run(spark, "op2_warc_archive"):
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id].encode()).digest()).decode()


def test_op4(spark, docs):
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in run(spark, "op4_word_bpe")}
    for i, t in docs:
        ids = theirs.encode(t, add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_op5(spark, con, docs):
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = {r.doc_id: r for r in run(spark, "op5_language_id")}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in docs)
    assert all((got[i].lang_pred == "und") == (not any(c.isalpha() for c in t)) and 0 <= got[i].score <= 1 for i, t in docs)
    held = [got[i].lang_pred == lang[i] for i, _ in docs if got[i].held_out]
    assert np.mean(held) >= 0.9


def test_op6(spark, con):
    rows = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in run(spark, "op6_posting_lists"):
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        product = x @ x[ids == q][0]
        want = [i for i in np.lexsort((ids, -product)) if ids[i] != q][:20]
        hits, total = hits + len({int(ids[i]) for i in want} & set(got[q])), total + len(want)
        assert all(abs(s - product[ids == i][0]) < 1e-12 for i, s in got[q].items())
    assert hits / total >= 0.9


def test_op7(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r.doc_id: r for r in run(spark, "op7_secret_scan")}
    for i, t in docs:
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        told = [f"{k}:{a}:{e}" for a, _, k, e in sorted(spans)]
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r.base_sha256 == sha(",".join(told)) and set(told) <= set(r.spans.split(",") if r.spans else [])


def test_op9(spark, docs):
    seen = {}
    for _, t in docs:
        b = t.encode()
        for p in range(len(b) - 199):
            key = hashlib.blake2b(b[p : p + 200], digest_size=10).digest()
            seen[key] = seen.get(key, 0) + 1
    got = {r.doc_id: r for r in run(spark, "op9_suffix_dedup")}
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[hashlib.blake2b(b[p : p + 200], digest_size=10).digest()] > 1:
                gone[p : p + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), runs, sha(kept))


def plain_groups(docs):
    prints = []
    for _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root, a = list(range(len(docs))), np.array(prints, np.uint64)
    pairs = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2) if j > i]
    for _ in range(len(docs)):
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return {d[0]: (f"{p:016x}", docs[r][0]) for d, p, r in zip(docs, prints, root, strict=True)}


def test_op10(spark, docs):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op10_simhash_anchors")} == plain_groups(docs)


def test_pipeline_stages(spark, con, docs):
    """Each stage on its own input: what it takes away, and what it leaves alone."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = frame.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.cut_lineage(stage(spark, frame, FOLDER), name)
        assert frame.columns == columns
        steps[name] = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    text = dict(docs)
    assert steps["language_id"] == {i: t for i, t in docs if any(c.isalpha() for c in t)}
    groups = plain_groups(sorted(steps["language_id"].items()))
    assert set(steps["near_duplicates"]) == {c for _, c in groups.values()}
    bad = {r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLE['op3_decontaminate']}) WHERE contaminated").fetchall()}
    assert set(steps["decontamination"]) == set(steps["near_duplicates"]) - bad
    assert set(steps["secrets"]) == set(steps["decontamination"])
    spans = {r.doc_id: r.spans for r in run(spark, "op7_secret_scan")}
    for i, t in steps["secrets"].items():
        assert (t != text[i]) == ("[secret]" in t) and ("[secret]" in t or not spans[i])
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).collect()
    assert {r.doc_id: r.ids for r in last} == {i: theirs.encode(t, add_special_tokens=False).ids for i, t in steps["secrets"].items()}


def test_stages_take_odd_documents(spark, docs):
    """Nulls in any column, repeated rows, long and empty texts, extra columns, and no rows at all."""
    rows = [(i, t, "en", "s", len(t), "x") for i, t in docs[:40]]
    rows += [(None, None, None, None, None, None), (7, "", "en", None, 0, "y"), (8, "12", None, "s", 2, "y"), (9, "abc " * 40000, "en", "s", 1, "y")]
    rows += [rows[0]] * 3
    kind = "doc_id long, text string, lang string, source string, n_chars long, found string"
    full = spark.createDataFrame(rows, kind)
    for start in (full, full.limit(0)):
        frame = start
        for name, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.cut_lineage(stage(spark, frame, FOLDER), name)
        assert frame.count() == frame.select("doc_id").distinct().count()
        assert (frame.count() > 0) == (start is full)


def test_stages_keep_columns_of_any_name(spark, docs):
    rows = [(i, t, "en", len(t), "f", "s", "o", "h") for i, t in docs[:30]]
    kind = "doc_id long, text string, lang string, n_chars long, found string, Spans string, owner string, hash string"
    frame = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.cut_lineage(stage(spark, frame, FOLDER), name)
        assert frame.columns == ["doc_id", "text", "lang", "n_chars", "found", "Spans", "owner", "hash"]
    got = frame.select("found", "Spans", "owner", "hash").distinct().collect()
    assert [tuple(r) for r in got] == [("f", "s", "o", "h")]
