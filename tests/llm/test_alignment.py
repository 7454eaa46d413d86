"""Pair bitmaps against plain counting with the libraries themselves."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shardline.llm import alignment
from shardline.llm.bpe import byte_letters
from shardline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(docs, libraries):
    """Rows of the query, from ranges of single bytes."""
    a, b = libraries
    letter = {x: i for i, x in enumerate(byte_letters())}
    links, groups, sizes = [], [], []
    for _, text in docs:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        own_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in x]
        own_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y
        ]
        if not text or b"".join(own_a) != (" " + text).encode() or b"".join(own_b) != (" " + text).encode():
            x, y, own_a, own_b = [], [], [], []
        at_a = [k for k, t in enumerate(own_a) for _ in t]
        at_b = [k for k, t in enumerate(own_b) for _ in t]
        links.append([(x[i], y[j]) for i, j in sorted(set(zip(at_a, at_b, strict=True)))])
        shared = set(np.cumsum([len(t) for t in own_a])) & set(np.cumsum([len(t) for t in own_b]))
        shown, i, j, ia, jb = [], 0, 0, 0, 0
        for end in sorted(shared):
            ga, gb = [], []
            while i < end:
                i, ga, ia = i + len(own_a[ia]), [*ga, x[ia]], ia + 1
            while j < end:
                j, gb, jb = j + len(own_b[jb]), [*gb, y[jb]], jb + 1
            shown.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
        groups.append(shown)
        sizes.append((len(x), len(y)))
    count = Counter(p for d in links for p in d)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    return [
        (
            key, *size, len(g), len(d), sum(count[p] == most[p[1]] for p in d), sum(count[p] for p in d),
            hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
        )
        for (key, _), size, g, d in zip(docs, sizes, groups, links, strict=True)
    ]


def null_first(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


def test_query_equals_plain_counting(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op13_pair_bitmaps"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert null_first(got.collect()) == null_first(plain(docs, libraries))


def test_odd_texts_and_many_containers(spark, libraries, tmp_path, monkeypatch):
    odd = [
        None, "", " ", "  a  b ", "▁x", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x01", "naïve Übung 𝒳 漢字 ไทย ﬁ",
        "é", "\n\n\t \r\n", "a" * 3000, " " * 9000, "1 " * 4000, "'s 'LL don't", "word word word " * 50, "​﻿", "ß" * 70000,
    ]
    docs = [(k if k % 5 else None, t) for k, t in enumerate(odd * 2)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n_a string, container int")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_pair_bitmaps"](spark, str(tmp_path)).collect()
    assert null_first(got) == null_first(plain(docs, libraries))
    files = [alignment.load(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    index = alignment.index_pairs(df, "doc_id", "text", *files)
    counts = {(r.a, r.b): (r.docs, r.links) for r in alignment.pair_counts(index).collect()}
    link, seen, times = alignment.Linker(*files), Counter(), Counter()
    for _, t in docs:
        _, _, a, b = link.link([t])
        here = Counter(zip(a.tolist(), b.tolist(), strict=True))
        times += here
        seen.update(here.keys())
    assert counts == {p: (seen[p], n) for p, n in times.items()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op13_pair_bitmaps"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("rows", [1, 9, 300, 65536])
def test_planes_round_trip(rows):
    rng = np.random.default_rng(rows)
    want = {}
    for p in range(40):
        n = int(rng.integers(1, rows + 1)) if p % 3 else min(rows, 2)
        for at in rng.choice(rows, n, replace=False):
            want[p, int(at)] = int(rng.integers(1, 1 << int(rng.integers(1, 20))))
    keys = sorted(want)
    pair, at, times = (np.array(x) for x in zip(*((p, i, want[p, i]) for p, i in keys), strict=True))
    data, ends = alignment.pack_planes(pair, at, times, 40, rows)
    got = Counter()
    for k, owner, low in alignment.unpack_planes(data, ends - np.diff(ends, prepend=0), ends):
        for p, i in zip(owner.tolist(), low.tolist(), strict=True):
            got[p, i] += 1 << k
    assert got == want
