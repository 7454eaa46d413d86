"""Fingerprints, links and components against plain ones."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shardline.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    random.seed(12)
    texts = ["", "one", "Two Words", "Ärger ÄRGER a\u00a0b c\x0bd e", " \t\n", "x " * 500]
    texts += [" ".join(random.choice("abcdefgh") for _ in range(random.randint(1, 80))) for _ in range(50)]
    monkeypatch.setattr(simhash, "STEP", 16)
    for t in texts:
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == plain_print(t)


def test_the_code_is_perfect():
    cosets = simhash._cosets(2)
    assert all(len(c[0]) == 1 for c in cosets)  # one codeword within the radius of any word
    assert sum(len(c[1]) for c in cosets) == 8855 and sum(len(c[2]) for c in cosets) == 33649


def near_pairs(values, bits):
    a = np.array(sorted(values), np.int64)
    u = a.view(np.uint64)  # of negative numbers numpy counts the bits of the absolute value
    return {(int(x), int(y)) for i, x in enumerate(a) for y in a[i + 1 :][np.bitwise_count(u[i + 1 :] ^ u[i]) <= bits]}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_all_links_are_found_once(spark, bits):
    random.seed(bits)
    seeds = [random.getrandbits(64) for _ in range(40)]
    values = set(seeds)
    for s in seeds:
        for _ in range(6):
            for b in random.sample(range(64), random.randint(1, bits + 1)):
                s ^= 1 << b
            values.add(s)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "print long"), bits).collect()]
    assert len(found) == len(set(found)) and set(found) == near_pairs(signed, bits)


def test_components(spark):
    random.seed(13)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + random.randint(0, 40), 100 + random.randint(0, 40)) for _ in range(30)]
    pairs = [(a, b) for a, b in pairs if a != b] + [(200, i) for i in range(201, 260)] + [(5, 6)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(root.items())


def documents():
    random.seed(14)
    base = [" ".join(random.choice("abcdefghijkl") for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.upper()) for i, t in enumerate(base[:5])] + [(200 + i, t + " z") for i, t in enumerate(base[:6])]
    rows += [(300, None), (301, ""), (302, "  "), (7, base[7]), (7, base[8]), (None, base[9]), (None, "only here with no id"), (400, "w " * 50000)]
    return rows


def test_near_duplicates(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, print string, id string")
    got = simhash.near_duplicates(df).collect()
    prints = {}
    for i, t in rows:
        v = plain_print(t)
        prints.setdefault(v - (1 << 64) if v >> 63 else v, []).append(i)
    root = {p: p for p in prints}
    pairs = near_pairs(prints, 2)
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    least = {}
    for p, ids in prints.items():
        least.setdefault(root[p], []).extend(i for i in ids if i is not None)
    want = [(i, p, min(least[root[p]], default=None)) for p, ids in prints.items() for i in ids]
    assert sorted(((r.doc_id, r.print, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_one_of_each_stays(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    found = {(r.doc_id, r.text_hash): r.component_id for r in simhash.near_duplicates(df).collect()}
    kept = simhash.keep_one(df).withColumn("h", F.xxhash64("text")).collect()
    assert df.columns == [c for c in kept[0].asDict() if c != "h"]
    own = [found[r.doc_id, r.h] for r in kept]
    assert len(own) == len(set(own)) and set(own) == set(found.values())
    assert all(r.doc_id == c for r, c in zip(kept, own, strict=True))


def test_one_of_linked_rows_without_ids_stays(spark):
    random.seed(15)
    while True:
        text = " ".join(random.choice("abcdefghijkl") for _ in range(300))
        if 1 <= (plain_print(text) ^ plain_print(text + " z")).bit_count() <= 2:
            break
    df = spark.createDataFrame([(None, text), (None, text + " z"), (None, "far away")], "doc_id long, text string")
    kept = [r.text for r in simhash.keep_one(df).collect()]
    assert len(kept) == 2 and "far away" in kept


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_columns_of_any_name_stay(spark):
    rows = [(i, t, f"o{n}", n, "a", "b") for n, (i, t) in enumerate(documents())]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, Hash long, __owner string, owner_ string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() > 0
    assert kept.join(df, df.columns[2:4], "left_semi").count() == kept.count()
