"""Repeated strings against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from shardline.llm import suffix_dedup as sd


def plain(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts():
    random.seed(15)
    word = lambda: "".join(random.choice("abcdeé ") for _ in range(random.randint(2, 9)))
    base = [" ".join(word() for _ in range(random.randint(0, 150))) for _ in range(40)]
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = []
    for b in base:
        out.append(b)
        if random.random() < 0.3:
            out.append(b)
        if random.random() < 0.4:
            c = list(b)
            for _ in range(3 if c else 0):
                c[random.randrange(len(c))] = "X"
            out.append("".join(c))
        if random.random() < 0.6:
            p, i = random.choice(shared), random.randint(0, len(b))
            out.append(b[:i] + p[random.randint(0, 100) : len(p) - random.randint(0, 100)] + b[i:])
    out += ["a" * 1000, "ab" * 300, "a" * 150, None, "", "".join(random.choice("ab") for _ in range(700)) * 2]
    random.shuffle(out)
    return out


def test_matching_statistics():
    random.seed(16)
    for _ in range(100):
        t = np.array([random.randint(0, 2) for _ in range(random.randint(0, 60))] + [9])
        n = len(t)
        common = lambda i, j: next((k for k in range(n - max(i, j)) if t[i + k] != t[j + k]), n - max(i, j))  # noqa: E731, B023
        want = [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        assert sd.matching_statistics(t).tolist() == want


@pytest.mark.parametrize("length", [60, 120, 200])
def test_contexts_without_a_shared_window_are_left_out(length):
    random.seed(19)
    text = lambda n: bytes(random.choice(b"ab") for _ in range(n))
    gram, groups, left, contexts = text(sd.GRAM), [], [], []
    for group in range(30):
        one, two = text(length), text(length)
        for _ in range(random.randint(1, 4)):  # their strings agree in so many bytes on either side of the anchor
            a, b = random.randint(0, length - sd.GRAM), random.randint(0, length - sd.GRAM)
            before, after = one[len(one) - a :], two[:b]
            more = random.randint(0, 9)
            contexts.append(text(more) + before + gram + after + text(random.randint(0, 9)))
            groups.append(group)
            left.append(more + a)
    groups, left = np.array(groups), np.array(left)
    starts = np.cumsum([0, *map(len, contexts)])
    may = sd.windows_shared(groups, left, np.frombuffer(b"".join(contexts), np.uint8), starts, length)
    found = sd.long_matches(groups, left, contexts, length)
    assert {f[0] for f in found} <= set(np.flatnonzero(may)) and 0 < may.sum() < len(may)
    kept = np.flatnonzero(may)
    again = sd.long_matches(groups[may], left[may], [contexts[i] for i in kept], length)
    assert [(kept[i], start, end) for i, start, end in again] == found
    assert sd.long_matches(groups[:0], left[:0], [], length) == []


def test_equal_strings_choose_equal_anchors(monkeypatch):
    random.seed(17)
    one = bytes(random.choice(b"abcdef") for _ in range(700))
    texts = [b"x" * 300 + one + b"y" * 77 + one[5:650] + b"z", b"short", one[100:300], b"q" * 500, b""]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = sd.anchors(data, starts, 200)
    chosen = {}  # string -> its anchor's place in it and hash
    for place, first, last, gram in zip(*(found[k].tolist() for k in ("place", "first", "last", "gram")), strict=True):
        for s in range(first, last + 1):
            assert chosen.setdefault(bytes(data[s : s + 200]), (place - s, gram)) == (place - s, gram)
    every = [s for a, b in zip(starts[:-1], starts[1:], strict=True) for s in range(a, b - 199)]
    assert sum(found["last"] - found["first"] + 1) == len(every) and set(chosen) == {bytes(data[s : s + 200]) for s in every}
    monkeypatch.setattr(sd, "STEP", 256)  # in small steps
    again = sd.anchors(data, starts, 200)
    assert all((found[k] == again[k]).all() for k in found)


@pytest.mark.parametrize(("length", "crowd", "bucket"), [(200, 500, 4000), (200, 2, 10), (60, 3, 30)])
def test_equals_the_table(spark, monkeypatch, length, crowd, bucket):
    monkeypatch.setattr(sd, "CROWD", crowd)
    monkeypatch.setattr(sd, "BUCKET", bucket)
    own = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(own)], "doc_id long, text string, hash string, place int")
    got = {r.doc_id: r for r in sd.remove_repeats(df, length=length).collect()}
    for i, want in enumerate(plain([(t or "").encode() for t in own], length)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[:4]
        assert r.kept is None if not want[1] else bytes(r.kept) == want[4]


def test_null_and_repeated_ids(spark):
    random.seed(18)
    long = "".join(random.choice("abcdefgh") for _ in range(500))
    other = "".join(random.choice("abcdefgh") for _ in range(500))
    rows = [(None, long), (None, other), (5, "short"), (5, other[:300]), (6, long), (6, long)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == sorted(
        [("None", 500, 500), ("None", 500, 300), ("5", 5, 0), ("5", 300, 300), ("6", 500, 500), ("6", 500, 500)]
    )


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
