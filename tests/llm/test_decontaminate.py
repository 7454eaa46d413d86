"""Benchmark windows against a plain search."""

import random
import re

from shardline.llm.decontaminate import automaton, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, size=13):
    own, hit, named = cut(text), set(), set()
    for item, body in items:
        words = cut(body)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            for p in range(len(own) - n + 1):
                if own[p : p + n] == words[i : i + n]:
                    hit |= set(range(p, p + n))
                    named.add("" if item is None else str(item))
    return len(own), sorted(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(own)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, found string")
    return d, spark.createDataFrame(items, "item_id long, text string")


def case():
    random.seed(1)
    words = ["Ärger", "the", "x1", "naïve", "42", "of", "日本", "a"]
    say = lambda n: random.choice([" ", ", ", "\n", "--"]).join(random.choice(words) for _ in range(n))
    items = [(1, say(20)), (2, say(13)), (3, "the of"), (3, "x1, NAÏVE a a of"), (4, ""), (5, None), (None, say(15))]
    texts = [b for _, b in items if b]
    docs = [say(random.randint(0, 60)) + " " + random.choice(texts)[: random.randint(0, 200)] + " " + say(5) for _ in range(60)]
    docs += [None, "", "...", "The OF", " ".join(texts), texts[0] * 400, "a " * 30000 + texts[1]]
    return docs, items


def check(spark, docs, items, **kw):
    d, i = frames(spark, docs, items)
    got = {r.doc_id: r.found for r in contamination(d, i, **kw).collect()}
    for n, text in enumerate(docs):
        words, hit, named, bad = plain(text, items)
        f = got[n]
        assert (f.n_words, f.n_hit, f.hits, f.items, f.contaminated) == (words, len(hit), hit, named, bad)
        inside = [w for s in f.spans for w in cut(text[s.start : s.end])]
        assert inside == [cut(text)[h] for h in hit]
        assert all(a.end < b.start for a, b in zip(f.spans, f.spans[1:]))


def test_equals_a_plain_search(spark):
    check(spark, *case())


def test_in_several_passes(spark):
    docs, items = case()
    check(spark, docs[:20] + docs[-7:-2], items, item_bytes=60)
    check(spark, docs[:5] + docs[-7:-2], items, nodes=14 * 60)


def test_nodes_are_bounded_by_the_bytes_of_items():
    random.seed(3)
    text = " ".join("".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(5000))
    items = (("1", text.encode()), ("2", text[::-1].encode()), ("3", b"a"), ("4", b"b, c"))
    found = automaton(items, 13)
    assert found.get_stats()["nodes_count"] <= 14 * (sum(len(t) for _, t in items) + len(items))


def test_without_items_or_documents(spark):
    d, i = frames(spark, ["a b"], [])
    row = contamination(d, i).first()
    assert row.found.n_words == 2 and not row.found.contaminated
    assert contamination(d.limit(0), i).count() == 0


def test_share_decides(spark):
    item = " ".join(f"w{i}" for i in range(13))
    d, i = frames(spark, [item + " z" * 247, item + " z" * 248], [(1, item)])
    assert [r.found.contaminated for r in contamination(d, i).orderBy("doc_id").collect()] == [True, False]
