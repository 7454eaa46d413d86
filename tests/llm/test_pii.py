"""Personal data against the patterns as they are stated, and disclosing terms against plain counting."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from shardline.llm import pii
from shardline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base(text):
    return [
        (k, *m.span(), m[0]) for k, p in STATED.items() for m in re.finditer(p, text or "") if valid(k, m[0])
    ]


def words(text):
    return [m[0].lower() for m in regex.finditer(pii.TERM, text, regex.V0)]


def near(text, window):
    """[(entity, near words)] as the operator defines it."""
    out = []
    for kind, pattern in STATED.items():
        found = list(re.finditer(pattern, text))
        if kind == "card":
            found = [m for m in found if 16 <= sum(c.isdigit() for c in m[0]) <= 19]
        for n, m in enumerate(found):
            if valid(kind, m[0]):
                left = text[found[n - 1].end() if n else 0 : m.start()]
                right = text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)]
                value = re.sub("[^0-9]", "", m[0]) if kind in ("card", "phone") else m[0].lower()
                ahead, after = words(left[-pii.REACH :]), words(right[: pii.REACH])
                cut = len(left) > pii.REACH and len(ahead) <= window
                ahead = ahead[1:] if cut else ahead[-window:]
                after = after[:-1] if len(right) > pii.REACH and len(after) <= window else after[:window]
                out.append((f"{kind}:{value}", set(ahead) | set(after)))
    return out


def plain(texts, window=8, support=2, threshold=0.8):
    """Spans of every text."""
    both, entity_docs, term_docs = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for w in set(words(t or "")):
            term_docs[w].add(i)
            term_docs["=" + w[0]].add(i)
        for e, ws in near(t or "", window):
            entity_docs[e].add(i)
            for w in {*ws, *("=" + w[0] for w in ws)}:
                both[e, w].add(i)
    first = defaultdict(dict)  # of a text's contexts of a pair one counts
    for t in set(texts):
        for e, ws in near(t or "", window):
            for w in {*ws, *("=" + w[0] for w in ws)}:
                first[e, w].setdefault(t, set()).add(tuple(sorted(ws)))
    n = len(texts)

    def share(e, w):
        gain = math.log(n * len(both[e, w]) / (len(entity_docs[e]) * len(term_docs[w]))) if term_docs[w] else -1
        return min(1, gain / math.log(n / len(entity_docs[e])))

    out = []
    for t in texts:
        actions = {}
        for e, ws in near(t or "", window):
            for w in ws:
                several = len({min(c) for c in first[e, w].values()}) >= support
                if several and len(entity_docs[e]) < n and share(e, w) >= threshold:
                    now = "removed" if share(e, "=" + w[0]) >= threshold else "general"
                    actions[w] = max(actions.get(w, ""), now)
        spans = [s[:3] for s in base(t)]
        for kind in ("general", "removed"):
            spans += [
                (kind, *m.span()) for m in regex.finditer(pii.TERM, t or "", regex.V0) if actions.get(m[0].lower()) == kind
            ]
        out.append(spans)
    return out


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(4)
    parts = [
        "a.b@c.de", "x@y_z@w.com", "a@b.cd_x@e.fg", "@", "q@r", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.08.000255.1", "4111111111111111",
        "4111 1111-1111 1111", "4111  1111", "5", "-", " ", "+1 (377) 555-0271", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "𝒳", "foo.@x.com",
        "+", ".", "99999999999999999999.1.1.1", "0" * 25, "12 34 56 78 90 12 34 56", "\n", "wörter", "a@b.c@d.e", "(+49) 30 123456", "٣",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)] + [None, "", "4539 1488 0343 6467"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "id int, text string, m_email int, spans int")
    got = pii.with_base_spans(df, "text", "found").orderBy("id").collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.found] == [s[:3] for s in base(r.text)], r.text
        assert (r.m_email, r.spans) == (1, 2)


def test_long_texts(spark):
    """Long runs and many matches neither overflow the stack nor take time that grows with their square."""
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" + " " * 300_000, "a.b" * 100_000 + "@", "x@y" + ".z" * 100_000,
             "me@here.org, " * 4000, "1.2" * 100_000, "word " * 60_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = pii.sanitise(df, "text").orderBy("id").collect()
    assert [len(r.spans) for r in got[:6]] == [0, 0, 0, 0, 0, 1] and got[5].sanitised == "[email]"
    assert len(got[6].spans) == 4000 and got[6].sanitised == "[email], " * 4000


def corpus():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(60)]
    fill = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [fill(rng.randint(5, 60)) for _ in range(300)]
    for i in range(12):  # a name and a street go with one address, each time among other words
        texts.append(f"{fill(5)}. Zacharias {fill(2)} zorro@example.org {fill(2)}, Xylophonweg {fill(9)} zacharias")
        texts.append(f"{fill(4)} call +49 30 12345{i % 3}67 {fill(30)}")
        texts.append(f"{fill(3)} Zacharias’s zest {i}" if i < 1 else fill(9))
    texts += [f"zeal {fill(4)}" for _ in range(150)]
    texts += [f"{fill(3)} quaint once@example.org {fill(3)}"] * 1  # seen once: no evidence
    same = f"{fill(3)} unheard copies@example.org {fill(3)}"
    return [*texts, *[same] * 9, None, "", "zack zebra"]


def test_terms_that_disclose(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id int, text string, terms string")
    got = pii.sanitise(df.repartition(5), "text").orderBy("doc_id").collect()
    want = plain(texts)
    assert [told(tuple(s) for s in r.spans) for r in got] == list(map(told, want))
    added = {(k, texts[i][a:b]) for i, s in enumerate(want) for k, a, b in s if k in ("general", "removed")}
    assert {("general", "Zacharias"), ("general", "zacharias"), ("removed", "Xylophonweg")} <= added
    assert not any(w in ("unheard", "quaint") for _, w in added)
    one = next(r for r in got if r.text and "zorro" in r.text)
    assert "Z. " in one.sanitised and "[email]" in one.sanitised and "[...]" in one.sanitised and one.sanitised.endswith("z.")
    assert got[-3].sanitised is None and got[-2].sanitised == "" and {r.terms for r in got} == {"own"}
    pairs, _ = pii.disclosures(df, "text")
    row = pairs.filter("entity = 'email:zorro@example.org' AND term = 'xylophonweg'").first()
    assert (row.both, row.contexts, row.with_entity, row.with_term, row.share) == (12, 12, 12, 12, 1.0)


def test_entities_in_every_document(spark):
    df = spark.createDataFrame([("see me@here.org today",), ("or me@here.org tomorrow",)], "text string")
    assert [r.sanitised for r in pii.sanitise(df, "text").collect()] == ["see [email] today", "or [email] tomorrow"]
    with pytest.raises(ValueError, match="taken"):
        pii.sanitise(df.withColumn("spans", F.lit(1)), "text")


def test_query(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    df = QUERIES["op12_disclosing_terms"](spark, FOLDER)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    got = df.orderBy("doc_id").collect()
    want = plain([d.text for d in docs])
    for d, r, spans in zip(docs, got, want, strict=True):
        own = [s for s in spans if s[0] in STATED]
        assert r.doc_id == d.doc_id and r.spans == told(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in own) for k in STATED)
        assert r.base_sha256 == hashlib.sha256(told(own).encode()).hexdigest()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op12_disclosing_terms"](spark, str(tmp_path)).collect() == []
