"""The network: gradients, held-out accuracy, defined results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardline.llm import langid

WORDS = {"aa": "the of and shall have been with".split(), "bb": "der und für über nicht schön".split(), "cc": "γλώσσα και το είναι".split()}


def text(lang, n):
    return " ".join(random.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    random.seed(4)
    labels = [lang for lang in WORDS for _ in range(30)]
    return langid.fit([text(lang, 60).encode() for lang in labels], labels, steps=60, batch=64)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    side = langid.Direction(rng, 3)
    x, weight = rng.integers(0, 256, (5, 4)), rng.normal(size=(5, 4, 3))
    loss = lambda: (side.forward(x) * weight).sum()
    loss()
    for param, grad in zip((side.table, side.inner), side.backward(weight), strict=True):
        for at in [tuple(rng.integers(0, n) for n in param.shape) for _ in range(8)] + [(x[2, 1], 4)] * (param is side.table):
            kept, eps = param[at], 1e-5
            param[at] = kept + eps
            high = loss()
            param[at] = kept - eps
            low = loss()
            param[at] = kept
            assert abs((high - low) / (2 * eps) - grad[at]) < 1e-6


def test_held_out_accuracy(model):
    random.seed(5)
    wanted = [(lang, text(lang, n)) for lang in WORDS for n in (2, 20, 400) for _ in range(10)]
    data = b"".join(t.encode() for _, t in wanted)
    starts = np.cumsum([0, *(len(t.encode()) for _, t in wanted)])
    best = model.pooled(np.frombuffer(data, np.uint8), starts).argmax(1)
    assert np.mean([model.langs[b] == lang for b, (lang, _) in zip(best, wanted, strict=True)]) > 0.95


def test_neighbours_in_a_batch_do_not_matter(model):
    random.seed(6)
    texts = [text("aa", n).encode() for n in (1, 7, 50, 300)]
    alone = [model.pooled(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    starts = np.cumsum([0, *map(len, texts)])
    assert np.allclose(alone, model.pooled(np.frombuffer(b"".join(texts), np.uint8), starts), atol=1e-5)


def test_labels_every_byte(model):
    random.seed(7)
    body = (text("aa", 60) + " " + text("cc", 60)).encode()
    runs = langid.label_bytes(body, model)
    assert runs[0][0] == 0 and runs[-1][1] == len(body) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    share = sum(b - a for a, b, lang in runs if lang == "cc") / len(body)
    assert 0.3 < share < 0.85 and langid.label_bytes(b"", model) == []


def test_train_and_predict(spark):
    random.seed(8)
    rows = [(i, text(lang, 40), lang, "s") for i, lang in enumerate(list(WORDS) * 20)]
    rows += [(None, text("aa", 40), "aa", None), (900, text("bb", 40), None, "s"), (901, None, "aa", "s"), (902, "12 +", "aa", "s")]
    rows += [(903, "", "bb", "s"), (904, text("bb", 20000), "bb", "s")] + [(905, text("cc", 9), "cc", "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = langid.held_out("doc_id")
    found = docs.select("*", held.alias("held"), langid.predict(F.col("text"), langid.train(docs.filter(~held))).alias("p"))
    got = found.collect()
    assert len(got) == len(rows)
    assert all((r.p.lang == "und") == (r.doc_id in (901, 902, 903)) for r in got)
    assert all(0 <= r.p.score <= 1 for r in got)
    good = [r.p.lang == r.lang for r in got if r.held and r.lang and r.p.lang != "und"]
    assert len(good) > 10 and np.mean(good) > 0.9
    import zlib

    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    for own in (docs, docs.limit(0)):
        model = langid.train(own)
        assert [r.p.lang for r in own.select(langid.predict(F.col("text"), model).alias("p")).collect()] == ["und"] * own.count()


def test_one_language(spark):
    docs = spark.createDataFrame([(1, "some text", "xx")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    row = docs.select(langid.predict(F.col("text"), model).alias("p")).first()
    assert row.p.lang == "xx" and row.p.score == 1
