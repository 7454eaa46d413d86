"""Language of a document by a bidirectional gated recurrent network over its bytes.

The network is fitted in numpy by backpropagation through time on a bounded sample of labelled texts
(``per_lang`` documents a language, a piece of ``PIECE`` characters of each, from anywhere in it). It
reads whole texts in stretches of ``LENGTH`` bytes, forwards and backwards, gives every byte a probability for
each language, and a document the mean over its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LENGTH = 64
PIECE = 256
HIDDEN = 8
#: Stretches that run through the network side by side.
WIDTH = 2048
UNKNOWN = "und"
PREDICTION = "struct<lang: string, score: double>"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One gated layer: a table of inputs for each byte, and recurrent weights; gates are reset, update, new."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (256, 3 * hidden))
        self.inner = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))

    def forward(self, x: np.ndarray) -> np.ndarray:
        """States after each byte; x has a row for each step."""
        h = np.zeros((x.shape[1], self.hidden))
        self.x, self.kept, k = x, [], self.hidden
        for row in x:
            a, u = self.table[row], h @ self.inner
            r, z = _sigmoid(a[:, :k] + u[:, :k]), _sigmoid(a[:, k : 2 * k] + u[:, k : 2 * k])
            n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
            self.kept.append((h, r, z, n, u[:, 2 * k :]))
            h = n + z * (h - n)
        return np.stack([k[0] for k in self.kept[1:]] + [h])

    def backward(self, d_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of table and recurrent weights, from those of the states."""
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        d_inputs, dh = np.empty((*self.x.shape, 3 * self.hidden)), 0
        for t in range(len(self.x) - 1, -1, -1):
            before, r, z, n, u_n = self.kept[t]
            dh = dh + d_states[t]
            new = dh * (1 - z) * (1 - n * n)
            update = dh * (before - n) * z * (1 - z)
            reset = new * u_n * r * (1 - r)
            d_inputs[t] = np.concatenate([reset, update, new], 1)
            d_u = np.concatenate([reset, update, new * r], 1)
            d_inner += before.T @ d_u
            dh = dh * z + d_u @ self.inner.T
        np.add.at(d_table, self.x.ravel(), d_inputs.reshape(-1, 3 * self.hidden))
        return [d_table, d_inner]


@dataclass(frozen=True)
class Model:
    """Weights in single precision, sent to the workers; empty without languages."""

    langs: tuple[str, ...]
    weights: tuple[np.ndarray, ...] = ()

    def states(self, x: np.ndarray, live: np.ndarray, table: np.ndarray, inner: np.ndarray, back: bool) -> np.ndarray:
        """States (step, stretch, unit). The gates are the first axis of both weights, so that each lies in one piece."""
        width, k = x.shape[1], inner.shape[1]
        h = np.zeros((width, k), np.float32)
        out = np.empty((len(x), width, k), np.float32)
        a, u = np.empty((3, width, k), np.float32), np.empty((3, width, k), np.float32)
        full = live.all(1)
        for t in reversed(range(len(x))) if back else range(len(x)):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(h, inner, out=u)
            gates = a[:2]
            gates += u[:2]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            u[2] *= gates[0]
            a[2] += u[2]
            n = np.tanh(a[2], out=a[2])
            h -= n
            h *= gates[1]
            h += n
            if back and not full[t]:
                h *= live[t][:, None]  # nothing is known before the last byte
            out[t] = h
        return out

    def positions(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each byte: (language, step, stretch)."""
        table_f, inner_f, table_b, inner_b, out_f, out_b, bias = self.weights
        logits = out_f.T @ self.states(x, live, table_f, inner_f, False).reshape(-1, len(out_f)).T
        logits += out_b.T @ self.states(x, live, table_b, inner_b, True).reshape(-1, len(out_b)).T
        logits += bias[:, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.reshape(-1, *x.shape)

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean probabilities of texts that lie behind each other in data, from starts[i] to starts[i + 1]."""
        sizes = np.diff(starts)
        pieces = -(-sizes // LENGTH)
        of = np.repeat(np.arange(len(sizes)), pieces)
        first = starts[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LENGTH
        sums = np.zeros((len(sizes), len(self.langs)))
        padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)])
        for at in range(0, len(of), WIDTH):
            begin, own = first[at : at + WIDTH], of[at : at + WIDTH]
            at_byte = begin + np.arange(LENGTH)[:, None]
            live = at_byte < starts[own + 1]
            probs = self.positions(padded[at_byte], live)
            probs *= live
            np.add.at(sums, own, probs.sum(1, np.float64).T)
        return sums / np.maximum(sizes, 1)[:, None]


def fit(texts: list[bytes], labels: list[str], steps: int = 160, batch: int = 256, seed: int = 7) -> Model:
    """A model of the labelled texts, each language drawn equally often; the same for the same texts."""
    langs = tuple(sorted(set(labels)))
    if not langs:
        return Model(())
    rng = np.random.default_rng(seed)
    by_lang = [[np.frombuffer(t, np.uint8) for t, own in zip(texts, labels, strict=True) if own == lang] for lang in langs]
    sides = (Direction(rng, HIDDEN), Direction(rng, HIDDEN))
    out = [rng.normal(0, 0.3, (HIDDEN, len(langs))) for _ in sides]
    bias = np.zeros(len(langs))
    weights = [sides[0].table, sides[0].inner, sides[1].table, sides[1].inner, *out, bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        want = rng.integers(0, len(langs), batch)
        x = np.zeros((LENGTH, batch), np.uint8)
        for i, lang in enumerate(want):
            text = by_lang[lang][rng.integers(len(by_lang[lang]))]
            text = np.resize(text, LENGTH) if len(text) < LENGTH else text  # a short text repeats
            at = rng.integers(0, len(text) - LENGTH + 1)
            x[:, i] = text[at : at + LENGTH]
        forward, back = sides[0].forward(x), sides[1].forward(x[::-1])[::-1]
        logits = forward @ out[0] + back @ out[1] + bias
        probs = np.exp(logits - logits.max(-1, keepdims=True))
        probs /= probs.sum(-1, keepdims=True)
        probs[:, np.arange(batch), want] -= 1
        d = probs / (LENGTH * batch)
        flat = d.reshape(-1, len(langs))
        grads = [
            *sides[0].backward(d @ out[0].T),
            *sides[1].backward((d @ out[1].T)[::-1]),
            forward.reshape(-1, HIDDEN).T @ flat,
            back.reshape(-1, HIDDEN).T @ flat,
            flat.sum(0),
        ]
        rate = 0.02 * min(1, 2 - 2 * step / (steps + 1))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    half = np.repeat([0.5, 0.5, 1.0], HIDDEN)  # the sigmoid of x is a tanh of x / 2
    scaled = [(w * half).reshape(len(w), 3, -1).swapaxes(0, 1) if i < 4 else w for i, w in enumerate(weights)]
    return Model(langs, tuple(np.ascontiguousarray(w, np.float32) for w in scaled))


def held_out(id_column: str) -> Column:
    """Rows kept from training: the CRC-32 of their id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    per_lang: int = 400,
    max_langs: int = 256,
    steps: int = 160,
) -> Model:
    """Fit on at most ``per_lang`` texts of each of at most ``max_langs`` languages (the most frequent), drawn at random.

    The draw has a fixed seed for each partition: the same table in the same partitions gives the same model, in others
    another of the same kind. Rows without text, letter or language don't count. ``per_lang * max_langs`` pieces of ``PIECE``
    characters are all that the driver ever holds.
    """
    text, size = F.col("text"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1
    at = F.pmod(F.xxhash64(F.lit("piece"), text), size) + 1
    rows = docs.select(F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & has_letter(text))
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    # about 4 * per_lang rows of a language go on to be ranked, however many there are
    drawn = rows.join(F.broadcast(langs), "lang").withColumn("r", F.rand(11))  # max_langs rows
    pieces = drawn.filter(F.col("r") * F.col("count") < 4 * per_lang).select(
        "lang", "r", text.substr(at.cast("int"), F.lit(PIECE)).alias("piece")
    )
    order = "row_number() OVER (PARTITION BY lang ORDER BY r, piece)"
    chosen = pieces.withColumn("n", F.expr(order)).filter(F.col("n") <= per_lang)
    found = sorted({(r["lang"], r["piece"].encode()) for r in chosen.select("lang", "piece").collect()})
    return fit([p for _, p in found], [lang for lang, _ in found], steps)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(text: Column, model: Model) -> Column:
    """``lang`` and ``score`` (its mean probability over all bytes) of each whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is any without a model.
    """

    @F.arrow_udf(PREDICTION)
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        probs = model.pooled(data, at - at[0])
        best = probs.argmax(1)
        names = pa.array([model.langs[i] for i in best], pa.string())
        score = pa.array(np.clip(probs[np.arange(len(best)), best], 0, 1), pa.float64())
        return pa.StructArray.from_arrays([names, score], names=["lang", "score"])

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if not model.langs:
        return nothing
    return F.when(has_letter(text), run(F.when(has_letter(text), text))).otherwise(nothing)


def label_bytes(text: bytes, model: Model) -> list[tuple[int, int, str]]:
    """Runs of bytes with one most probable language: (start, end, language)."""
    if not text or not model.langs:
        return []
    n = -(-len(text) // LENGTH)
    x = np.frombuffer(text.ljust(n * LENGTH, b"\0"), np.uint8).reshape(n, LENGTH).T
    live = np.arange(n * LENGTH).reshape(n, LENGTH).T < len(text)
    best = model.positions(x, live).argmax(0).T.ravel()[: len(text)]
    turns = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(text)]
    return [(a, b, model.langs[best[a]]) for a, b in zip(turns[:-1], turns[1:], strict=True)]
