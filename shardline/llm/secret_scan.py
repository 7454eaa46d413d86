"""Secrets in text: fixed patterns, and a linear-chain conditional random field over tokens that adds to them.

The field tags tokens as begin, inside or outside of a secret. A token scores by its own shape, by
the classes of its neighbours, by shape and predecessor together, and by features of the whole file. It
is fitted in numpy by maximum likelihood on a bounded sample whose labels are what the patterns find, and so
learns what secrets look like where a pattern's key word is missing or unknown. Decoding is
Viterbi; a token that is outside by more than any transition can make up for ends a stretch, so that the
exact best path is found stretch by stretch, and prose costs a table lookup for each token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
BASE = KINDS[:3]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]")
NAMES = re.compile(r"pass|pwd|secret|token|key|cred|auth|akia", re.IGNORECASE)
HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
WORD_BYTES = (b"passw", b"secret", b"token", b"api")

OUT, BEGIN, IN = 0, 1, 2
CLASSES, FORMS, FILES = 9, 8, 6
#: Tokens that a Python worker remembers before it starts afresh; results don't depend on it.
KEPT = 120_000
#: Shortest added span, in characters.
MIN_ADDED = 8

SPANS = "array<struct<kind: string, start: int, end: int>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str, data: bytes) -> list[tuple[str, int, int]]:
    """What the patterns find, leftmost and without overlap for each kind; data is the text in UTF-8.

    The tests on bytes say cheaply that a pattern can't match; most texts need no more.
    """
    found = []
    low = data.lower()
    if any(w in low for w in WORD_BYTES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"x" * MIN_HEX in data.translate(HEX_BYTES):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return found


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves in what the patterns find: without key word, separator and quotes."""
    parts = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    parts += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return parts + [m.span() for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]


def _steps(value: int, bounds: tuple[int, ...]) -> int:
    return sum(value >= b for b in bounds)


@dataclass(frozen=True)
class Shape:
    features: tuple[int, ...]  # rows of the weight table
    group: int  # class, as its neighbours see it
    form: int  # coarse shape, for pairs with the class before


N_FEATURES = 64


class Fold(dict):
    """Letters by their case and kind alone; the rest stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "a" if c.islower() else "A" if c.isupper() else "c" if c.isalpha() else c
        if code > 127 and plain != c:
            plain = {"a": "\xe9", "A": "\xc9", "c": "\u4e00"}[plain]  # a letter of each kind
        self[code] = plain
        return plain


FOLD = Fold()
DIGIT = re.compile(r"\d")


def outline(token: str) -> tuple[str, bool]:
    """What the shape of a token without digits depends on; tokens with digits are their own outline."""
    return token if DIGIT.search(token) else token.translate(FOLD), bool(NAMES.search(token))


def shape(token: str, named: bool) -> Shape:
    """Features of one token alone, given by its outline."""
    core = token.strip(".-/+")
    digit, low, up = any(c.isdigit() for c in core), any(c.islower() for c in core), any(c.isupper() for c in core)
    n = len(core)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    case_turns = sum(a.isupper() != b.isupper() for a, b in zip(core[1:], core[2:], strict=False))
    is_hex = digit and all(c in "0123456789abcdefABCDEF" for c in core)
    is_name = named and not turns
    mark = len(token) == 1 and not token.isalnum()
    variety = len(set(core)) if digit else 0
    features = (
        _steps(n, (2, 4, 6, 8, 12, 16, 20, 24, 32)),
        10 + _steps(turns, (1, 2, 4, 8)),
        15 + _steps(case_turns, (1, 2, 4, 8)),
        20 + 4 * digit + 2 * low + up,
        28 + is_hex,
        30 + _steps(variety, (4, 6, 8, 10, 14)),
        36 + is_name,
        38 + ("=:\"'".find(token) + 1 if mark and token in "=:\"'" else 5 if mark else 0),
        44 + token.isascii(),
        46 + any(c in "+/_" for c in core),
        48 + (digit and sum(c in "aeiouAEIOU" for c in core) * 5 < n),
        50 + (core.isdigit() and n > 0),
        52 + (digit and turns > 1 and n >= 8),
    )
    group = (
        1 if is_name
        else 2 if mark and token in "=:"
        else 3 if mark and token in "\"'"
        else 4 if mark
        else 5 if core.isdigit()
        else 6 if digit and (low or up)
        else 7 if up and not low
        else 8 if n == 0
        else 0
    )
    form = (digit and (low or up)) * 4 + (n >= 8) * 2 + (n >= 16)
    return Shape(features, group, form)


def file_form(tokens: int, size: int, marks: int) -> int:
    """Features of the whole file: its length in tokens, and how often assignments occur in it."""
    return 3 * (tokens >= 400) + _steps(1000 * marks // max(1, size), (1, 4))


@dataclass(frozen=True)
class Field:
    """Weights by label (outside, begin, inside) on the last axis, and transitions."""

    own: np.ndarray  # features
    before: np.ndarray  # class of the token before
    before2: np.ndarray
    after: np.ndarray
    pair: np.ndarray  # shape and class before
    file: np.ndarray
    step: np.ndarray  # from, to

    @staticmethod
    def zero() -> Field:
        sizes = (N_FEATURES,), (CLASSES,), (CLASSES,), (CLASSES,), (FORMS * CLASSES,), (FILES,), (3,)
        return Field(*(np.zeros((*s, 3)) for s in sizes))

    def parts(self) -> list[np.ndarray]:
        return [self.own, self.before, self.before2, self.after, self.pair, self.file, self.step]

    @property
    def margin(self) -> float:
        """How much transitions can gain at most by putting a token inside a secret."""
        s = self.step
        return float(max(s[a, y] + s[y, b] - s[a, OUT] - s[OUT, b] for y in (BEGIN, IN) for a in range(3) for b in range(3)))


def _neighbours(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the tokens one and two before and one after; at the edges that of nothing (8)."""
    pad = np.concatenate([[8, 8], groups, [8]])
    return pad[1:-2], pad[:-3], pad[3:]


def viterbi(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """The best labels for one stretch."""
    best, back = scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + step
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    labels = [int(best.argmax())]
    for pointers in reversed(back):
        labels.append(int(pointers[labels[-1]]))
    return labels[::-1]


class Tagger:
    """A field with the scores of the outlines it has met, and the outlines of the tokens it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.margin = field.margin
        self.lead = [p[..., :1] - p[..., 1:] for p in field.parts()[:6]]  # of outside, over begin and inside
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, int] = {}
        self.outlines: dict[tuple[str, bool], int] = {}
        self.scores = np.zeros((1024, 3))
        self.groups = np.zeros(1024, np.int64)
        self.forms = np.zeros(1024, np.int64)
        self.open = np.zeros((1024, CLASSES), bool)  # by class before: may be inside, whatever else stands around

    def add(self, token: str) -> int:
        key = outline(token)
        n = self.outlines.get(key)
        if n is None:
            n = self.outlines[key] = len(self.outlines)
            if n == len(self.groups):
                self.scores, self.groups, self.forms, self.open = (
                    np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.groups, self.forms, self.open)
                )
            s = shape(*key)
            own, before, before2, after, pair, file = self.lead
            self.scores[n] = self.field.own[list(s.features)].sum(0)
            self.groups[n], self.forms[n] = s.group, s.form
            least = own[list(s.features)].sum(0) + before2.min(0) + after.min(0) + file.min(0)
            pairs = pair[s.form * CLASSES : (s.form + 1) * CLASSES]
            self.open[n] = (least + before + pairs).min(1) <= self.margin
        self.tokens[token] = n
        return n

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Runs of tokens tagged begin or inside."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.tokens) > KEPT:
            self.clear()
        known, add = self.tokens, self.add
        ids = np.array([known[t] if t in known else add(t) for t in tokens])
        groups = self.groups[ids]
        one, two, after = _neighbours(groups)
        maybe = np.flatnonzero(self.open[ids, one])
        if not len(maybe):
            return []
        field = self.field
        file = field.file[file_form(len(tokens), len(text), int((groups == 2).sum()))]

        def score(i: np.ndarray) -> np.ndarray:
            return (
                self.scores[ids[i]] + field.before[one[i]] + field.before2[two[i]] + field.after[after[i]]
                + field.pair[self.forms[ids[i]] * CLASSES + one[i]] + file
            )

        scores = score(maybe)
        open_at = maybe[scores[:, OUT] - np.maximum(scores[:, BEGIN], scores[:, IN]) <= self.margin]
        if not len(open_at):
            return []
        at = [m.span() for m in TOKEN.finditer(text)]
        found: list[tuple[int, int]] = []
        for stretch in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1):
            # the tokens around a stretch are outside
            first, last = max(stretch[0] - 1, 0), min(stretch[-1] + 1, len(tokens) - 1)
            labels = viterbi(score(np.arange(first, last + 1)), field.step)
            for i, label in enumerate(labels, first):
                if label == BEGIN or label == IN and (i == first or labels[i - first - 1] == OUT):
                    found.append(at[i])
                elif label == IN:
                    found[-1] = (found[-1][0], at[i][1])
        return found


def scan(text: str | None, tagger: Tagger | None) -> list[tuple[str, int, int]]:
    """All spans by start and kind: those of the patterns, and those that the field adds outside them."""
    if not text:
        return []
    base = base_spans(text, text.encode())
    found = list(base)
    for a, b in tagger.spans(text) if tagger else ():
        b -= len(text[a:b]) - len(text[a:b].rstrip("."))
        if b - a >= MIN_ADDED and not any(a < e and s < b for _, s, e in base):
            found.append(("crf", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _windows(texts: list[str], length: int) -> list[tuple]:
    """Training windows of up to ``length`` tokens: feature rows for each token, and its label."""
    out = []
    for text in texts:
        at = [m.span() for m in TOKEN.finditer(text)]
        if not at:
            continue
        shapes = [shape(*outline(text[a:b])) for a, b in at]
        groups = np.array([s.group for s in shapes])
        one, two, after = _neighbours(groups)
        pair = np.array([s.form for s in shapes]) * CLASSES + one
        file = np.full(len(at), file_form(len(at), len(text), int((groups == 2).sum())))
        labels = np.zeros(len(at), np.int64)
        for a, b in sorted(secret_parts(text), reverse=True):
            inside = [i for i, (s, e) in enumerate(at) if s < b and a < e]
            labels[inside] = IN
            labels[inside[:1]] = BEGIN
        own = np.array([s.features for s in shapes])
        rows = np.column_stack([one, two, after, pair, file])
        for i in range(0, len(at), length):
            digit = bool((np.isin(groups[i : i + length], (5, 6, 7))).any())
            out.append((own[i : i + length], rows[i : i + length], labels[i : i + length], digit))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(texts: list[str], length: int = 32, batch: int = 192, steps: int = 150, decay: float = 1e-3, seed: int = 5) -> Field | None:
    """Maximum likelihood by forward and backward sums; None if the texts hold no secret to learn from."""
    windows = [w for w in _windows(texts, length) if len(w[2]) == length]
    kinds = [
        [w for w in windows if w[2].any()],
        [w for w in windows if not w[2].any() and w[3]],
        [w for w in windows if not w[2].any() and not w[3]],
    ]
    if not kinds[0]:
        return None
    rng = np.random.default_rng(seed)
    field = Field.zero()
    parts = field.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    drawn_from = [k for k in kinds if k]
    for turn in range(1, steps + 1):
        drawn = [k[i] for k in drawn_from for i in rng.integers(0, len(k), batch // len(drawn_from))]
        own, rows, labels = (np.stack([w[i] for w in drawn]) for i in range(3))
        n = len(drawn)
        score = parts[0][own].sum(2)
        for j in range(5):
            score += parts[j + 1][rows[:, :, j]]
        step = field.step
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            ahead[:, t] = _logsum(ahead[:, t - 1][:, :, None] + step, 1) + score[:, t]
        for t in range(length - 2, -1, -1):
            behind[:, t] = _logsum(step + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1], 1)
        wrong = np.exp(ahead + behind - total[:, None, None])
        wrong[np.arange(n)[:, None], np.arange(length), labels] -= 1
        pairs = np.exp(
            ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ).sum((0, 1))
        np.subtract.at(pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
        flat = wrong.reshape(-1, 3)
        grads = [np.zeros_like(p) for p in parts[:6]]
        for j in range(own.shape[2]):
            np.add.at(grads[0], own[:, :, j].ravel(), flat)
        for j in range(5):
            np.add.at(grads[j + 1], rows[:, :, j].ravel(), flat)
        for p, g, m, v in zip(parts, [*grads, pairs], first, second, strict=True):  # Adam
            g = g / n + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return field


def train(docs: DataFrame, text_column: str = "text", pool: int = 50_000, each: int = 400, piece: int = 4000) -> Field | None:
    """Fit on at most ``each`` pieces of texts with a key word and as many without, of ``piece`` characters at most.

    They are drawn at random, with a fixed seed for each partition, from a pool of about ``pool`` rows, so the driver holds ``2 * each * piece`` characters.
    """
    text = F.col("text")
    rows = docs.select(F.col(f"`{text_column}`").alias("text")).filter("text <> ''")
    share = min(1.0, pool / max(1, docs.count()))
    words = ("password", "passwd", "secret", "token", "api_key", "apikey", "AKIA")
    named = F.greatest(*(F.instr(text, w) for w in words))
    anywhere = F.pmod(F.xxhash64(F.lit("piece"), text), F.greatest(F.length(text) - piece, F.lit(0)) + 1) + 1
    at = F.when(named > 0, F.greatest(named - piece // 2, F.lit(1))).otherwise(anywhere).cast("int")
    drawn = rows.withColumn("r", F.rand(13)).filter(F.col("r") < share)
    drawn = drawn.filter((named > 0) | (F.col("r") * pool < 4 * each * share))  # texts without abound
    pieces = drawn.select((named > 0).alias("named"), "r", text.substr(at, F.lit(piece)).alias("piece"))
    order = "row_number() OVER (PARTITION BY named ORDER BY r, piece)"
    chosen = pieces.withColumn("n", F.expr(order)).filter(F.col("n") <= each).select("piece")
    return fit(sorted({r["piece"] for r in chosen.collect()}))


def find_secrets(text: Column, field: Field | None) -> Column:
    """Spans of each whole text as (kind, start, end) in code points, end exclusive, by start and kind.

    Kinds are those of the patterns, which don't depend on the field, and ``crf`` for spans that it adds
    where no pattern matches. A null or empty text has none.
    """

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        tagger = Tagger(field) if field else None
        rows = ([{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py(), tagger)] for t in texts)
        return pa.array(rows, SPANS_ARROW)

    return run(text)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by a mark; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, spans_ in zip(texts, found, strict=True):
            value, rows = t.as_py(), spans_.as_py()
            if value is not None and rows:
                parts, at = [], 0
                for s in sorted(rows, key=lambda x: x["start"]):
                    if s["start"] >= at:
                        parts += [value[at : s["start"]], mark]
                    at = max(at, s["end"])
                value = "".join([*parts, value[at:]])
            out.append(value)
        return pa.array(out, pa.string())

    return run(text, spans)
