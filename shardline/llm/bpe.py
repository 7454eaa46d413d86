"""Word BPE by dynamic programming over prefixes, and decoding.

A text is cut and normalised as its tokenizer file says; every word is then encoded alone. For each
prefix of a word exactly one token can come last in the prefix's encoding. An automaton with suffix
links gives all tokens that end at a symbol; of these the one whose predecessor, the last token of the
shorter prefix, is compatible with it is stored. Two tokens are compatible if merging their joined
symbols gives back just these two, which their merge trees tell without merging anything. Back-pointers
from the end of the word give the ids.

No merge list is replayed: work is linear in the symbols, and words are kept so that repeated ones
cost a lookup.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Words (twice as many) and pairs that a Python worker remembers; results don't depend on it.
KEPT_WORDS, KEPT_PAIRS = 120_000, 250_000
NEVER = 1 << 40
#: White space as the tokenizer's \s has it.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Letters and numbers of Unicode 16, and lower-case forms of Unicode 16 and 17, which the tokenizers
#: library knows and Python's tables do not.
NEW = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
        (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
        (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
        (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
        (0x1E5F0, 0x1E5F0),
    ),
    "N": (
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
        (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
    ),
}
LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
LOWER[0x3A3] = 0x3C3  # the capital sigma has one lower-case form, wherever it stands


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@functools.lru_cache
def ranges(kind: str, top: int) -> str:
    """The characters of a general category as a character class, without brackets."""
    new = {c for a, b in NEW[kind] for c in range(a, b + 1)}
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and (unicodedata.category(chr(c))[0] == kind or c in new)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def written_out(pattern: str, top: int) -> str:
    """A split pattern with its letters, numbers and white space as plain ranges, up to a code point."""
    for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N")):
        inside = ranges(kind, top)
        pattern = re.sub(rf"(?<!\[){re.escape(name)}(?![+\]\\])", lambda _, x=inside: f"[{x}]", pattern)
        pattern = pattern.replace(name, inside)
    return pattern.replace(r"\s", SPACE)


class Words(dict):
    """Ids of words, as the bytes of 32-bit integers, worked out when first asked for.

    When it is full, those asked for again come over from the full one and the rest are forgotten.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordBpe:
    """The tokenizer of one file: NFC, white space, lower case, split pattern, bytes, merges with a word end."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut_bmp, self.cut_all = (re.compile(written_out(pattern, top)).findall for top in (0xFFFF, 0x10FFFF))
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

        # A token as a string of symbols: 0 to 255 for bytes, and 256 more for bytes at the end of a word.
        end = model["end_of_word_suffix"]
        of = {letter: b for b, letter in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            body = token.removesuffix(end)
            own = [of[x] for x in body]
            if body != token:
                own[-1] += 256
            return "".join(map(chr, own))

        n = max(self.tokens) + 1
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank
        vocab = model["vocab"]
        made = {}
        for rank, (a, b) in enumerate(model["merges"]):
            t = vocab[a + b]
            self.merged.setdefault((vocab[a], vocab[b]), rank)
            made.setdefault(t, (vocab[a], vocab[b], rank))
        for t, (a, b, rank) in made.items():
            self.left[t], self.right[t], self.rank[t] = a, b, rank
        good: dict[int, bool] = {}

        def sound(t: int) -> bool:
            """Whether a token's own symbols merge to it."""
            if t not in good:
                a, b = self.left[t], self.right[t]
                good[t] = a < 0 or (sound(a) and sound(b) and self.meet(a, b) == (a, b))
            return good[t]

        self.matcher = ahocorasick.Automaton()
        self.whole: dict[str, bytes] = {}
        for token, i in vocab.items():
            if sound(i):
                text = symbols(token)
                self.matcher.add_word(text, (i, len(text)))
                self.whole[text] = np.int32(i).tobytes()
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = Words(self.encode_word)
        n_ids = max(self.tokens) + 1
        self.shown = pa.array([self.tokens.get(i) for i in range(n_ids)], pa.string())

    def meet(self, a: int, b: int) -> tuple[int, int] | None:
        """The parts of a and b that would merge across their border first, or None if none would.

        Along the border lie the right edge of a's merge tree and the left edge of b's. Going up both in order
        of rank gives the parts that are side by side at each time; of equal ranks the left one merges first.
        """
        up_a, up_b = [a], [b]
        while (x := self.right[up_a[-1]]) >= 0:
            up_a.append(x)
        while (x := self.left[up_b[-1]]) >= 0:
            up_b.append(x)
        x, y = up_a.pop(), up_b.pop()
        while True:
            across = self.merged.get((x, y), NEVER)
            next_a = self.rank[up_a[-1]] if up_a else NEVER
            next_b = self.rank[up_b[-1]] if up_b else NEVER
            if across < next_a and across <= next_b:
                return x, y
            if next_a == next_b == NEVER:
                return None
            if next_a <= next_b:
                x = up_a.pop()
            else:
                y = up_b.pop()

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        fits = self.pairs[key] = self.meet(a, b) is None
        return fits

    def encode_word(self, word: str) -> bytes:
        data = word.encode()
        text = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        if text in self.whole:
            return self.whole[text]
        last = [-1] * len(text)  # the last token of each prefix
        size = [0] * len(text)
        known = self.pairs.get
        for at, (token, n) in self.matcher.iter(text):
            if last[at] < 0:
                if at < n:
                    last[at], size[at] = token, n
                    continue
                before = last[at - n]
                fits = known(before << 32 | token)
                if self.compatible(before, token) if fits is None else fits:
                    last[at], size[at] = token, n
        out, at = array("i"), len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1].tobytes()

    def encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER)
        text = text.lower()
        cut = self.cut_bmp if text.isascii() or max(text) <= "\uffff" else self.cut_all
        return b"".join(map(self.words.__getitem__, cut(text)))

    def encode(self, text: str) -> np.ndarray:
        if self.at_special is None or not self.at_special.search(text):
            data = self.encode_plain(text)
        else:
            data = b"".join(
                np.int32(self.special[x]).tobytes() if i % 2 else self.encode_plain(x)
                for i, x in enumerate(self.at_special.split(text))
            )
        return np.frombuffer(data, np.int32)


@functools.lru_cache(maxsize=2)  # in each Python worker
def tokenizer(packed: bytes) -> WordBpe:
    return WordBpe(json.loads(zlib.decompress(packed)))


def load(path: str) -> bytes:
    """A tokenizer file, read once by the driver and sent with the functions that use it."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def encode_batch(texts: pa.Array, packed: bytes) -> pa.ListArray:
    bpe = tokenizer(packed)
    ids = [bpe.encode(t.as_py() or "") for t in texts]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
    values = pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def decode_batch(lists: pa.ListArray, packed: bytes) -> pa.StringArray:
    shown = tokenizer(packed).shown
    ids, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(shown))), False)
    tokens = shown.take(pc.if_else(known, ids, None))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if tokens.null_count:
        good = pc.is_valid(tokens).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(good)])[ends]
        tokens = tokens.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")


def encode(text: Column, packed: bytes) -> Column:
    """Ids of each whole text (array of int), as its tokenizer gives them without adding special tokens.

    The special tokens' own strings in a text become their ids. A null or empty text, or one of white
    space, has no ids.
    """

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return encode_batch(texts, packed)

    return run.asNondeterministic()(text)  # else its users would each run it again


def decode(ids: Column, packed: bytes) -> Column:
    """The tokens of each id list joined by a space, special ones too; null gives the empty text.

    Such files have no decoder, so their word ends stay visible. Unknown ids are left out.
    """

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        return decode_batch(lists, packed)

    return run(ids)


def round_trip(text: Column, packed: bytes) -> Column:
    """``ids`` as of encode and ``decoded`` as of decode, in one worker with one set of tables."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def run(texts: pa.Array) -> pa.Array:
        ids = encode_batch(texts, packed)
        return pa.StructArray.from_arrays([ids, decode_batch(ids, packed)], names=["ids", "decoded"])

    return run(text)
