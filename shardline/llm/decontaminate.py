"""Benchmark passages in documents, found by one Aho-Corasick automaton over normalised words.

Text is lower-cased in A-Z and cut to words of digits, letters and anything beyond ASCII, on UTF-8
bytes: all bytes of a longer character are word bytes. Words are joined by one space, so every
window of an item's words is a string that begins and ends at a space, and one pass of the automaton
over a document finds all occurrences of all windows. Words map back to offsets in the
original text.
"""

from __future__ import annotations

import functools
import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardline.session import cut_lineage

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# word bytes as they are, A-Z in lower case, all others a space
NORMAL = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
#: Nodes (about 40 bytes each) that one automaton may have; larger benchmarks are scanned in several passes.
NODES = 8 << 20

FOUND = "struct<n_words: bigint, hits: array<int>, items: array<string>, spans: array<struct<start: int, end: int>>>"
FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


@functools.lru_cache(maxsize=1)  # one in a Python worker at a time
def automaton(items: tuple[tuple[str, bytes], ...], size: int) -> ahocorasick.Automaton:
    """All windows of ``size`` words, with the numbers of the items they come from."""
    windows: dict[bytes, tuple[int, set[int]]] = {}
    for number, (_, text) in enumerate(items):
        own = words(text)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(b" " + b" ".join(own[i : i + n]) + b" ", (n, set()))[1].add(number)
    found = ahocorasick.Automaton()
    for window, value in windows.items():
        found.add_word(window.decode("latin-1"), value)  # a character for each byte
    if windows:
        found.make_automaton()
    return found


def scan(text: bytes, found: ahocorasick.Automaton, ids: list[str], before: dict | None = None) -> dict:
    """Words, numbers of the words hit, item ids and hit runs as code points; ``before``: of an earlier pass."""
    own = words(text)
    out = before or {"n_words": len(own), "hits": [], "items": [], "spans": []}
    if not own or not len(found):
        return out
    line = b" " + b" ".join(own) + b" "
    matches = [(end, *value) for end, value in found.iter(line.decode("latin-1"))]
    if not matches:
        return out
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # word i lies between spaces i and i + 1
    last = np.searchsorted(spaces, [m[0] for m in matches])
    edges = np.zeros(len(own) + 1, np.int32)
    np.add.at(edges, last - [m[1] for m in matches], 1)
    np.add.at(edges, last, -1)
    hit = np.cumsum(edges[:-1]) > 0
    hit[out["hits"]] = True
    at = [m.span() for m in WORD.finditer(text.lower())]  # bytes.lower() changes A-Z alone
    turns = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    letters = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    return {
        "n_words": len(own),
        "hits": np.flatnonzero(hit).tolist(),
        "items": sorted({ids[i] for m in matches for i in m[2]}.union(out["items"])),
        "spans": [
            {"start": int(letters[at[a][0]]) - 1, "end": int(letters[at[b - 1][1] - 1])}
            for a, b in zip(turns[::2], turns[1::2], strict=True)
        ],
    }


def _scanner(items: tuple[tuple[str, bytes], ...], size: int):
    ids = [i for i, _ in items]

    def run(texts: pa.Array, *before: pa.Array) -> pa.Array:
        found = automaton(items, size)
        earlier = before[0] if before else itertools.repeat(None)
        rows = (
            scan(text.as_py() or b"", found, ids, old and old.as_py())
            for text, old in zip(texts.cast(pa.binary()), earlier, strict=False)
        )
        return pa.array(rows, FOUND_ARROW)

    run.__annotations__ = {"texts": pa.Array, "before": pa.Array, "return": pa.Array}
    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    size: int = 13,
    one_in: int = 20,
    nodes: int = NODES,
    item_bytes: int | None = None,
    into: str = "found",
) -> DataFrame:
    """The documents with a column ``into``: n_words, n_hit, hits (word numbers), items, spans, contaminated.

    A window is ``size`` consecutive words of an item, or all words of a shorter one. A document word
    inside any occurrence of a window is hit; ``spans`` are maximal runs of hit words as code points of the
    original text. A document is contaminated if any word is hit and at least one in ``one_in``.
    Null or wordless texts have no words and aren't contaminated; rows that repeat an item id
    are one item; a null item id is written as the empty string. Other columns stay as they are; one
    called ``into`` is replaced. Without items nothing is hit.

    The items are broadcast in parts whose automata have about ``nodes`` nodes, ``size`` + 1 for each byte at most (or parts of
    about ``item_bytes`` of text, where that makes more): a benchmark within that bound takes one
    pass over the documents. A larger one takes a pass for each part, with the documents written between
    passes to the shared folder, so that a worker holds one part's automaton at a time. An item is never cut, so
    one beyond the bound makes a larger part.
    """
    named = items.select(
        F.coalesce(F.col(f"`{item_column}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{item_text_column}`").alias("text"),
    ).filter("text is not null")
    total = named.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(1, -(-total * (size + 1) // nodes), -(-total // item_bytes) if item_bytes else 1)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    text = F.col(f"`{text_column}`")
    docs, found = docs.drop(into), F.col(f"`{into}`")
    for k in range(parts):
        rows = tuple((r["id"], r["text"].encode()) for r in named.filter(part == k).collect())  # one part
        scanner = F.arrow_udf(_scanner(rows, size), FOUND)
        docs = docs.withColumn(into, scanner(text, found) if k else scanner(text))
        if k < parts - 1:
            docs = cut_lineage(docs, "contamination")
    n_hit = F.size(found["hits"]).cast("long")
    return docs.withColumn(
        into,
        F.struct(
            found["n_words"].alias("n_words"),
            n_hit.alias("n_hit"),
            found["hits"].alias("hits"),
            found["items"].alias("items"),
            found["spans"].alias("spans"),
            ((n_hit > 0) & (n_hit * one_in >= found["n_words"])).alias("contaminated"),
        ),
    )
