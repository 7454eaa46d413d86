"""Near-duplicates by SimHash, linked through the anchor points of a covering code.

A fingerprint has 64 bits; two link if they differ in at most ``bits`` of them. The anchors are pairs of
codewords of the binary Golay code on the first and second 23 bits. That code is perfect: every 23-bit
word lies within 3 bits of exactly one codeword, its home. If u and v differ in t bits, then v lies within
3 + t bits of u's home, the t being shared by both blocks. So each fingerprint is sent once to its home
and replicated to every anchor within covering radius plus threshold, and per anchor those at home are compared
with the replicas: no link is lost and each is found once. Equal fingerprints are one node
before that, so copies cost nothing, and a node has at most 1 + 64 + 2016 neighbours (for two bits).

Components come from alternating large and small stars, each round a combined minimum and a join,
written to the shared folder.
"""

from __future__ import annotations

import functools
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from shardline.llm.batches import unused
from shardline.session import cut_lineage

SEED = 42
WIDTH, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code (fixed value): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Shingles whose bits are held at a time.
STEP = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of a text's shingles, as a signed 64-bit number; a text without words has 0."""
    own = text.lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not own:
        return 0
    line = b" ".join(own)
    ends = list(accumulate(len(w) + 1 for w in own))
    n = max(1, len(own) - words + 1)
    starts, stops = [0, *ends[: n - 1]], ends[min(words, len(own)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        span = zip(starts[at : at + STEP], stops[at : at + STEP], strict=True)
        hashes = np.array([xxh64_intdigest(line[a : b - 1], SEED) for a, b in span], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """Fingerprint of each whole text (a long); a null text has no words."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_py() or b"", words) for t in texts.cast(pa.binary())), pa.int64())

    return run(text)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator: 0 for codewords, and equal for words that differ by one."""
    rest = words.copy()
    for bit in range(WIDTH - 1, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@functools.lru_cache(maxsize=4)
def _cosets(bits: int) -> list[list[np.ndarray]]:
    """Per syndrome and excess e up to ``bits``: what to flip to reach the codewords at distance RADIUS + e.

    Excess 0 stands for the home, at whatever distance up to the radius.
    """
    flips = [[0]] + [[sum(1 << i for i in c) for c in combinations(range(WIDTH), k)] for k in range(1, RADIUS + bits + 1)]
    out: list[list[np.ndarray]] = [[] for _ in range(1 << 11)]
    for excess in range(bits + 1):
        level = np.array(sum(flips[: RADIUS + 1], []) if excess == 0 else flips[RADIUS + excess], np.int64)
        of = _syndrome(level)
        order = np.argsort(of, kind="stable")
        for s, part in enumerate(np.split(level[order], np.searchsorted(of[order], np.arange(1, 1 << 11)))):
            out[s].append(part)
    return out


def anchors(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """Per fingerprint its anchors, home first."""
    cosets = _cosets(bits)
    low, high = prints & ((1 << WIDTH) - 1), prints >> WIDTH & ((1 << WIDTH) - 1)
    out = []
    for a, b, s, t in zip(low.tolist(), high.tolist(), _syndrome(low), _syndrome(high), strict=True):
        left = [(a ^ e) << WIDTH for e in cosets[s]]
        right = [b ^ e for e in cosets[t]]
        parts = [(left[i][:, None] | right[j]).ravel() for i in range(bits + 1) for j in range(bits + 1 - i)]
        out.append(np.concatenate(parts))
    return out


def _anchored(print_column: Column, bits: int) -> Column:
    @F.arrow_udf("array<long>")
    def run(prints: pa.Array) -> pa.Array:
        own = anchors(prints.to_numpy(zero_copy_only=False), bits)
        ends = np.cumsum([0, *map(len, own)])
        values = np.concatenate([np.empty(0, np.int64), *own])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))

    return run(print_column)


def links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in column ``print`` that differ in 1 to ``bits`` bits, each once."""
    placed = cut_lineage(nodes.select("print", _anchored(F.col("print"), bits).alias("anchors")), "anchors")
    home = placed.select(F.col("anchors")[0].alias("anchor"), F.col("print").alias("a"))
    replicas = placed.select(F.explode("anchors").alias("anchor"), F.col("print").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return home.join(replicas.hint("merge"), (home.anchor == replicas.anchor) & near).select("a", "b")


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as m.

    The least are written first: a node with very many neighbours can be split in a join of two written tables.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = cut_lineage(low, "least")
    return edges.join(low.hint("merge"), "u")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of the pairs (a, b)."""
    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large, "large-star")
        low = _least(large)
        small = low.select("u", F.col("m").alias("v")).unionByName(
            low.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = cut_lineage(small.distinct(), "small-star")
        now = edges.agg(F.count("u"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == before:  # stars
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 2) -> DataFrame:
    """Id, ``text_hash``, ``print``, ``root`` and ``component_id`` of every row: the smallest id reachable over links.

    Texts are lowered in A-Z and cut at ASCII white space into shingles of three words; a shorter text is
    one shingle, a text without words (or null) has fingerprint 0 and links like any other. Null ids take
    part but name no component, unless a component has no other. Repeated rows and copies share a
    fingerprint. ``text_hash`` tells rows of one id apart, ``root`` (the least print) components without ids. An empty table gives an empty one.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.xxhash64(F.col(f"`{text_column}`")).alias("text_hash"),
        fingerprints(F.col(f"`{text_column}`")).alias("print"),
    )
    rows = cut_lineage(rows, "fingerprints")
    nodes = rows.groupBy("print").agg(F.min("id").alias("least"))
    roots = components(links(nodes, bits)).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.select("print", "root").join(named, "root").select("print", "root", "component_id")
    return rows.join(of_print, "print").select(F.col("id").alias(id_column), "text_hash", "print", "root", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 2) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays, once.

    All columns of ``docs`` come back as they are, whatever their names. Of rows with that id the one with the smaller text hash stays; a component without ids keeps one row.
    """
    found = near_duplicates(docs, id_column, text_column, bits)
    owner = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null")).alias("owner")
    one = F.min(F.struct(F.col(f"`{id_column}`").isNull(), F.col(f"`{id_column}`"), "text_hash", owner)).alias("kept")
    # a component is named by its smallest id; those without ids are told apart by their root
    kept = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("root"))).agg(one)
    kept = kept.select("kept.owner", F.col("kept.text_hash").alias("hash"))
    names = [unused(docs.columns, "owner"), unused(docs.columns, "hash")]
    marked = docs.withColumns(dict(zip(names, (owner, F.xxhash64(F.col(f"`{text_column}`"))), strict=True)))
    marked = marked.dropDuplicates(names)
    return marked.join(kept.toDF(*names), names, "left_semi").drop(*names)
