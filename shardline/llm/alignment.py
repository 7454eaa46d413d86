"""Alignment of two tokenizers through inverted pair bitmaps.

Both tokenizers cut the same bytes, so tokens are linked where their byte ranges overlap, and places where both end a token
cut a text into groups. Every pair of linked ids has a posting for each container of documents: the set of
documents in which the pair's number of links has bit k, for each k, as a compressed bitmap (a sorted array of
16-bit positions, or plain bits where that is shorter). The OR of these multiplicity planes are the documents with the
pair, so popcounts give document counts, and popcounts times powers of two link counts. Containers hold different
documents, so a pair's counts add up over them. Corpus-wide counts then meet the postings, and these say which documents get
them and how often.

Containers are closed at a bound of text, so postings, joins and groups are bounded whatever the corpus; documents are known by
container and position, never by their id.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from shardline.llm.bpe import byte_letters, load
from shardline.session import cut_lineage

__all__ = ["document_scores", "index_pairs", "load", "pair_counts"]

#: A container is closed when it holds so many bytes of text or so many documents.
CONTAINER_BYTES, CONTAINER_ROWS = 16 << 20, 1 << 16
#: Rows of a record batch.
SENT = 1 << 16
#: Fixed value: how byte-level files without a pattern of their own split texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other letters, on whose kind libraries of different age may not agree, or white space too long for one of them.
ODD = re.compile(r"[^\x00-ɏ]|\s{4000}")


class ByteTokens:
    """A byte-level tokenizer file (byte_bpe): ids of a text, and the bytes of each id.

    Where the file merges in order of its ids, tiktoken gives the same ids faster, and is used for texts of plain letters.
    """

    def __init__(self, packed: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        text = zlib.decompress(packed).decode()
        spec = json.loads(text)
        self.plain = Tokenizer.from_str(text)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.encode_special_tokens = True
        vocab = spec["model"]["vocab"]
        of = {letter: b for b, letter in enumerate(byte_letters())}
        known = {i: bytes(of[x] for x in t) for t, i in vocab.items() if all(x in of for x in t)}
        self.bytes = [known.get(i, b"\xff") for i in range(max(vocab.values()) + 1)]  # 0xFF is in no text
        merged = [vocab["".join(m)] for m in spec["model"]["merges"]]
        cut = spec["pre_tokenizer"]
        ordered = len(known) == len(vocab) and all(a < b for a, b in zip(merged, merged[1:], strict=False))
        usual = cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]
        self.fast = None
        if ordered and usual and not spec["model"].get("ignore_merges"):
            ranks = {b: i for i, b in known.items()}
            self.fast = tiktoken.Encoding("byte", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        fast = self.fast
        return [
            fast.encode_ordinary(t) if fast and not ODD.search(t) else self.plain.encode(t, add_special_tokens=False).ids
            for t in texts
        ]


class PieceTokens:
    """A piece model with byte fallback (piece_bpe), which puts a space before a text by itself."""

    def __init__(self, packed: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=zlib.decompress(packed))
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [
            bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(ids, pieces, strict=True)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1 as bytes, with zero bytes before them."""
    width = len(str(max(n - 1, 0)))
    return np.frombuffer(b"".join(str(i).encode().rjust(width, b"\0") for i in range(n)), np.uint8).reshape(n, width)


class Linker:
    """Links of batches of texts."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.digits = _digits(max(len(self.a.bytes), len(self.b.bytes)))
        self.width = (self.digits > 0).sum(1) + 1  # with a separator

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """Which texts have tokens, and these."""
        full = [i for i, t in enumerate(texts) if t]
        ids_a, ids_b = self.a.encode([" " + texts[i] for i in full]), self.b.encode([texts[i] for i in full])
        good, kept_a, kept_b = [], [], []
        for i, x, y in zip(full, ids_a, ids_b, strict=True):
            data = b" " + texts[i].encode()
            if b"".join(map(self.a.bytes.__getitem__, x)) == data == b"".join(map(self.b.bytes.__getitem__, y)):
                good.append(i)
                kept_a.append(x)
                kept_b.append(y)
        return np.array(good, np.int64), kept_a, kept_b

    def link(self, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
        """Columns of each text; of every link the text's number and the two ids."""
        n = len(texts)
        good, lists_a, lists_b = self.encode(texts)
        rows = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [""] * n
        if not len(good):
            none = np.empty(0, np.int64)
            return {**rows, "groups_sha256": digests}, none, none, none
        count_a, count_b = (np.array([len(x) for x in lists]) for lists in (lists_a, lists_b))
        ids_a, ids_b = (np.concatenate([np.array(x, np.int64) for x in lists]) for lists in (lists_a, lists_b))
        # Texts follow each other; as both sides have the same bytes, both end at every text's end.
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")
        ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])]
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # a link ends at each of these
        text = np.repeat(np.arange(len(good)), count_a)[at_a]
        both = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        rows["n_a"][good], rows["n_b"][good] = count_a, count_b
        rows["n_groups"][good] = np.bincount(text[both], minlength=len(good))
        rows["n_links"][good] = np.bincount(text, minlength=len(good))
        groups = ends[both], at_a[both] + 1, at_b[both] + 1
        for i, digest in zip(good, self._digests(ids_a, ids_b, end_a, end_b, *groups, count_a + count_b), strict=True):
            digests[i] = digest
        return {**rows, "groups_sha256": digests}, good[text], ids_a[at_a], ids_b[at_b]

    def _digests(self, ids_a, ids_b, end_a, end_b, cuts, past_a, past_b, counts) -> list[str]:
        """Digests of the texts' groups. Groups end at ``cuts`` and before tokens ``past_a`` and ``past_b``."""
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        i, j = np.arange(len(ids_a)), np.arange(len(ids_b))
        place_a, place_b = i + np.concatenate([[0], past_b[:-1]])[group_a], j + past_a[group_b]
        ids, marks = np.empty(len(i) + len(j), np.int64), np.empty(len(i) + len(j), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        marks[place_a] = np.where(i + 1 == past_a[group_a], ord("|"), ord(","))
        marks[place_b] = np.where(j + 1 == past_b[group_b], ord(";"), ord(","))
        shown = np.column_stack([self.digits[ids], marks]).ravel()
        shown = shown[shown != 0]
        to = np.cumsum(self.width[ids])[np.cumsum(counts) - 1]
        return [hashlib.sha256(shown[a : b - 1]).hexdigest() for a, b in zip([0, *to[:-1]], to, strict=True)]


@functools.lru_cache(maxsize=1)  # in each Python worker
def linker(a: bytes, b: bytes) -> Linker:
    return Linker(a, b)


def pack_planes(pair: np.ndarray, at: np.ndarray, times: np.ndarray, pairs: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pairs' planes one after the other, and where each pair's end.

    Entries come sorted by pair and position. A plane that isn't empty is a byte 2k for an array or 2k + 1 for plain
    bits, the length in 4 bytes, and the data.
    """
    plain = -(-rows // 8)
    planes = []
    for k in range(int(times.max(initial=0)).bit_length()):
        chosen = (times >> k & 1).astype(bool)
        owner, low = pair[chosen], at[chosen]
        count = np.bincount(owner, minlength=pairs)
        dense = 2 * count > plain
        planes.append((k, owner, low, count, dense, np.where(dense, plain, 2 * count)))
    sizes = sum((np.where(x[3] > 0, x[5] + 5, 0) for x in planes), np.zeros(pairs, np.int64))
    ends = np.cumsum(sizes)
    out, start = np.zeros(int(sizes.sum()), np.uint8), ends - sizes
    for k, owner, low, count, dense, size in planes:
        here = np.flatnonzero(count)
        out[start[here]] = 2 * k + dense[here]
        for byte in range(4):
            out[start[here] + 1 + byte] = size[here] >> (8 * byte) & 255
        first = np.cumsum(count) - count
        sparse = ~dense[owner]
        place = (start[owner] + 5 + 2 * (np.arange(len(owner)) - first[owner]))[sparse]
        out[place], out[place + 1] = low[sparse] & 255, low[sparse] >> 8
        for p in np.flatnonzero(dense):
            bits = np.zeros(8 * plain, np.uint8)
            bits[low[first[p] : first[p] + count[p]]] = 1
            out[start[p] + 5 : start[p] + 5 + plain] = np.packbits(bits, bitorder="little")
        start = start + np.where(count > 0, size + 5, 0)
    return out, ends


def unpack_planes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per step k and the (posting, position) entries of planes with that k; every plane comes once."""
    cursor, open_ = start.astype(np.int64), np.flatnonzero(start < end)
    while len(open_):
        at = cursor[open_]
        tag = data[at]
        size = sum(data[at + 1 + byte].astype(np.int64) << (8 * byte) for byte in range(4))
        for kind in np.unique(tag):
            these = tag == kind
            owner, begin, length = open_[these], at[these] + 5, size[these]
            if kind % 2:
                lows = [np.flatnonzero(np.unpackbits(data[b : b + n], bitorder="little")) for b, n in zip(begin, length, strict=True)]
                yield int(kind) // 2, np.repeat(owner, [len(x) for x in lows]), np.concatenate(lows)
            else:
                n = length // 2
                place = np.repeat(begin - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(n.sum())
                yield int(kind) // 2, np.repeat(owner, n), data[place].astype(np.int64) | data[place + 1].astype(np.int64) << 8
        cursor[open_] = at + 5 + size
        open_ = open_[cursor[open_] < end[open_]]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())


POSTING = {"a": pa.int32(), "b": pa.int32(), "docs": pa.int64(), "links": pa.int64(), "planes": pa.binary()}
DOCUMENT = {
    "low": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()
}
SQL_TYPE = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


class Container:
    """Documents in a row and their links, until they are given out."""

    def __init__(self, key: int):
        self.key, self.rows, self.size = key, 0, 0
        self.ids: list[pa.Array] = []
        self.columns: list[dict[str, list]] = []
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, texts: pa.Array, link: Linker) -> None:
        columns, row, a, b = link.link(texts.to_pylist())
        # one sorted run of (pair, position) and how often; runs of different batches never share a document
        run = np.unique((a << 40) | (b << 16) | (row + self.rows), return_counts=True)
        columns["low"] = np.arange(self.rows, self.rows + len(texts))
        self.ids.append(ids)
        self.columns.append(columns)
        self.runs.append(run)
        self.rows += len(texts)
        self.size += texts.nbytes

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of the documents, then of the postings; the columns of the other kind are null."""
        ids = pa.concat_arrays(self.ids)
        columns = {k: pa.concat_arrays([pa.array(c[k], t) for c in self.columns]) for k, t in DOCUMENT.items()}
        yield from self._sent(self.rows, {"id": ids, **columns}, ids.type)
        keys, times = (np.concatenate([r[i] for r in self.runs]) for i in range(2))
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        if not len(keys):
            return
        pairs = keys >> 16
        first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        number, pairs = np.cumsum(first) - 1, pairs[first]
        data, ends = pack_planes(number, keys & 0xFFFF, times, len(pairs), self.rows)
        docs = np.bincount(number)  # what the OR of a pair's planes holds
        links = np.zeros(len(pairs), np.int64)
        for k, owner, _ in unpack_planes(data, ends - np.diff(ends, prepend=0), ends):
            links += np.bincount(owner, minlength=len(pairs)) << k
        found = (pairs >> 24, pairs & 0xFFFFFF, docs, links)
        columns = {k: pa.array(x, t) for (k, t), x in zip(POSTING.items(), found, strict=False)}
        yield from self._sent(len(pairs), {**columns, "planes": _binary(data, ends)}, ids.type)

    def _sent(self, rows: int, columns: dict[str, pa.Array], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        kinds = {"container": pa.int64(), "id": id_type, **DOCUMENT, **POSTING}
        columns = {"container": pa.array(np.full(rows, self.key, np.int64)), **columns}
        for at in range(0, rows, SENT):
            n = min(SENT, rows - at)
            yield pa.RecordBatch.from_arrays(
                [columns[k].slice(at, n) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds)
            )


def index_pairs(docs: DataFrame, id_column: str, text_column: str, a: bytes, b: bytes) -> DataFrame:
    """Documents and postings in one table of the shared folder, written once: every text is encoded once.

    ``a`` is a byte-level file and ``b`` a piece model, both as ``load`` gives them. A row is a document
    (``id``, ``low``, ``n_a`` to ``groups_sha256``) or a posting (``a``, ``b``, ``docs``, ``links``, ``planes``) of a
    ``container``. Texts that are null, empty or whose tokens of either side don't give back the space and the text
    have no tokens: zeros and an empty digest. Ids of any type may be null or repeat; further columns are left out.
    A text is one value and its tokens are held in one task.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, key = linker(a, b), TaskContext.get().partitionId() << 32
        held = Container(key)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), CONTAINER_ROWS // 4):
                part = slice(at, min(at + CONTAINER_ROWS // 4, len(texts)))
                n = part.stop - part.start
                if held.rows and (held.size >= CONTAINER_BYTES or held.rows + n > CONTAINER_ROWS):
                    yield from held.batches()
                    key += 1
                    held = Container(key)
                held.add(ids.slice(at, n), texts.slice(at, n), link)
        if held.rows:
            yield from held.batches()

    named = ", ".join(f"{k} {SQL_TYPE[t]}" for k, t in {**DOCUMENT, **POSTING}.items())
    schema = f"container long, id {rows.schema['id'].dataType.simpleString()}, {named}"
    return cut_lineage(rows.mapInArrow(run, schema), "pairs")


def pair_counts(index: DataFrame) -> DataFrame:
    """Of every pair of linked ids the number of documents (rows) with such a link and of links, over the whole corpus."""
    postings = index.filter("a IS NOT NULL")
    return postings.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))


def document_scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """The index's documents, with ``n_best`` and ``count_sum``.

    ``count_sum`` adds up, over a document's links, how many links of the corpus have the same pair; ``n_best``
    counts the links whose pair is the most frequent (or as frequent) of its ``b``. Counts meet the postings by
    pair, and each container's postings then give them to its documents.
    """
    best = counts.groupBy("b").agg(F.max("links").alias("most"))
    # one row for each token of the vocabulary at most
    marked = counts.join(F.broadcast(best), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))
    postings = index.filter("a IS NOT NULL").select(F.col("container").alias("home"), "a", "b", "planes")
    # counts grow with the corpus, so they are never broadcast
    scored = postings.join(marked.hint("merge"), ["a", "b"]).select("home", "links", "best", "planes")
    documents = index.filter("low IS NOT NULL").select("container", "id", *DOCUMENT)

    def give(docs: pa.Table, found: pa.Table) -> pa.Table:
        low = docs["low"].to_numpy()
        totals = np.zeros((2, low.max(initial=-1) + 1), np.int64)
        if found.num_rows and docs.num_rows:
            links, best = found["links"].to_numpy(), found["best"].to_numpy(zero_copy_only=False).astype(np.int64)
            planes = pa.concat_arrays(found["planes"].cast(pa.large_binary()).chunks)
            offsets = np.frombuffer(planes.buffers()[1], np.int64)[planes.offset : planes.offset + len(planes) + 1]
            data = np.frombuffer(planes.buffers()[2], np.uint8)
            for k, owner, at in unpack_planes(data, offsets[:-1], offsets[1:]):
                np.add.at(totals[0], at, links[owner] << k)
                np.add.at(totals[1], at, best[owner] << k)
        out = docs.drop_columns(["container", "low"])
        return out.append_column("n_best", pa.array(totals[1][low])).append_column("count_sum", pa.array(totals[0][low]))

    named = ", ".join(f"{k} {SQL_TYPE[t]}" for k, t in DOCUMENT.items() if k != "low")
    schema = f"id {index.schema['id'].dataType.simpleString()}, {named}, n_best long, count_sum long"
    return documents.groupBy("container").cogroup(scored.groupBy("home")).applyInArrow(give, schema)
