"""Removal of every byte in a long string that occurs more than once, by run-length compressed suffix indexes.

Each string of ``length`` bytes chooses an anchor, the one of its substrings of ``GRAM`` bytes with the smallest
hash, and equal strings choose the same. Neighbouring strings mostly share their anchor; the bytes that
they span are its context. So anchors with equal hashes are where to look, and the rest of the corpus
needs no comparison:

* anchors whose hash occurs once are dropped, after a count that is combined before the shuffle;
* anchors whose whole context occurs more than once are covered without looking further, however many
  copies there are;
* the other contexts meet, a representative of each distinct one, in buckets of bounded size. There, those that share
  no window with another of their anchor are left out, as a match holds such a window. The rest of a bucket is indexed by its
  run-length Burrows-Wheeler transform. At the ends of runs suffix positions are sampled and their
  common prefixes with the preceding suffix compared; all others follow by stepping through
  the text. This gives for each position the longest match elsewhere (its matching statistic), streamed
  over the contexts to mark matches of ``length`` bytes;
* contexts of an anchor that has too many distinct ones for a bucket are cut into their strings, whose hashes
  are counted, combined before the shuffle as well.

An anchor gets a symbol of its own in the index, so that matches across it are matches of the same
anchor at the same place, and never a text with itself.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from shardline.llm.batches import bounded_batches
from shardline.session import cut_lineage

GRAM = 40
#: Bytes hashed at a time.
STEP = 1 << 20
#: Distinct contexts in a bucket, and most that one anchor may bring to one.
BUCKET, CROWD = 4000, 8000
BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses
#: Windows of a string, in one of which a match of the string is seen, and contexts written at a time.
WINDOWS, ROWS = 8, 8192
PLACE = np.uint64((1 << 21) - 1)  # more than the substrings of a step


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of BASE and of its inverse."""
    inverse = pow(BASE, -1, 1 << 64)
    values = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)
    out = []
    for base in (BASE, inverse):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return values, *out


class Hashes:
    """Hashes of substrings of one piece of bytes, equal for equal substrings of any piece."""

    def __init__(self, data: np.ndarray, room: int):
        values, powers, self.inverse = _powers(room)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def of_length(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours."""
    f, have = (np.minimum if least else np.maximum), 1
    while have * 2 <= width:
        x, have = f(x[:-have], x[have:]), have * 2
    rest = width - have
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of texts behind each other (text i from starts[i] to starts[i + 1]).

    ``place`` and the first and last start of the strings that chose it, all in data, its hash ``gram``
    and that of its ``context``, which lies from the first start to ``length`` beyond the last.
    """
    width = length - GRAM + 1
    n_starts = len(data) - length + 1
    edges = np.zeros(len(data) + 1, np.int32)
    whole = np.diff(starts) >= length
    np.add.at(edges, starts[:-1][whole], 1)
    np.add.at(edges, starts[1:][whole] - length + 1, -1)
    valid = np.cumsum(edges[:-1]) > 0  # strings of full length start here
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("place", "first", "last", "gram", "context")}
    for s in range(0, max(0, n_starts), STEP):
        # a string more before, to see where strings with one anchor begin, and all that may go on behind
        low, stop = max(0, s - 1), min(s + STEP + width, n_starts)
        hashes = Hashes(data[low : stop + length - 1], STEP + 4 * length)
        gram = _mix(hashes.of_length(GRAM))
        # the hash with its low bits replaced by the place: of equal ones the first is least
        chosen = _sliding((gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64), width, True) & PLACE
        chosen = np.where(valid[low:stop], chosen.astype(np.int64), -1)
        turn = np.flatnonzero(np.diff(chosen, prepend=-2, append=-2))
        first, last, place = turn[:-1], turn[1:] - 1, chosen[turn[:-1]]
        own = (place >= 0) & (first + low >= s) & (first + low < s + STEP)
        first, last, place = first[own], last[own], place[own]
        shape = ((place - first) * (2 * length) + last - first).astype(np.uint64)
        context = _mix(hashes.of(first, last + length) + _mix(shape + np.uint64(1)))
        for k, v in (("place", place + low), ("first", first + low), ("last", last + low)):
            found[k].append(v)
        found["gram"].append(gram[place].view(np.int64))
        found["context"].append(context.view(np.int64))
    return {k: np.concatenate([np.empty(0, np.int64), *v]) for k, v in found.items()}


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the place of each in it; only suffixes that still tie are sorted again.

    As many symbols as fit a number (three or four of a bucket's) are compared at once to begin with.
    """
    n = len(text)
    width = max(1, int(text.max() + 1).bit_length())  # 0 stands for what lies behind the end
    step = max(1, 63 // width)
    ahead = np.zeros(n + step, np.int64)
    ahead[:n] = text + 1
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << width | ahead[i : n + i]
    order = np.argsort(key)
    ranked = key[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = ~(first & np.append(first[1:], True))
    open_at = np.flatnonzero(tied)  # places in the order
    while len(open_at):
        suffix = order[open_at]
        behind = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + behind  # under 2^63 up to three thousand million symbols
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_at] = suffix  # a group keeps its places
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(first, open_at, 0))
        open_at = open_at[~(first & np.append(first[1:], True))]
        step *= 2
    return order, rank


def matching_statistics(text: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string from there that also starts elsewhere.

    The last symbol must be unique.
    """
    n = len(text)
    order, rank = suffix_array(text)
    bwt = text[order - 1]
    heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # the first suffix of each run but the first
    sampled, above = order[heads], order[heads - 1]
    common = np.zeros(len(heads), np.int64)
    going = np.arange(len(heads))
    while len(going):  # a unique last symbol ends every comparison
        a, b = sampled[going] + common[going], above[going] + common[going]
        inside = np.maximum(a, b) < n
        same = inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        going = going[same]
        common[going] += 1
    # inside a run the common prefix with the suffix above is one less than at the position before
    known = np.full(n, -1)
    known[order[0]], known[sampled] = 0, common
    at = np.maximum.accumulate(np.where(known >= 0, np.arange(n), -1))
    with_above = np.where(at >= 0, known[at] - (np.arange(n) - at), 0)
    prefix = np.maximum(with_above, 0)[order]
    best = np.maximum(prefix, np.append(prefix[1:], 0))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def windows_shared(groups: np.ndarray, left: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which contexts (context i from starts[i] to starts[i + 1], its anchor left[i] behind) may match another of their group.

    Windows begin every ``slack`` bytes before the anchor and are as much shorter than ``length``, so each string of ``length``
    bytes that holds the anchor holds one of them. Where strings are equal, so are their windows, and the windows' hashes.
    """
    slack = max(1, (length - GRAM) // WINDOWS)
    before = np.arange(0, length - GRAM + 1, slack)
    inside = (left[:, None] >= before) & (np.diff(starts)[:, None] - left[:, None] + before >= length - slack)
    row, which = np.nonzero(inside)
    at = starts[row] + left[row] - before[which]
    key = _mix(groups[row].view(np.uint64) + _mix(which.astype(np.uint64)))
    for low in range(0, len(data), STEP):
        part = np.flatnonzero((at >= low) & (at < low + STEP))
        hashes, k = Hashes(data[low : low + STEP + length], STEP + 4 * length), at[part] - low
        key[part] += hashes.of(k, k + length - slack)
    _, same, n = np.unique(_mix(key), return_inverse=True, return_counts=True)
    out = np.zeros(len(left), bool)
    out[row[n[same] > 1]] = True
    return out


def long_matches(groups: np.ndarray, left: np.ndarray, contexts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(context, start, end) relative to its anchor, of matches of ``length`` bytes or more with others of its group."""
    if not contexts:
        return []
    _, group = np.unique(groups, return_inverse=True)
    n_groups = int(group.max()) + 1
    parts, begins, at = [], [], 0
    for i, (context, before) in enumerate(zip(contexts, left, strict=True)):
        symbols = np.frombuffer(context, np.uint8).astype(np.int64)
        parts += [symbols[:before], [256 + group[i]], symbols[before:], [256 + n_groups + i]]
        begins.append(at)
        at += len(context) + 2
    statistics = matching_statistics(np.concatenate(parts))
    out = []
    for i, (begin, before) in enumerate(zip(begins, left.tolist(), strict=True)):
        strings = len(contexts[i]) - length + 1
        hit = np.flatnonzero(statistics[begin : begin + strings] > length)  # the anchor's symbol is one more
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else ():
            out.append((i, int(run[0]) - before, int(run[-1]) - before + length))
    return out


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _entries(lists: pa.Array, *names: str) -> list[np.ndarray]:
    """Of lists of structs the row of each entry, and these fields of it."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    fields = [pc.struct_field(flat, name).to_numpy(zero_copy_only=False) for name in names]
    return [np.repeat(np.arange(len(lists)), size), *fields]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = _buffer(batch["text"])
            found = anchors(data, starts, length)
            text = np.searchsorted(starts, found["place"], "right") - 1
            place, first, last = (found[k] - starts[text] for k in ("place", "first", "last"))
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(text)), pa.array(place.astype(np.int32)),
                 pa.array((place - first).astype(np.int16)), pa.array((last + length - place).astype(np.int16)),
                 pa.array(found["gram"]), pa.array(found["context"])],
                ["key", "place", "before", "after", "gram", "context"],
            )

    return docs.select("key", "text").mapInArrow(
        run, "key long, place int, before short, after short, gram long, context long"
    )


def _context_rows(stored: DataFrame, length: int) -> DataFrame:
    """The bytes around the anchors that stand for their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "gram", "context", "crowded", "covered", "before"
        for batch in batches:
            data, starts = _buffer(batch["text"])
            row, stands, place, after, *rest = _entries(batch["marks"], "stands", "place", "after", *names)
            before, picked = rest[-1].astype(np.int32), np.flatnonzero(stands)
            for first in range(0, len(picked), ROWS):
                pick = picked[first : first + ROWS]
                low, size = starts[row[pick]] + place[pick] - before[pick], before[pick] + after[pick]
                ends = np.cumsum(size)
                taken = data[np.repeat(low - (ends - size), size) + np.arange(ends[-1])]
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[pick]) for x in (*rest[:-1], before)), texts], [*names, "bytes"])

    schema = "gram long, context long, crowded boolean, covered boolean, before int, bytes binary"
    return stored.select("text", "marks").mapInArrow(run, schema)


def _bucket_matches(contexts: DataFrame, length: int, n_contexts: int) -> DataFrame:
    def run(bucket: pa.Table) -> pa.Table:
        groups, left = bucket["gram"].to_numpy(), bucket["before"].to_numpy()
        data, starts = _buffer(bucket["bytes"].combine_chunks())
        may = np.flatnonzero(windows_shared(groups, left, data, starts, length))
        found = long_matches(groups[may], left[may], bucket["bytes"].take(pa.array(may)).to_pylist(), length)
        covered = bucket["covered"].to_numpy()[may]
        found = [(may[i], start, end) for i, start, end in found if not covered[i]]
        rows = pa.array([f[0] for f in found], pa.int64())
        return pa.table(
            {
                "gram": bucket["gram"].take(rows),
                "context": bucket["context"].take(rows),
                "start": pa.array([f[1] for f in found], pa.int32()),
                "end": pa.array([f[2] for f in found], pa.int32()),
            }
        )

    buckets = max(1, -(-n_contexts // BUCKET))
    rows = contexts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(run, "gram long, context long, start int, end int")


def _crowd_matches(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many contexts: strings that occur in more than one, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = _buffer(batch["bytes"])
            before = batch["before"].to_numpy()
            n = np.diff(starts) - length + 1  # strings of a context
            row = np.repeat(np.arange(len(n)), n)
            q = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            one, two = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
            at = starts[row] + q
            for low in range(0, len(data), STEP):
                part = (at >= low) & (at < low + STEP)
                hashes, k = Hashes(data[low : low + STEP + length], STEP + 4 * length), at[part] - low
                one[part] = hashes.of(k, k + length // 2)
                two[part] = hashes.of(k + length // 2, k + length)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch["gram"].take(pick), batch["context"].take(pick), batch["covered"].take(pick),
                 pa.array((q - before[row]).astype(np.int32)), pa.array(_mix(one).view(np.int64)),
                 pa.array(_mix(two).view(np.int64))],
                ["gram", "context", "covered", "start", "one", "two"],
            )

    schema = "gram long, context long, covered boolean, start int, one long, two long"
    strings = contexts.select("gram", "context", "covered", "before", "bytes").mapInArrow(run, schema)
    key = ["gram", "start", "one", "two"]
    often = strings.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return (
        strings.filter("NOT covered")
        .join(often, key, "left_semi")
        .select("gram", "context", "start", (F.col("start") + length).alias("end"))
    )


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes that are in no span, number removed, number of maximal removed runs)."""
    parts, at, removed, runs, end = [], 0, 0, 0, -1
    for a, b in sorted((max(0, a), min(b, len(text))) for a, b in spans):
        if a > end:
            runs += 1
            parts.append(text[at:a])
        elif b <= end:
            continue
        removed += b - max(a, end)
        at = end = max(b, end)
    parts.append(text[at:])
    return b"".join(parts), removed, runs


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200) -> DataFrame:
    """Per row: id, ``kept`` (bytes outside repeated strings), n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    text or another; the input decides, not what is left. Strings never cross texts. ``kept`` is null where nothing
    goes, as the text is whole then. A null text is empty; shorter texts keep all. Rows that
    repeat an id and its text are copies of each other, as are equal texts of different ids. Null ids take part.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM} bytes")
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    ).withColumn("key", F.xxhash64("id", "text"))

    # worked out twice: the first time only the hashes are counted, the second time most rows are dropped
    found = _anchor_rows(rows, length)
    often = cut_lineage(
        found.select("gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "grams"
    )
    repeated = cut_lineage(found.join(often, "gram", "left_semi"), "repeated")
    # distinct contexts, a place that stands for each, and how many there are of an anchor
    context = repeated.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("text_of")
    )
    crowd = context.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"))
    context = cut_lineage(context.join(crowd, "gram").filter("n > 1 OR contexts > 1"), "contexts")
    marks = (
        repeated.join(context, ["gram", "context"])
        .select(
            "key", "place", "before", "after", "gram", "context",
            (F.col("n") > 1).alias("covered"),
            # of copies any stands for all; the first in the text with the least key does
            ((F.col("contexts") > 1) & (F.col("key") == F.col("text_of"))).alias("stands"),
            (F.col("contexts") > CROWD).alias("crowded"),
        )
    )
    marks = cut_lineage(marks, "marks")
    of_text = marks.groupBy("key").agg(
        F.collect_set(F.struct("place", "before", "after", "gram", "context", "covered", "stands", "crowded")).alias("marks")
    )  # of one text
    stored = rows.join(of_text.hint("merge"), "key", "left").select(
        "id",
        "key",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.when(F.col("marks").isNull(), F.sha2("text", 256)).alias("whole"),
        F.when(F.col("marks").isNotNull(), F.col("text")).alias("text"),
        "marks",
    )
    stored = cut_lineage(stored, "marked-texts")
    marked = stored.filter("marks IS NOT NULL")

    # a text that holds a context twice, or repeated rows, stand for it more than once
    contexts = cut_lineage(_context_rows(marked, length).dropDuplicates(["gram", "context"]), "context-bytes")
    few, many = contexts.filter("NOT crowded"), contexts.filter("crowded")
    matches = _bucket_matches(few, length, few.count()).unionByName(_crowd_matches(many, length))
    alone = marks.filter("stands AND NOT covered").select("key", "place", "gram", "context")
    span = F.struct((F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("end")).alias("end"))
    spans = matches.join(alone, ["gram", "context"]).groupBy("key").agg(F.collect_set(span).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            row, covered, place, before, after = _entries(batch["marks"], "covered", "place", "before", "after")
            of_span, begin, stop = _entries(batch["spans"], "start", "end")
            row = np.concatenate([row[covered], of_span])
            low, high = np.concatenate([(place - before)[covered], begin]), np.concatenate([(place + after)[covered], stop])
            by = np.argsort(row, kind="stable")
            pairs = list(zip(low[by].tolist(), high[by].tolist(), strict=True))
            at = np.searchsorted(row[by], np.arange(len(batch["text"]) + 1)).tolist()
            for i, text in enumerate(batch["text"].cast(pa.binary())):
                own = pairs[at[i] : at[i + 1]]
                kept, removed, runs = cut(text.as_py(), own)
                out.append((kept if removed else None, removed, runs, hashlib.sha256(kept).hexdigest()))
            kinds = pa.binary(), pa.int64(), pa.int64(), pa.string()
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n_bytes"], *columns],
                ["id", "n_bytes", "kept", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, kept binary, n_removed long, n_spans long, kept_sha256 string"
    done = marked.join(spans.hint("merge"), "key", "left").select("id", "n_bytes", "text", "marks", "spans").mapInArrow(run, schema)
    untouched = stored.filter("marks IS NULL").select(
        "id", "n_bytes", F.lit(None).cast("binary").alias("kept"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("whole").alias("kept_sha256"),
    )
    return untouched.unionByName(done).withColumnRenamed("id", id_column)
