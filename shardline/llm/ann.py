"""Nearest neighbours by inner product, from balanced posting lists.

Centroids come from a bounded sample, halved again and again into equal parts. Every row goes to the list of its
nearest centroid and, if it lies near a border, to further lists. Centroids are searched by a
neighbour graph in memory. A query reads the lists whose centroid is not farther than the nearest by more than
a ratio, so queries within a cluster read few lists and queries between clusters read more. The ratio is widened
until held-out queries, compared with all rows, find the share of their neighbours asked for.

Largest inner products become smallest distances by one more dimension that brings all rows to the
largest norm; queries are scaled to it and have 0 there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from shardline.llm.batches import bounded_batches
from shardline.session import cut_lineage

#: Rows and queries that one task compares at a time. Neighbouring lists are packed up to this size and longer ones cut, so
#: that a query's finds are merged in as few places as memory allows.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2048
#: Queries on which the recall is measured.
PROBES = 256


def _halves(rows: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of parts of at most ``leaf`` rows; both halves of a cut are equally large."""
    if len(rows) <= leaf:
        return [rows.mean(0)]
    half, ends = len(rows) // 2, rows[rng.choice(len(rows), 2, replace=False)]
    for _ in range(8):
        side = rows @ (ends[0] - ends[1])
        order = np.argsort(-side, kind="stable")
        ends = np.stack([rows[order[:half]].mean(0), rows[order[half:]].mean(0)])
    return _halves(rows[order[:half]], leaf, rng) + _halves(rows[order[half:]], leaf, rng)


@dataclass(frozen=True)
class Lists:
    """Centroids, their neighbour graph and the norm to which rows are brought."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float

    @staticmethod
    def fit(sample: np.ndarray, lists: int, norm: float, degree: int = 16, seed: int = 3) -> Lists:
        rows = lift(sample, norm)
        centroids = np.stack(_halves(rows, max(1, -(-len(rows) // lists)), np.random.default_rng(seed)))
        n = len(centroids)
        near = np.empty((n, min(degree, n)), np.int64)
        for at in range(0, n, 512):
            gap = distances(centroids[at : at + 512], centroids)
            near[at : at + 512] = np.argsort(gap, 1, kind="stable")[:, : near.shape[1]]
        ring = np.arange(n)  # with the next and the one before, so that all can be reached
        graph = np.column_stack([near, (ring + 1) % n, (ring - 1) % n])
        return Lists(centroids.astype(np.float32), graph, norm)

    def search(self, points: np.ndarray, ratio: float, breadth: int = 16) -> np.ndarray:
        """Distances (point, centroid), infinite where the graph wasn't followed or the ratio is exceeded.

        All centroids within the ratio that are evaluated are expanded, and the ``breadth`` nearest.
        """
        if np.isinf(ratio):
            return distances(points, self.centroids)
        n, k = len(points), len(self.centroids)
        gap = np.full((n, k), np.inf, np.float32)
        done = np.zeros((n, k), bool)
        start = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        gap[:, start] = distances(points, self.centroids[start])
        while True:
            edge = np.maximum(gap.min(1) * (1 + ratio), np.partition(gap, min(breadth, k) - 1, 1)[:, min(breadth, k) - 1])
            row, node = np.nonzero((gap <= edge[:, None]) & ~done & np.isfinite(gap))
            if not len(row):
                break
            done[row, node] = True
            new = np.zeros((n, k), bool)
            new[np.repeat(row, self.graph.shape[1]), self.graph[node].ravel()] = True
            row, node = np.nonzero(new & ~np.isfinite(gap))
            for at in range(0, len(row), 1 << 16):
                r, c = row[at : at + (1 << 16)], node[at : at + (1 << 16)]
                gap[r, c] = np.sqrt(((points[r] - self.centroids[c]) ** 2).sum(1))
        gap[gap > gap.min(1, keepdims=True) * (1 + ratio)] = np.inf
        return gap


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def lift(rows: np.ndarray, norm: float) -> np.ndarray:
    """Rows with a last coordinate that brings them to the norm."""
    rest = np.sqrt(np.maximum(norm * norm - (rows * rows).sum(1), 0))
    return np.column_stack([rows, rest]).astype(np.float32)


def scaled(queries: np.ndarray, norm: float) -> np.ndarray:
    """Queries at the norm, with last coordinate 0: their nearest lifted rows have the largest products."""
    length = np.sqrt((queries * queries).sum(1, keepdims=True))
    return np.column_stack([queries * (norm / length), np.zeros(len(queries))]).astype(np.float32)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists_of(vector: Column, index: Lists, dim: int, ratio: float, most: int) -> Column:
    """Numbers of the lists that a row goes to, the nearest and those about as near."""

    @F.arrow_udf("array<int>")
    def run(vectors: pa.Array) -> pa.Array:
        own, ends = [np.empty(0, np.int64)], [0]
        rows = _matrix(vectors, dim)
        for at in range(0, len(rows), 512):
            gap = index.search(lift(rows[at : at + 512], index.norm), ratio)
            order = np.argsort(gap, 1, kind="stable")[:, :most]
            inside = np.isfinite(np.take_along_axis(gap, order, 1))
            own.append(order[inside])
            ends.extend((ends[-1] + np.cumsum(inside.sum(1))).tolist())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own), pa.int32()))

    return run(vector)


def pack(sizes: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """List -> (first unit, units): neighbouring lists share a unit of ``block`` rows, longer ones get several."""
    out, unit, used = {}, 0, 0
    for number, size in sorted(sizes.items()):
        if used and used + size > block:
            unit, used = unit + 1, 0
        parts = -(-size // block)
        out[number] = (unit, parts)
        unit, used = (unit, used + size) if parts == 1 else (unit + parts, 0)
    return out


READS = "array<struct<unit: int, lists: array<int>>>"
READS_ARROW = pa.list_(pa.struct([("unit", pa.int32()), ("lists", pa.list_(pa.int32()))]))


def _reads_of(vector: Column, index: Lists, dim: int, ratio: float, units: dict[int, tuple[int, int]]) -> Column:
    """The units that a query reads, each with its lists there."""

    @F.arrow_udf(READS)
    def run(vectors: pa.Array) -> pa.Array:
        out = []
        rows = _matrix(vectors, dim)
        for at in range(0, len(rows), 512):
            for gap in index.search(scaled(rows[at : at + 512], index.norm), ratio):
                reads: dict[int, list[int]] = {}
                for number in np.flatnonzero(np.isfinite(gap)).tolist():
                    first, parts = units.get(number, (0, 0))  # a list may be empty
                    for part in range(parts):
                        reads.setdefault(first + part, []).append(number)
                out.append([{"unit": u, "lists": lists} for u, lists in reads.items()])
        return pa.array(out, READS_ARROW)

    return run(vector)


def best_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and products of its k best rows, ties to smaller ids.

    A matrix product proposes, with room for its rounding; the products returned are summed
    in the order of the dimensions, so that equal vectors have equal ones wherever they are compared.
    """
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        rough = part @ rows.T
        least = np.partition(rough, len(ids) - k, 1)[:, len(ids) - k] if k < len(ids) else np.full(len(part), -np.inf)
        slack = 1e-9 * (1 + np.abs(rough).max(1, initial=0))
        for query, row, edge in zip(part, rough, least - slack, strict=True):
            near = np.flatnonzero(row >= edge)
            product = np.add.reduce((rows[near] * query).T.copy(), 0)
            order = np.lexsort((ids[near], -product))[:k]
            yield ids[near][order], product[order]


def _compared(posted: DataFrame, queries: np.ndarray, most: int) -> DataFrame:
    """Per query (its row number) the ``most`` best of all posted rows: query, id, list, score."""
    dim = queries.shape[1]
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * len(queries)
        for batch in batches:
            ids, lists = batch["id"].to_numpy(), batch["list"].to_numpy()
            order = np.lexsort((lists, ids))
            ids, lists, rows = ids[order], lists[order], _matrix(batch["v"], dim)[order]
            for q, (at, score) in enumerate(best_of(queries, rows, np.arange(len(ids)), most)):
                i, n, s = (np.concatenate(x) for x in zip(held[q], (ids[at], lists[at], score), strict=True))
                top = np.lexsort((n, i, -s))[:most]
                held[q] = i[top], n[top], s[top]
        who = np.repeat(np.arange(len(queries)), [len(h[0]) for h in held])
        columns = [who, *(np.concatenate(c) for c in zip(*held, strict=True))]
        kinds = pa.int32(), pa.int64(), pa.int32(), pa.float64()
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["query", "id", "list", "score"])

    found = posted.select("id", "list", "v").mapInArrow(run, "query int, id long, list int, score double")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).drop("n")


def wide_enough(
    index: Lists, posted: DataFrame, ids: list[int], queries: np.ndarray, k: int, copies: int, ratio: float, recall: float
) -> float:
    """The ratio, or the next wider one at which the queries' reads hold ``recall`` of their k nearest other rows.

    ``copies`` lists hold a row at most. Infinite, for all lists, if no ratio is enough.
    """
    lists: dict[tuple[int, int], set[int]] = {}
    score: dict[tuple[int, int], float] = {}
    count = [0] * len(ids)
    rows = _compared(posted, queries, (k + 1) * copies).collect()
    for r in sorted(rows, key=lambda r: (r["query"], -r["score"], r["id"])):
        q, key = r["query"], (r["query"], r["id"])
        if r["id"] == ids[q]:
            continue
        if key not in lists and count[q] < k:
            count[q] += 1
            lists[key], score[key] = set(), r["score"]
        if key in lists and score[key] == r["score"]:
            lists[key].add(r["list"])
    points = scaled(queries, index.norm)
    while lists and not np.isinf(ratio):
        read = np.isfinite(index.search(points, ratio))
        if np.mean([read[q, list(own)].any() for (q, _), own in lists.items()]) >= recall:
            break
        ratio = ratio * 1.05 + 0.001 if ratio < 4 and not read.all() else np.inf
    return ratio


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 20,
    list_rows: int = 1000,
    max_lists: int = 1024,
    sample_rows: int = 16_384,
    build_ratio: float = 0.03,
    max_copies: int = 2,
    query_ratio: float = 0.13,
    recall: float = 0.98,
) -> DataFrame:
    """For every query row its k nearest other rows found: query_id, rank, vec_id, score (the exact inner product).

    Nearest first, ties to smaller ids. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than most. Of equal vectors the ``k + 1`` with the smallest ids are
    indexed: no other can be among anyone's k nearest; equal queries are searched once. Null ids
    take no part, and rows that repeat an id and its vector count once. Fewer than k candidates give fewer rows.

    ``query_ratio`` is the least ratio. It is widened until ``PROBES`` of the queries, not among the rows that fit the
    centroids where there are others, find ``recall`` of their true neighbours over the lists of this very table.

    ``sample_rows`` vectors are collected to fit the centroids, of which there are at most ``max_lists``; those are what
    is sent to the workers, and the probes. Lists and the queries on them are cut into blocks, so a task holds about
    ``BLOCK_ROWS`` and ``BLOCK_QUERIES`` of them at a time, however large a list grows.
    """
    spark = bounded_batches(vectors.sparkSession)
    vector = F.col(f"`{vector_column}`")
    rows = vectors.select(
        F.col(f"`{id_column}`").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score double")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return empty
    dim = common["dim"]
    rows = rows.filter(F.size("v") == dim).withColumn("v", F.col("v").cast("array<double>"))
    same = Window.partitionBy("v").orderBy("id")
    kept = rows.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    kept = cut_lineage(kept.select("id", "v"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = kept.agg(F.count("id").alias("n"), F.max(square).alias("norm")).first()
    lists = min(max_lists, -(-facts["n"] // list_rows))
    share = min(1.0, 1.5 * sample_rows / facts["n"])
    drawn = kept.filter(F.rand(17) < share).limit(sample_rows) if share < 1 else kept.limit(sample_rows)
    drawn = drawn.select("id", "v").collect()
    sample = np.array([r["v"] for r in drawn], np.float64)
    index = Lists.fit(sample, lists, float(np.sqrt(facts["norm"])))

    posted = kept.select("id", "v", F.explode(_lists_of(F.col("v"), index, dim, build_ratio, max_copies)).alias("list"))
    posted = cut_lineage(posted, "posted")
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}  # max_lists rows
    units = pack(sizes, BLOCK_ROWS)
    asks = rows.filter("asks").select("id", "v")
    askers = cut_lineage(asks.groupBy("v").agg(F.min("id").alias("asker")), "askers")
    fitted = {r["id"] for r in drawn}
    probes = askers.orderBy(F.xxhash64(F.lit("probe"), "asker"), "asker").limit(4 * PROBES).collect()
    probes = sorted(probes, key=lambda r: r["asker"] in fitted)[:PROBES]
    if probes and len(index.centroids) > 1:
        tried = np.array([r["v"] for r in probes], np.float64)
        query_ratio = wide_enough(index, posted, [r["asker"] for r in probes], tried, k, max_copies, query_ratio, recall)
    reads = askers.select("asker", "v", F.explode(_reads_of(F.col("v"), index, dim, query_ratio, units)).alias("r"))
    asked = cut_lineage(reads.select("asker", "v", "r.unit", "r.lists"), "asked")

    # blocks of a unit: its rows by parts of its queries
    parts = asked.groupBy("unit").agg(F.ceil(F.count("asker") / BLOCK_QUERIES).cast("int").alias("parts"))
    placed = spark.createDataFrame([(n, *u) for n, u in units.items()], "list int, first int, of int")
    right = posted.join(F.broadcast(placed), "list").select(  # max_lists rows
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("of"))).cast("int").alias("unit"), "list", "id", "v"
    )
    right = right.join(parts, "unit").select(
        "unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "list", "id", "v"
    )
    left = asked.join(parts, "unit").withColumn("part", F.pmod(F.xxhash64("asker"), F.col("parts")).cast("int"))
    left = left.select("unit", "part", "asker", "v", "lists")

    def compare(queries: pa.Table, own: pa.Table) -> pa.Table:
        """A query's best rows in the unit, list by list and then together."""
        finds: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and own.num_rows:
            ids, number = own["id"].to_numpy(), own["list"].to_numpy()
            a, b = (_matrix(t["v"].combine_chunks(), dim) for t in (queries, own))
            wanted = queries["lists"].combine_chunks()
            reader = np.repeat(np.arange(len(wanted)), pc.list_value_length(wanted).to_numpy())
            read = wanted.flatten().to_numpy()
            for n in np.unique(number):
                who, here = reader[read == n], number == n
                for q, (found, score) in zip(who, best_of(a[who], b[here], ids[here], k + 1), strict=True):
                    finds.append((np.full(len(found), q), found, score))
        q, found, score = (np.concatenate(c) for c in zip(*finds, strict=True)) if finds else [np.empty(0, np.int64)] * 3
        order = np.lexsort((found, -score, q))
        q, found, score = q[order], found[order], score[order]
        # a row that stands in two lists has one product, so its finds lie side by side
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (found[1:] != found[:-1])])[: len(q)]
        q, found, score = q[new], found[new], score[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place <= k
        askers_ = queries["asker"].to_numpy()[q[top]] if len(q) else q
        columns = (askers_, found[top], score[top])
        kinds = pa.int64(), pa.int64(), pa.float64()
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["asker", "id", "score"])

    by = ("unit", "part")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "asker long, id long, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    found = found.groupBy("asker", "id").agg(F.max("score").alias("score"))  # a row may stand in several units
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    members = asks.distinct().join(askers, "v").select(F.col("id").alias("query_id"), "asker")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        members.join(found, "asker")
        .filter("id <> query_id")
        .select("query_id", F.row_number().over(order).alias("rank"), F.col("id").alias(id_column), "score")
        .filter(F.col("rank") <= k)
    )
