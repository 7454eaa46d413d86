"""Whitening of vectors through the exact characteristic polynomial of their integer scatter.

Entries become integers, so that the scatter of all rows is an exact integer matrix. Its characteristic
polynomial is worked out modulo many primes, in Spark tasks, by reduction to Hessenberg form, and put together by
Chinese remaindering. All its roots are real and none is negative: the signs of its coefficients tell the zero
roots, and the sign changes of the shifted polynomial count the roots above a point exactly, whatever their
multiplicity. Bisection by these counts isolates the roots to many more digits than a double holds. Inverse
iteration in fixed-point integers then gives the null spaces, and with them the components.

Everything that reaches the driver is bounded by the dimension: sums over pairs of dimensions, and a polynomial
for each prime.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, isqrt, ldexp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bits of a limb in which sums travel, and how many there are: sums of 2^23 partial sums stay in a long.
LIMB, LIMBS = 40, 6
#: Rows multiplied at a time, and bits of the parts of entries: such sums of products are exact in doubles.
ROWS, PART = 4096, 20
#: Entries are cut off here, so that they and their offset fit a long.
LARGEST = 1 << 62
#: Bits to which roots are isolated, relative to the largest, and bits of the fixed-point numbers.
ROOT_BITS, FIXED = 160, 400


@dataclass(frozen=True)
class Whitening:
    """What rows are projected on. ``sums`` are without the offset, which centring takes out again."""

    n: int
    sums: tuple[int, ...]
    scale: float
    eigenvalues: tuple[float, ...]  # of the covariance, falling
    explained: tuple[float, ...]
    components: np.ndarray  # (dimension, component), unit columns
    weights: np.ndarray  # of n * x - sums: components over the root of n^2 times the eigenvalue
    identity_error: float

    @staticmethod
    def nothing() -> Whitening:
        """Of no rows."""
        return Whitening(0, (), 1.0, (), (), np.empty((0, 0)), np.empty((0, 0)), 0.0)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good, F.lit(False))


def _rows(vectors: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * entry) as a matrix of int64."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(scale * flat)
    return np.clip(x, -float(LARGEST), float(LARGEST)).astype(np.int64).reshape(len(vectors), dim)


def _scatter(x: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, exact, as Python integers."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        parts, rest = [], x[at : at + ROWS]
        while True:
            high = rest >> PART
            if ((high == 0) | (high == -1)).all():
                parts.append(rest.astype(np.float64))
                break
            parts.append((rest - (high << PART)).astype(np.float64))
            rest = high
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                out += (a.T @ b).astype(np.int64).astype(object) << (PART * (i + j))
    return out


def _limbs(value: int) -> list[int]:
    """A signed number in limbs of which only the last has a sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def scatter(rows: DataFrame, vector: Column, dim: int, scale: float) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums of the integer entries and sums of their products, all exact.

    Each task sends its own sums, cut in limbs that Spark adds up as longs.
    """
    names = [f"l{i}" for i in range(LIMBS)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = _rows(batch.column(0), dim, scale)
            n += len(x)
            low = x & ((1 << PART) - 1)
            sums += ((x >> PART).sum(0).astype(object) << PART) + low.sum(0).astype(object)
            products += _scatter(x)
        if n:
            found = [(-1, -1, n), *((-1, i, int(s)) for i, s in enumerate(sums))]
            found += [(i, j, int(products[i, j])) for i in range(dim) for j in range(i + 1)]
            table = [(i, j, *_limbs(v)) for i, j, v in found]
            columns = [pa.array(c, pa.int64()) for c in zip(*table, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *names])

    sent = rows.select(vector.alias("v")).mapInArrow(partial, f"i long, j long, {', '.join(f'{x} long' for x in names)}")
    total = sent.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in names))
    n, sums, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for row in total.collect():  # (dim + 1) * (dim + 2) / 2 rows
        value = sum(row[x] << (LIMB * k) for k, x in enumerate(names))
        if row["i"] >= 0:
            products[row["i"]][row["j"]] = products[row["j"]][row["i"]] = value
        elif row["j"] >= 0:
            sums[row["j"]] = value
        else:
            n = value
    return n, sums, products


def _is_prime(n: int) -> bool:
    """For odd n below 2^32."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(above: int) -> list[int]:
    """Primes below 2^31, from the largest, whose product exceeds a number."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= above:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo p, the constant first, through the Hessenberg form."""
    h, d = matrix.copy(), len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        if at := below[0]:
            h[[k, k + at]] = h[[k + at, k]]
            h[:, [k, k + at]] = h[:, [k + at, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        # row i loses factor_i times row k; the inverse on the columns keeps the matrix similar
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(1)) % p
    done = np.zeros((d + 1, d + 1), np.int64)  # polynomials of the leading blocks
    done[0, 0] = 1
    for k in range(1, d + 1):
        done[k, 1:] = done[k - 1, :-1]
        done[k] = (done[k] - int(h[k - 1, k - 1]) * done[k - 1] % p) % p
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            if not chain:
                break
            done[k] = (done[k] - int(h[k - 1 - i, k - 1]) * chain % p * done[k - 1 - i] % p) % p
    return done[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - matrix), the constant first, of an integer matrix without negative eigenvalues.

    Each coefficient is at most what equal eigenvalues of the same sum would give, which tells how many primes are
    enough. The primes are dealt out over Spark tasks.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    if not d or not trace:
        return [0] * d + [1]
    most = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    moduli = primes(2 * most)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(matrix, object)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            rows = [polynomial_mod((exact % p).astype(np.int64), p) for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = max(1, min(len(moduli), 4 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks)
    value, product = [0] * (d + 1), 1
    for p, c in sorted(dealt.mapInArrow(each, "p long, c array<long>").collect()):
        turn = pow(product, -1, p)
        value = [v + product * ((r - v) * turn % p) for v, r in zip(value, c, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


def _shifted(c: list[int], m: int, s: int) -> list[int]:
    """Coefficients, with the same signs, of the polynomial at x + m / 2^s."""
    d = len(c) - 1
    c = [v << (s * (d - k)) for k, v in enumerate(c)]  # in x / 2^s, times 2^(s * d)
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    return c


def roots_above(c: list[int], m: int, s: int = 0) -> int:
    """How many roots, with multiplicity, are larger than m / 2^s, if all are real (Descartes' rule is exact then)."""
    signs = [v > 0 for v in _shifted(c, m, s) if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(c: list[int], m: int, s: int) -> int:
    value, scale = c[-1], 0
    for v in reversed(c[:-1]):
        scale += s
        value = value * m + (v << scale)
    return (value > 0) - (value < 0)


def real_roots(c: list[int], most: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """The largest ``most`` positive roots as (numerator, shift, multiplicity), falling: each is numerator / 2^shift.

    All roots must be real and none negative. Zero roots are the lowest coefficients that vanish. An interval with
    several roots is halved by counting, one with a single root by the sign at its middle. Roots that are still
    together when ``bits`` halvings have been made count as one with their number.
    """
    c = c[next(i for i, v in enumerate(c) if v) :]
    if len(c) == 1:
        return []
    top = max(1, (-c[-2]).bit_length())  # 2^top exceeds the sum of the roots
    out: list[tuple[int, int, int]] = []
    stack = [(0, 0, len(c) - 1, 0)]  # interval (index, index + 1] * 2^(top - depth), roots above either end, depth
    while stack and sum(x[2] for x in out) < most:
        index, above, below, depth = stack.pop()
        if above == below:
            continue
        m, s = (2 * index + 1) << max(0, top - depth - 1), max(0, depth + 1 - top)  # the middle is m / 2^s
        if depth == bits:
            out.append((m, s, below - above))
            continue
        if below - above > 1:
            inside = roots_above(c, m, s)
        else:  # the sign is positive above all roots and turns at each
            inside = above if _sign(c, m, s) * (-1) ** above >= 0 else below
        stack += [(2 * index, inside, below, depth + 1), (2 * index + 1, above, inside, depth + 1)]
    return out


def null_space(matrix: list[list[int]], m: int, s: int, count: int) -> list[list[int]]:
    """``count`` orthogonal fixed-point vectors that the matrix scales by about m / 2^s, by inverse iteration."""
    d, top = len(matrix), max(1, sum(matrix[i][i] for i in range(len(matrix))).bit_length())

    def fixed(value: int, shift: int = 0) -> int:  # value / 2^(shift + top)
        move = FIXED - top - shift
        return value << move if move >= 0 else value >> -move

    a = np.array([[fixed(v) for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= fixed(m, s)
    order = list(range(d))
    for k in range(d):  # factors below the diagonal
        at = max(range(k, d), key=lambda i: abs(a[i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            order[k], order[at] = order[at], order[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            a[k + 1 :, k] = (a[k + 1 :, k] << FIXED) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k, None] * a[k, None, k + 1 :]) >> FIXED

    def unit(v: np.ndarray) -> np.ndarray:
        return (v << FIXED) // (isqrt(int((v * v).sum())) or 1)

    rng, found = np.random.default_rng(d), []
    starts = [np.array([int(x) << (FIXED - 32) for x in rng.integers(1, 1 << 31, d)], object) for _ in range(count)]
    for _ in range(3):
        found = []
        for v in starts:
            x = v[order]
            for k in range(1, d):
                x[k] -= int((a[k, :k] * x[:k]).sum()) >> FIXED
            for k in reversed(range(d)):
                x[k] = ((int(x[k]) - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> FIXED)) << FIXED) // a[k, k]
            x = unit(x)
            for y in found:
                x = unit(x - ((y * (int((x * y).sum()) >> FIXED)) >> FIXED))
            found.append(x)
        starts = found
    return [[int(x) for x in v] for v in found]


def fit(rows: DataFrame, vector: Column, scale: float = 64.0, most: int = 32) -> Whitening | None:
    """Whitening of all rows' vectors; None if there are none. Entries count as floor(scale * entry).

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those whose length isn't
    the commonest one (of equally common lengths the largest). Components of eigenvalue zero can't be whitened
    and are left out, so there are at most as many as the rank. Entries beyond 2^62 count as that.
    """
    sizes = rows.filter(usable(vector)).groupBy(F.size(vector).alias("size")).count()
    common = sizes.filter("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    dim = common["size"]
    n, sums, products = scatter(rows.filter(usable(vector) & (F.size(vector) == dim)), vector, dim, scale)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]  # n^2 x covariance
    roots = real_roots(characteristic_polynomial(rows.sparkSession, matrix), most)
    trace = sum(matrix[i][i] for i in range(dim))
    values, shares, components, weights = [], [], [], []
    for m, s, count in roots:
        root = isqrt((m << 2 * FIXED) >> s)  # of the eigenvalue, with FIXED bits after the point
        for v in null_space(matrix, m, s, count)[: most - len(values)]:
            norm = isqrt(sum(x * x for x in v))
            components.append([x / norm for x in v])
            weights.append([(x << FIXED) / (norm * root) for x in v])
            values.append(m / (n * n << s))
            shares.append(m / (trace << s))
    error = _identity_error(matrix, weights)
    shape = (len(values), dim)
    return Whitening(
        n, tuple(sums), scale, tuple(values), tuple(shares), np.array(components).reshape(shape).T,
        np.array(weights).reshape(shape).T, error,
    )


def _identity_error(matrix: list[list[int]], weights: list[list[float]]) -> float:
    """Largest entry of the covariance of whitened rows minus the identity, exact for the doubles in use.

    Whitening is linear, so that this covariance follows from the scatter and needs no pass over the rows.
    """
    if not weights:
        return 0.0
    w = np.array([[int(ldexp(x, FIXED)) for x in v] for v in weights], object)
    gap = w @ np.array(matrix, object) @ w.T
    for i in range(len(w)):
        gap[i, i] -= 1 << 2 * FIXED
    return max(abs(int(x)) for x in gap.ravel()) / (1 << 2 * FIXED)


def apply(vector: Column, model: Whitening) -> Column:
    """``deviation``, the exact sum of (n * x - sums)^2, and ``whitened``, an entry for each component.

    The deviation is a decimal without fraction, null beyond 38 digits. Null for vectors that took no part in the
    fit for their entries or length.
    """
    dim, scale = len(model.sums), model.scale
    kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def run(vectors: pa.Array) -> pa.Array:
        here = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
        x = _rows(vectors.drop_null(), dim, scale)
        top = int(np.abs(x).max(initial=0))
        sums = np.array(model.sums, object)
        if (top * model.n + int(np.abs(sums).max(initial=0))).bit_length() < 63:
            centred = model.n * x - sums.astype(np.int64)
        else:
            centred = model.n * x.astype(object) - sums
        exact = centred if dim * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63 else centred.astype(object)
        deviations = [int(v) for v in (exact * exact).sum(1)]
        whitened = (centred.astype(np.float64) @ model.weights).tolist()
        found = iter(
            {"deviation": Decimal(a) if a < 10**38 else None, "whitened": b} for a, b in zip(deviations, whitened, strict=True)
        )
        return pa.array((next(found) if good else None for good in here), kind)

    return run(F.when(usable(vector) & (F.size(vector) == dim), vector))
