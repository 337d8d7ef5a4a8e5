"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Components of vectors become integers, so the scatter matrix n * sum(x x') - S S' is exact. Its
characteristic polynomial is found modulo many primes (one task per prime: reduction to Hessenberg
form, then the recursion over leading blocks) and put together by Chinese remainders. All roots of
a symmetric matrix are real, so the sign changes of the polynomial shifted to a count exactly the
roots above a: bisection by that count isolates them, repeated ones included. Each isolated root
is refined far beyond double precision, and inverse iteration on the matrix less the root gives
the component of its null space. What reaches the driver or is broadcast is bounded by the square
of the dimension, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut_lineage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Components are held within plus and minus this bound, so that they are longs.
MOST = float(1 << 62)
#: Bits of a limb in exact products, and rows multiplied at once: sums stay below 2**53.
LIMB, ROWS = 20, 4096
#: Roots nearer to each other than this share of their size count as one repeated root.
SAME_BITS = 200
#: Bits to which a root is refined, and decimal digits of inverse iteration.
ROOT_BITS, DIGITS = 256, 120
#: First level of the sums' tree: partial matrices meet in so many groups per matrix row.
LANES = 32


# --- exact sums -------------------------------------------------------------------------------

def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles l0, l1, ... with y = sum(l_k * 2**(LIMB * k)), each below 2**LIMB in size."""
    out, rest = [], y
    while True:
        low = rest & ((1 << LIMB) - 1)
        rest = rest >> LIMB
        if not out and (np.abs(y) < 1 << LIMB).all():
            return [y.astype(np.float64)]
        out.append(low.astype(np.float64))
        if np.isin(rest, (0, -1)).all():
            if rest.any():
                out.append(rest.astype(np.float64))
            return out


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, from products of doubles that are all exact."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for begin in range(0, len(y), ROWS):
        parts = limbs(y[begin:begin + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def packed(row: np.ndarray) -> bytes:
    """Integers as 32 bytes each."""
    return b"".join(int(x).to_bytes(32, "little", signed=True) for x in row)


def unpacked(data: bytes) -> np.ndarray:
    return np.array([int.from_bytes(data[k:k + 32], "little", signed=True)
                     for k in range(0, len(data), 32)], dtype=object)


def matrix_of(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scatter(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of the integer rows, summed up in a tree of two levels."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            y = matrix_of(batch, "x", d)
            n += len(y)
            sums += sum((p.sum(0).astype(np.int64).astype(object) << (LIMB * k)
                         for k, p in enumerate(limbs(y))), np.zeros(d, dtype=object)) if len(y) else 0
            products += exact_products(y)
        if n:
            lane = TaskContext.get().partitionId() % LANES
            rows = [*map(packed, products), packed(np.append(sums, n))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d + 1), pa.int32()), pa.array([lane] * (d + 1), pa.int32()),
                 pa.array(rows, pa.binary())], ["i", "lane", "sums"])

    def merged(table: pa.Table) -> pa.Table:
        total = sum(map(unpacked, table.column("sums").to_pylist()))
        return pa.table({"i": table.column("i")[:1], "lane": table.column("lane")[:1],
                         "sums": pa.array([packed(total)], pa.binary())})

    schema = "i int, lane int, sums binary"
    rows = fit.mapInArrow(partial, schema).groupBy("i", "lane").applyInArrow(merged, schema)
    rows = rows.groupBy("i").applyInArrow(merged, schema).collect()
    found = {r["i"]: unpacked(bytes(r["sums"])) for r in rows}
    if not found:
        return 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    return int(found[d][-1]), found[d][:-1], np.array([found[i] for i in range(d)], dtype=object)


# --- characteristic polynomial ----------------------------------------------------------------

def is_prime(n: int) -> bool:
    """By the bases that are enough below 2**32."""
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


def primes_below(top: int, count: int) -> list[int]:
    out, n = [], top - 1 | 1
    while len(out) < count:
        n -= 2
        if is_prime(n):
            out.append(n)
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - a) modulo the prime p < 2**31, lowest power first."""
    h = (a % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        k = m + int(below[0])
        if k != m:
            h[[k, m]] = h[[m, k]]
            h[:, [k, m]] = h[:, [m, k]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        factors, t = np.empty(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):  # the leading block of size i meets column k - 1 in row i
            factors[i] = int(h[i, k - 1]) * t % p
            t = t * int(h[i, i - 1]) % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (factors[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def coefficient_bits(d: int, trace: int) -> int:
    """Bits that hold each coefficient: at most C(d, k) * (trace / k)**k for roots >= 0."""
    log_trace = math.log2(max(trace, 1))
    return 8 + max([1, *(math.ceil(math.log2(math.comb(d, k)) + k * (log_trace - math.log2(k)))
                         for k in range(1, d + 1))])


def characteristic_polynomial(spark, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - a), lowest power first; one Spark row per prime."""
    d, trace = len(a), int(np.trace(a))
    primes = primes_below(1 << 31, coefficient_bits(d, trace) // 30 + 1)
    held = spark.sparkContext.broadcast(b"".join(map(packed, a)))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = unpacked(held.value).reshape(d, d)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = [polynomial_mod(matrix, primes[k]).tolist() for k in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([primes[k] for k in ids], pa.int64()),
                 pa.array(rows, pa.list_(pa.int64()))], ["prime", "coefficients"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism * 2)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(
        residues, "prime long, coefficients array<long>").collect()
    product = math.prod(primes)
    total = np.zeros(d + 1, dtype=object)
    for row in rows:
        rest = product // row["prime"]
        weight = rest * pow(rest, -1, row["prime"])
        total = (total + np.array(row["coefficients"], dtype=object) * weight) % product
    found = [int(c) - product if c > product // 2 else int(c) for c in total]
    if found[-1] != 1 or (d and found[-2] != -trace):
        raise ArithmeticError("the characteristic polynomial does not fit its matrix")
    return found


# --- real roots -------------------------------------------------------------------------------

def roots_above(f: list[int], m: int, s: int) -> int:
    """Roots above m / 2**s, with multiplicity, of a polynomial whose roots are all real.

    The sign changes of f(x + a) bound the positive roots from above (Descartes), and with real
    roots only they are that number.
    """
    d = len(f) - 1
    c = [x << (s * (d - k)) for k, x in enumerate(f)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += m * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(f: list[int], count: int) -> list[tuple[int, int, int, int]]:
    """(m, s, bits, multiplicity) of the largest positive roots, falling, until they number count.

    A root lies in (m / 2**s, (m + 2**bits) / 2**s]; the multiplicity is above one only for roots
    that agree in SAME_BITS bits.
    """
    while len(f) > 1 and f[0] == 0:
        f = f[1:]
    d = len(f) - 1
    if d < 1:
        return []
    top = max(1, -f[-2]).bit_length()  # the sum of the roots bounds each
    found, seen = [], 0
    stack = [(0, 0, top, d, 0)]  # lower end, shift, width in bits, roots above both ends
    while stack and seen < count:
        m, s, bits, over_low, over_high = stack.pop()
        n = over_low - over_high
        if n == 0:
            continue
        if n == 1 and m or n > 1 and m.bit_length() > bits + SAME_BITS:
            found.append((m, s, bits, n))
            seen += n
            continue
        if bits == 0:
            m, s, bits = m * 2, s + 1, 1
        half = m + (1 << bits - 1)
        over = roots_above(f, half, s)
        stack.append((m, s, bits - 1, over_low, over))
        stack.append((half, s, bits - 1, over, over_high))
    return found


def refined(f: list[int], m: int, s: int, bits: int) -> tuple[int, int]:
    """(m, s): a simple root alone in its interval to ROOT_BITS bits, by the sign at the middle."""
    d = len(f) - 1

    def value(x: int, shift: int) -> int:
        total = 0
        for k in range(d, -1, -1):
            total = total * x + (f[k] << (shift * (d - k)))
        return total

    above = value(m + (1 << bits), s)
    if above == 0:
        return m + (1 << bits), s
    while m.bit_length() - bits < ROOT_BITS:
        if bits == 0:
            m, s, bits = m * 2, s + 1, 1
        half = m + (1 << bits - 1)
        at = value(half, s)
        if at == 0:
            return half, s
        if (at > 0) != (above > 0):
            m = half
        bits -= 1
    return m, s


# --- components -------------------------------------------------------------------------------

def null_vectors(a: np.ndarray, root: Decimal, count: int) -> list[np.ndarray]:
    """Orthonormal vectors that span the null space of a - root, by inverse iteration.

    Runs in the current decimal context; the root must be known far better than its distance to
    other roots.
    """
    d = len(a)
    m = np.array([[Decimal(int(x)) for x in row] for row in a], dtype=object)
    for i in range(d):
        m[i, i] -= root
    size = max([abs(x) for x in m.ravel()] + [Decimal(1)])
    tiny = size * Decimal(10) ** (10 - DIGITS)
    order = list(range(d))
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if abs(m[k, k]) < tiny:
            m[k, k] = tiny
        m[k + 1:, k] /= m[k, k]
        m[k + 1:, k + 1:] -= m[k + 1:, k, None] * m[k, None, k + 1:]
    random = np.random.default_rng(d)
    found: list[np.ndarray] = []
    for _ in range(count):
        v = np.array([Decimal(int(x)) for x in random.integers(1, 1 << 30, d)], dtype=object)
        for _ in range(3):
            v = v[order]
            for k in range(d):
                v[k + 1:] -= m[k + 1:, k] * v[k]
            for k in range(d - 1, -1, -1):
                v[k] /= m[k, k]
                v[:k] -= m[:k, k] * v[k]
            for _ in range(2):
                v = v / (v @ v).sqrt()
                for other in found:
                    v = v - other * (other @ v)
            v = v / (v @ v).sqrt()
        found.append(v)
    return [v * (1 if max(v, key=abs) > 0 else -1) for v in found]


def components(spark, a: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, vectors over the root of the variance, shares of the trace), row by row.

    Only components of positive variance; one Spark row per distinct root.
    """
    d, trace = len(a), int(np.trace(a)) if len(a) else 0
    if n == 0 or trace == 0:
        return np.zeros((0, d)), np.zeros((0, d)), np.zeros(0)
    f = characteristic_polynomial(spark, a)
    while f[0] == 0:
        f = f[1:]
    spans = largest_roots(f, most)
    held = spark.sparkContext.broadcast((b"".join(map(packed, a)), f, spans))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, polynomial, intervals = held.value
        matrix = unpacked(data).reshape(d, d)
        for batch in batches:
            out = []
            for k in batch.column("id").to_pylist():
                m, s, bits, times = intervals[k]
                with localcontext(Context(prec=DIGITS, Emax=10**6, Emin=-10**6)):
                    if times == 1:
                        m, s = refined(polynomial, m, s, bits)
                    else:
                        m = m + (1 << bits >> 1)
                    root = Decimal(m) / Decimal(2) ** s
                    spread = root.sqrt() / n
                    for v in null_vectors(matrix, root, times):
                        out.append((k, [float(x) for x in v], [float(x / spread) for x in v],
                                    float(root / trace)))
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)],
                                             ["k", "unit", "scaled", "share"])

    rows = spark.range(0, len(spans), 1, len(spans)).mapInArrow(
        vectors, "k long, unit array<double>, scaled array<double>, share double").collect()
    rows = sorted(rows, key=lambda r: r["k"])[:most]  # rows of one root keep their order
    return (np.array([r["unit"] for r in rows]), np.array([r["scaled"] for r in rows]),
            np.array([r["share"] for r in rows]))


# --- the operator -----------------------------------------------------------------------------

def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): whole vectors as integers floor(scale * c), others dropped."""
    c = F.col("embedding")
    good = c.isNotNull() & F.forall(
        c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    cut = lambda v: F.greatest(F.least(v.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))
    return vectors.select("vec_id", "embedding").where(good).select(
        "vec_id", F.transform(c, lambda v: F.floor(cut(v)).cast("long")).alias("x"))


def centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - sums, exact: longs where they and their squares fit, else Python integers."""
    least = max([abs(int(v)) for v in sums] + [0])
    most = n * max(abs(int(y.min())), abs(int(y.max()))) + least if y.size else 0
    if y.shape[1] * most * most < 1 << 62:
        return y * n - sums.astype(np.int64)
    return y.astype(object) * n - sums


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
           ) -> DataFrame:
    """Whitened components of each vector over the covariance of the distinct integer vectors.

    ``vectors`` has vec_id and embedding; other columns are ignored. Returns vec_id, component (from
    1), n (distinct vectors), deviation (decimal: sum over dimensions of (n * x - S)^2), whitened,
    explained, identity_error. ``offset`` moves every x by the same number and so changes none of
    these; it is part of the definition x = floor(scale * c) + offset.

    Dropped: vectors that are null or hold null or non-finite entries, and vectors of another
    length than the most frequent one (of equally many, the longer). Null and repeated vec_ids are
    kept row by row. Only components of positive variance exist, so equal vectors, a single one, or
    an empty table give no rows. Entries beyond plus or minus 2**62 are held there. A deviation
    beyond 38 digits is null.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    first = lengths.first()
    d = first["d"] if first else 0
    rows = rows.where(F.size("x") == d)
    fit = cut_lineage(rows.select("x").distinct())
    n, sums, products = scatter(fit, d) if d else (0, np.zeros(0, object), np.zeros((0, 0), object))
    a = products * n - sums[:, None] * sums[None, :]
    units, scaled, shares = components(spark, a, n, most)
    k = len(units)

    def error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, means = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = centred(matrix_of(batch, "x", d), n, sums).astype(np.float64) / n @ scaled.T
            total += w.T @ w
            means += w.sum(0)
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([
            pa.array(i, pa.int32()), pa.array(j, pa.int32()),
            pa.array(np.append(total.ravel(), means))], ["i", "j", "v"])

    worst = 0.0
    if k:
        parts = fit.mapInArrow(error, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        found = np.zeros((k + 1, k))
        for r in parts.collect():
            found[r["i"], r["j"]] = r["v"] / n
        worst = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            away = centred(matrix_of(batch, "x", d), n, sums)
            square = (away * away).sum(1).tolist()
            w = away.astype(np.float64) / n @ scaled.T
            each = np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1), len(w)), pa.int32()),
                pa.array(np.full(len(each), n), pa.int64()),
                pa.array([str(v) for v in square]).take(pa.array(each)),
                pa.array(w.ravel()), pa.array(np.tile(shares, len(w))),
                pa.array(np.full(len(each), worst))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(project, f"vec_id {id_type}, component int, n long, deviation string, "
                          "whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
