"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Vectors become integers, so n^2 times their covariance is a matrix of integers that tasks add up without any
rounding.  Its characteristic polynomial is computed modulo many primes, one Hessenberg reduction a prime
and the primes spread over tasks, and put together by Chinese remainders.  All its roots are real, so the
sign changes of the shifted polynomial count the roots above a point exactly (Descartes), with their
multiplicity: bisection isolates each of the largest roots and carries it on to ``ROOT_BITS`` binary places.
A component is the null vector of matrix minus root, by inverse iteration in fixed-point integers; equal
roots share one run, whose vectors are made orthogonal.

What the driver holds depends on the dimension d alone: the matrix (d^2 integers), the polynomial and the
components.  The vectors stay in Spark: one exact ``distinct``, one pass for the scatter, one for the check
of the covariance, one for the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwell.llm.common import arrow_rows, columns
from planwell.session import checkpoint, discard

#: x = floor(SCALE * c) + ORIGIN
SCALE, ORIGIN = 64, 1_000_000
#: binary places to which roots are found, and below which two roots count as equal (units of the integer matrix)
ROOT_BITS, EQUAL_BITS = 160, 64
#: binary places of the inverse iteration, besides those of the matrix's size
SOLVE_BITS = 320
#: sums travel as six limbs of 30 bits, the last one signed: 180 bits
LIMB, LIMBS = 30, 6
LONG = 1 << 63


def integer_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, y): y is floor(64 * c) of the rows whose vector can be used; x is y + ``ORIGIN``."""
    c = F.col("c")
    rows = columns(table, id_col, vector_col).toDF("vec_id", "c").select("vec_id", F.col("c").cast("array<double>").alias("c"))
    usable = c.isNotNull() & F.forall(c, lambda e: F.coalesce(F.abs(e * SCALE) < float(LONG // 2), F.lit(False)) & ~F.isnan(e))
    return rows.filter(usable).select("vec_id", F.transform(c, lambda e: F.floor(e * SCALE).cast("long")).alias("y"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, d)


def exact_products(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the rows of y and of y y^T as Python integers, from products in doubles that are all exact.

    Entries are cut into digits of 20 bits, so that 4,096 products add up to less than 2^53.
    """
    d = rows.shape[1]
    total, square = np.zeros(d, object), np.zeros((d, d), object)
    for i in range(0, len(rows), 4096):
        part, digits = rows[i:i + 4096], []
        while part.any():
            # the last digit keeps the sign; the shift rounds down, so that every digit before it is not negative
            last = np.abs(part).max() < 1 << 20
            digits.append((part if last else part & 0xFFFFF).astype(np.float64))
            part = np.zeros_like(part) if last else part >> 20
        for a, x in enumerate(digits):
            total = total + (x.sum(axis=0).astype(np.int64).astype(object) << (20 * a))
            for b, y in enumerate(digits):
                square = square + ((x.T @ y).astype(np.int64).astype(object) << (20 * (a + b)))
    return total, square


def _sums(d: int):
    """Per task: cells of the sums of y (row -1) and of the upper triangle of y y^T, as limbs."""
    rows, cols = np.triu_indices(d)

    def run(it):
        total, square, n = np.zeros(d, object), np.zeros((d, d), object), 0
        for batch in arrow_rows(it, 8 << 20):
            x = _matrix(batch.column(0), d)
            s, q = exact_products(x)
            total, square, n = total + s, square + q, n + len(x)
        if not n:
            return
        values = [n, *total, *square[rows, cols]]
        limbs = [[(int(v) >> (LIMB * k)) & ((1 << LIMB) - 1) if k < LIMBS - 1 else int(v) >> (LIMB * k) for v in values] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), *[pa.array(x, pa.int64()) for x in limbs]],
                                         names=["cell", *[f"l{k}" for k in range(LIMBS)]])

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, S, n * sum(y y^T) - S S^T) of the vectors ``y`` of ``fit``, all exact Python integers."""
    names = [f"l{k}" for k in range(LIMBS)]
    cells = fit.mapInArrow(_sums(d), "cell long, " + ", ".join(f"{x} long" for x in names)).groupBy("cell").agg(*[F.sum(x).alias(x) for x in names])
    values = {r["cell"]: sum(int(r[x]) << (LIMB * k) for k, x in enumerate(names)) for r in cells.collect()}  # d (d + 3) / 2 + 1 rows
    n = values.get(0, 0)
    total = np.array([values.get(1 + i, 0) for i in range(d)], object)
    square = np.zeros((d, d), object)
    for at, (i, j) in enumerate(zip(*np.triu_indices(d))):
        square[i, j] = square[j, i] = values.get(1 + d + at, 0)
    return n, total, n * square - np.outer(total, total)


# ------------------------------------------------------------------ the characteristic polynomial

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (under 2^32)."""
    small = [p for p in range(2, 1 << 16) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    found, high = [], top
    while len(found) < count:
        low = high - 100_000
        is_prime = np.ones(high - low, bool)
        for p in small:
            is_prime[-low % p::p] = False
        found += [int(low + i) for i in np.flatnonzero(is_prime)[::-1]]
        high = low
    return found[:count]


def characteristic_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo the prime ``p`` (below 2^31), constant term first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # row k: the polynomial of the leading k x k block
    poly[0, 0] = 1
    for k in range(d):
        row = np.zeros(d + 1, np.int64)
        row[1:] = poly[k, :-1]
        weight, product = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weight[i] = int(h[i, k]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        poly[k + 1] = (row - (poly[:k + 1] * weight[:, None] % p).sum(axis=0)) % p
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x I - matrix), constant term first, of a positive semidefinite integer matrix.

    The k-th elementary sum of roots that are not negative is at most (1 + trace / d)^d, which gives the number
    of primes; one more prime than needed checks the outcome.
    """
    d = len(matrix)
    bits = d * ((1 + int(np.trace(matrix)) // d).bit_length() + 1) + 2
    primes = primes_below(1 << 31, bits // 30 + 2)
    slots = spark.sparkContext.defaultParallelism

    def run(it):
        for batch in it:
            index = batch.column(0).to_pylist()
            found = [characteristic_mod(matrix, primes[i]) for i in index]
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], names=["i", "c"])

    jobs = spark.range(0, len(primes), 1, min(len(primes), 4 * slots))
    residues = {r["i"]: r["c"] for r in jobs.mapInArrow(run, "i long, c array<long>").collect()}  # d + 1 numbers a prime
    check = len(primes) - 1
    coefs, modulus = [0] * (d + 1), 1
    for i, p in enumerate(primes[:check]):
        inverse = pow(modulus, -1, p)
        coefs = [c + modulus * ((r - c) * inverse % p) for c, r in zip(coefs, residues[i])]
        modulus *= p
    coefs = [c - modulus if c > modulus // 2 else c for c in coefs]
    if [c % primes[check] for c in coefs] != residues[check]:
        raise ArithmeticError("the characteristic polynomial failed its check by a further prime")
    return coefs


# ------------------------------------------------------------------ roots and components

def roots_above(coefs: list[int], at: int) -> int:
    """How many roots, with multiplicity, exceed ``at``: the sign changes of p(x + at), as all roots are real."""
    shifted = list(coefs)
    for i in range(len(shifted) - 1):
        for j in range(len(shifted) - 2, i - 1, -1):
            shifted[j] += at * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_root(coefs: list[int], k: int, bits: int = ROOT_BITS) -> int:
    """The k-th largest root (from 1) times 2^bits, rounded up; 0 if that root is 0.  Roots are not negative."""
    d = len(coefs) - 1
    if k > d or roots_above(coefs, 0) < k:
        return 0
    scaled = [c << (bits * (d - i)) for i, c in enumerate(coefs)]
    low, high = 0, (-coefs[d - 1] << bits) + 1
    above_low, above_high = roots_above(scaled, low), 0

    def value(x):
        out = 0
        for c in reversed(scaled):
            out = out * x + c
        return out

    while high - low > 1 and above_low - above_high > 1:
        middle = (low + high) // 2
        above = roots_above(scaled, middle)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    # one root in (low, high]: from here on the sign tells on which side it lies
    positive = above_high % 2 == 0  # the sign right above the root, as the leading coefficient is 1
    while high - low > 1:
        middle = (low + high) // 2
        v = value(middle)
        if v == 0 or (v > 0) == positive:
            high = middle
        else:
            low = middle
    return high


def null_vectors(matrix: np.ndarray, root: int, count: int, bits: int = ROOT_BITS) -> np.ndarray:
    """``count`` orthonormal vectors, as rows of doubles, of the eigenvalues next to ``root`` / 2^bits.

    Inverse iteration in fixed-point integers: an elimination with pivoting of matrix - root, then solutions
    from fixed starting vectors, made orthogonal in each of three rounds.
    """
    d = len(matrix)
    places = SOLVE_BITS + 2 * int(np.abs(matrix).max()).bit_length()
    one = 1 << places
    a = matrix * one
    for i in range(d):
        a[i, i] -= root << (places - bits)
    order, factors = np.arange(d), np.zeros((d, d), object)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            for m in (a, factors):
                m[[k, pivot]] = m[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # a pivot of zero, of which there are as many as the root is repeated
        factors[k + 1:, k] = (a[k + 1:, k] * one) // a[k, k]
        a[k + 1:, k:] -= (factors[k + 1:, k][:, None] * a[k, k:]) >> places

    def solve(v):
        x = v[order].copy()
        for k in range(d):
            x[k + 1:] -= (factors[k + 1:, k] * x[k]) >> places
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] * one) // a[k, k]
            x[:k] -= (a[:k, k] * x[k]) >> places
        return x

    def unit(v):
        big = max(int(np.abs(v).max()).bit_length() - places, 0)
        v = v >> big
        length = math.isqrt(int((v * v).sum()))
        return v * one // max(length, 1)

    start = np.random.default_rng(13).integers(-1000, 1000, (count, d))
    basis = [unit(s.astype(object) * one) for s in start]
    for _ in range(3):
        new = []
        for v in basis:
            v = unit(solve(v))
            for _ in range(2):
                for w in new:
                    v = v - ((int((v * w).sum()) >> places) * w >> places)
                v = unit(v)
            new.append(v)
        basis = new
    return np.array([[float(x / one) for x in v] for v in basis])


def principal_components(spark: SparkSession, matrix: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
    """The largest ``k`` positive eigenvalues times 2^ROOT_BITS, falling, and their unit eigenvectors as rows.

    A root is a task of its own, then so is each group of equal roots.
    """
    if not len(matrix) or not int(np.trace(matrix)):
        return [], np.zeros((0, len(matrix)))
    coefs = characteristic_polynomial(spark, matrix)
    # one root more, so that equal roots across the last place share their space
    wanted = min(k, len(matrix))

    def root(it):
        for batch in it:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([str(largest_root(coefs, i + 1)) for i in at])], names=["i", "root"])

    found = spark.range(0, wanted, 1, wanted).mapInArrow(root, "i long, root string").collect()
    roots = [r for _, r in sorted((x["i"], int(x["root"])) for x in found) if r > 0]
    groups: list[list[int]] = []
    for r in roots:
        if groups and groups[-1][-1] - r <= 1 << (ROOT_BITS - EQUAL_BITS):
            groups[-1].append(r)
        else:
            groups.append([r])

    def vectors(it):
        for batch in it:
            at = batch.column(0).to_pylist()
            out = [null_vectors(matrix, groups[g][0], len(groups[g])).tolist() for g in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["g", "v"])

    made = spark.range(0, len(groups), 1, len(groups)).mapInArrow(vectors, "g long, v array<array<double>>").collect()
    basis = np.array([v for r in sorted(made, key=lambda r: r["g"]) for v in r["v"]]).reshape(len(roots), len(matrix))
    return roots, basis / np.linalg.norm(basis, axis=1, keepdims=True)


# ------------------------------------------------------------------ the whitened vectors

def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * y - S, exact: as int64 where it fits, else as Python integers."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(total).max(initial=0)) < LONG:
        return x * np.int64(n) - total.astype(np.int64)
    return x.astype(object) * n - total


def _covariance_sums(n, total, weights):
    """Per task: sums and products of the whitened values."""
    d, k = weights.shape
    rows, cols = np.triu_indices(k)

    def run(it):
        sums, products, any_row = np.zeros(k), np.zeros((k, k)), False
        for batch in arrow_rows(it, 8 << 20):
            w = _centred(_matrix(batch.column(0), d), n, total).astype(np.float64) @ weights
            sums, products, any_row = sums + w.sum(axis=0), products + w.T @ w, True
        if any_row:
            values = [*sums, *products[rows, cols]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array(values, pa.float64())], names=["cell", "v"])

    return run


def identity_error(fit: DataFrame, n: int, total: np.ndarray, weights: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, as measured."""
    k = weights.shape[1]
    cells = fit.mapInArrow(_covariance_sums(n, total, weights), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    value = {r["cell"]: r["v"] for r in cells.collect()}  # k (k + 3) / 2 rows
    mean = np.array([value[i] for i in range(k)]) / n
    worst = 0.0
    for at, (i, j) in enumerate(zip(*np.triu_indices(k))):
        worst = max(worst, abs(value[k + at] / n - mean[i] * mean[j] - (i == j)))
    return float(worst)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Vectors that are null or hold null or non-finite entries have no rows, nor have those with an entry of
    2^56 or more, whose integer is no long.  The fit list is each distinct integer vector once, so copies
    do not weigh; every usable row gets its own rows, those with a null or repeated id too.  All vectors must have one
    length: rows of any other length than the one that most distinct vectors have (ties: the longest) have no
    rows.  Components whose eigenvalue is 0 (exactly) are left out, so that fewer than ``components`` may come and equal vectors
    alone, or an empty table, give no row.  deviation is null where it is too large for a long.  The
    order and sign of components of equal eigenvalue are those of a fixed start; all rows share them.
    """
    spark = table.sparkSession
    rows = integer_rows(table, id_col, vector_col).select(F.col("vec_id").cast("long"), "y")
    fit = checkpoint(rows.select("y").distinct())
    lengths = fit.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    if not d:
        return spark.createDataFrame([], RESULT)
    fit_d = fit.filter(F.size("y") == d)
    n, total, matrix = scatter(fit_d, d)
    roots, basis = principal_components(spark, matrix, components)
    if not roots:
        return spark.createDataFrame([], RESULT)
    # the projection of (n x - S) / n over sqrt(root / n^2) is that of n x - S over sqrt(root)
    weights = (basis / np.array([math.sqrt(r / (1 << ROOT_BITS)) for r in roots])[:, None]).T
    trace = int(np.trace(matrix)) << ROOT_BITS
    explained = np.array([r / trace for r in roots])
    error = identity_error(fit_d, n, total, weights)
    discard(fit)
    k = len(roots)

    def project(it):
        for batch in arrow_rows(it, 4 << 20):
            c = _centred(_matrix(batch.column(1), d), n, total)
            w = c.astype(np.float64) @ weights
            if c.dtype != object and d * int(np.abs(c).max(initial=0)) ** 2 < LONG:
                square = (c * c).sum(axis=1).tolist()
            else:
                square = [v if v < LONG else None for v in (int((r * r).sum()) for r in c.astype(object))]
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), pa.array(square, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("y") == d).mapInArrow(project, RESULT)
