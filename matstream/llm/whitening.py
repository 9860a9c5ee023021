"""Operator 13: embedding whitening from the exact characteristic polynomial of the integer scatter.

Entries become integers (``floor(64 c) + 1000000``). Over the fit list, each
distinct integer vector once, exact sums give n, S and the integer matrix
``A = n * sum x x' - S S'``, which is n^2 times the covariance (centring is exact
in integers). Then:

* the characteristic polynomial of A, modulo as many 31-bit primes as its
  coefficients' bound asks for (Maclaurin's inequality on the eigenvalues), by Hessenberg
  reduction, one Spark row a prime, and Chinese remaindering;
* the largest roots: A's polynomial has only real roots, so the sign changes of
  its coefficients shifted by a count the roots above a exactly (Budan, Descartes).
  Bisection by these counts isolates the roots, bisection by sign refines them, in integers
  scaled to ``ROOT_BITS`` bits;
* the components: inverse iteration in fixed point on the null space of A - root,
  one Spark row a root (a block of vectors for a multiple root), checked by its residual.

Rows are then projected: ``(n x - S) u / sqrt(root)``. A model holds d x k numbers
and is broadcast (``MAX_WIDTH`` checked); the driver holds the scatter, d x d numbers.

Defined cases: rows whose vector is null, holds a null or non-finite entry, or is
shorter than the longest vector are dropped; repeated rows count once in the fit list and are each
returned; components are those with a root above zero, so a table of equal
vectors (or a single one) has none and no rows; an empty table gives an empty result;
equal roots have any orthonormal basis of their space; an entry beyond 2^52 / 64 or a
deviation beyond a long raises. Only id and vector columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matstream.llm.common import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_WIDTH = 1024
ROOT_BITS = 200     # of the scaled trace
SOLVE_BITS = 192    # fractional bits of the elimination
MAX_ENTRY = 1 << 52


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col, x``: the rows whose vector is whole, as integer vectors."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(F.when(F.abs(c * F.lit(float(SCALE))) < F.lit(float(MAX_ENTRY)), c).otherwise(
        F.raise_error(F.lit("an entry is too large to be scaled exactly"))) * F.lit(float(SCALE))) + F.lit(OFFSET))
    return df.select(F.col(id_col), F.col(vec_col)).where(F.col(vec_col).isNotNull()).where(~bad).select(
        id_col, x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def _exact_gram(y: np.ndarray) -> np.ndarray:
    """``y' y`` of integers, as Python integers where a double or a long could not hold it."""
    top = int(np.abs(y).max(initial=0))
    rows = (1 << 53) // max(top * top, 1)
    if rows == 0:
        z = y.astype(object)
        return z.T @ z
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a in range(0, len(y), rows):
        part = y[a:a + rows].astype(np.float64)   # every sum below 2^53: exact
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """``n, S, A`` of the distinct integer vectors: ``width^2 / 2`` cells a task, added by Spark as decimals."""
    def kernel(batches):
        n, s, g = 0, np.zeros(width, object), np.zeros((width, width), object)
        for b in batches:
            if b.num_rows:
                y = _matrix(b.column(0)) - OFFSET
                n += len(y)
                s = s + np.array([int(c) for c in y.sum(axis=0)], object)
                g = g + _exact_gram(y)
        if n:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[-1, np.full(width, -1), i]), pa.array(np.r_[-1, np.arange(width), j]),
                 pa.array([str(n), *map(str, s), *map(str, g[i, j])])], names=["i", "j", "v"])

    cells = fit.select("x").mapInArrow(kernel, "i long, j long, v string")
    rows = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    n, s, t = 0, [0] * width, [[0] * width for _ in range(width)]
    for i, j, v in rows:
        if j < 0:
            n = int(v)
        elif i < 0:
            s[j] = int(v)
        else:
            t[i][j] = t[j][i] = int(v)
    a = [[n * t[i][j] - s[i] * s[j] for j in range(width)] for i in range(width)]
    return n, [c + n * OFFSET for c in s], a


# --- characteristic polynomial -----------------------------------------------------------------------

def _is_prime(q: int) -> bool:
    if any(q % p == 0 for p in (2, 3, 5, 7)):
        return q in (2, 3, 5, 7)
    d, r = q - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for base in (2, 3, 5, 7):    # enough below 3.2e9
        x = pow(base, d, q)
        if x in (1, q - 1):
            continue
        for _ in range(r - 1):
            x = x * x % q
            if x == q - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, falling, whose product is beyond ``bound``."""
    out, product, q = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(q):
            out.append(q)
            product *= q
        q -= 2
    return out


def charpoly_mod(a: np.ndarray, q: int) -> np.ndarray:
    """Coefficients, constant first, of det(x - a) modulo the prime ``q`` by Hessenberg reduction; ``a`` is reduced."""
    h, d = a.copy(), len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if len(below) == 0:
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, q) % q
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % q) % q
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % q).sum(axis=1)) % q
    p = np.zeros((d + 1, d + 1), np.int64)
    p[0, 0] = 1
    for m in range(1, d + 1):
        p[m, 1:] = p[m - 1, :-1]
        p[m] = (p[m] - int(h[m - 1, m - 1]) * p[m - 1] % q) % q
        t, by = 1, np.zeros(max(m - 1, 0), np.int64)
        for i in range(1, m):
            t = t * int(h[m - i, m - i - 1]) % q
            by[m - i - 1] = t * int(h[m - i - 1, m - 1]) % q
        p[m] = (p[m] - (by[:, None] * p[:m - 1] % q).sum(axis=0)) % q
    return p[d]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """The exact coefficients, constant first, of the positive semidefinite integer matrix ``a``."""
    d = len(a)
    mean = -(-sum(a[i][i] for i in range(d)) // d)   # e_k <= C(d, k) mean^k for eigenvalues not below zero
    bound = 2 * max(math.comb(d, k) * mean ** k for k in range(d + 1)) + 1
    primes = primes_beyond(bound)
    shared = spark.sparkContext.broadcast(a)

    def kernel(batches):
        exact = np.array(shared.value, object)
        for b in batches:
            qs = b.column(0).to_pylist()
            polys = [charpoly_mod((exact % q).astype(np.int64), q).tolist() for q in qs]
            yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(polys, pa.list_(pa.int64()))], names=["q", "p"])

    tasks = min(len(primes), 64)
    jobs = spark.createDataFrame([(q,) for q in primes], "q long").repartition(tasks)
    residues = {r["q"]: r["p"] for r in jobs.mapInArrow(kernel, "q long, p array<long>").collect()}
    modulus = math.prod(primes)
    parts = [(q, modulus // q * pow(modulus // q, -1, q)) for q in primes]
    coefs = [sum(residues[q][k] * w for q, w in parts) % modulus for k in range(d + 1)]
    return [c - modulus if c > modulus // 2 else c for c in coefs]


# --- real roots ---------------------------------------------------------------------------------------

def roots_above(p: list[int], at: int) -> int:
    """How many roots, with multiplicity, of the real-rooted ``p`` (constant first) are above ``at``."""
    c = list(p)
    d = len(c) - 1
    for i in range(d):           # Taylor shift by Horner's scheme
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign_at(p: list[int], at: int) -> int:
    v = 0
    for c in reversed(p):
        v = v * at + c
    return (v > 0) - (v < 0)


def largest_roots(p: list[int], k: int) -> tuple[list[tuple[int, int]], int]:
    """The up to ``k`` largest roots above zero as ``(root * 2^s, multiplicity)``, falling, and ``s``.

    ``p`` is monic with real roots, none below zero. Roots that a unit of 2^-s can't part count as one multiple root.
    """
    d = len(p) - 1
    trace = -p[d - 1] if d else 0
    rank = next((d - i for i, c in enumerate(p) if c), 0)
    k = min(k, rank)
    if k == 0:
        return [], 0
    s = max(0, ROOT_BITS - trace.bit_length())
    q = [c << (s * (d - i)) for i, c in enumerate(p)]
    out, left = [], k
    todo = [(0, (trace << s) + 1, rank, 0)]       # low, high, roots above low, roots above high; largest first
    while todo and left > 0:
        lo, hi, n_lo, n_hi = todo.pop()
        if n_lo == n_hi:
            continue
        if n_lo - n_hi == 1 or hi - lo == 1:
            if hi - lo > 1:
                up = _sign_at(q, hi) or -_sign_at(q, lo) or 1
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    sign = _sign_at(q, mid)
                    if sign == 0:
                        lo, hi = mid - 1, mid
                    elif sign == up:
                        hi = mid
                    else:
                        lo = mid
            take = min(n_lo - n_hi, left)
            out.append((hi, take))
            left -= take
            continue
        mid = (lo + hi) // 2
        n_mid = roots_above(q, mid)
        todo += [(lo, mid, n_lo, n_mid), (mid, hi, n_mid, n_hi)]
    return out, s


# --- components ---------------------------------------------------------------------------------------

def null_space(a: list[list[int]], root: int, s: int, count: int) -> list[list[float]]:
    """Orthonormal vectors of the null space of ``a - root / 2^s`` by inverse iteration in fixed point."""
    d, one = len(a), 1 << SOLVE_BITS
    shift = (root << SOLVE_BITS) >> s
    m = np.array(a, object) * one
    for i in range(d):
        m[i, i] -= shift
    start = np.array([[(7919 * (i + 1) * (c + 1) + 104_729 * c + i * i) % 1009 + 1 for c in range(count)] for i in range(d)],
                     object) * one
    m = np.concatenate([m, start], axis=1)
    for k in range(d):           # elimination, pivot of largest size
        piv = max(range(k, d), key=lambda r: abs(m[r, k]))
        if piv != k:
            m[[k, piv]] = m[[piv, k]]
        if m[k, k] == 0:
            m[k, k] = 1          # singular to the last bit: the smallest number instead
        if k + 1 < d:
            by = (m[k + 1:, k] << SOLVE_BITS) // m[k, k]
            m[k + 1:, k:] = m[k + 1:, k:] - ((by[:, None] * m[k, k:]) >> SOLVE_BITS)
    x = np.zeros((d, count), object)
    for k in range(d - 1, -1, -1):
        rest = m[k, d:] - ((m[k, k + 1:d] @ x[k + 1:]) >> SOLVE_BITS if k + 1 < d else 0)
        x[k] = (rest << SOLVE_BITS) // m[k, k]
    out: list[np.ndarray] = []
    for c in range(count):
        v = x[:, c]
        for _ in range(2):       # Gram and Schmidt, twice
            v = (v << SOLVE_BITS) // max(max(abs(e) for e in v), 1)
            for u in out:
                v = v - ((u * ((u @ v) >> SOLVE_BITS)) >> SOLVE_BITS)
        size = math.isqrt(int(v @ v))
        out.append((v << SOLVE_BITS) // max(size, 1))
    vectors = []
    exact = np.array(a, object)
    for v in out:
        off = exact @ v - ((v * shift) >> SOLVE_BITS)
        if max(abs(e) for e in off) * (1 << 40) > max(abs(shift), 1):
            raise ArithmeticError("inverse iteration did not reach the null space")
        f = [float(Fraction(int(e), one)) for e in v]
        top = max(f, key=abs)
        vectors.append([-e for e in f] if top < 0 else f)
    return vectors


@dataclass
class Whitening:
    """The model: exact ``n`` and sums, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    roots: list[Fraction] = field(default_factory=list)        # eigenvalues times n^2
    components: np.ndarray | None = None                       # d x k
    explained: list[float] = field(default_factory=list)

    @property
    def eigenvalues(self) -> list[float]:
        return [float(r / (self.n * self.n)) for r in self.roots]


def fit(vectors: DataFrame, k: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The model of the integer vectors ``x`` and its fit list (each distinct vector once, a written table)."""
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} entries: the scatter is kept on the driver up to {MAX_WIDTH}")
    once = materialise(vectors.where(F.size("x") == width).select("x").distinct(), "whiten-fit")
    if width == 0:
        return Whitening(0, []), once
    n, sums, a = exact_sums(once, width)
    trace = sum(a[i][i] for i in range(width))
    if trace == 0:
        return Whitening(n, sums), once
    found, s = largest_roots(characteristic_polynomial(spark, a), k)
    shared = spark.sparkContext.broadcast((a, s))

    def kernel(batches):
        matrix, scale = shared.value
        for b in batches:
            for at, root, count in zip(*[c.to_pylist() for c in b.columns]):
                vs = null_space(matrix, int(root), scale, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * count), pa.array(list(range(count))), pa.array(vs, pa.list_(pa.float64()))],
                    names=["at", "c", "v"])

    jobs = spark.createDataFrame([(i, str(r), c) for i, (r, c) in enumerate(found)], "at long, root string, c long")
    rows = jobs.repartition(len(found)).mapInArrow(kernel, "at long, c long, v array<double>").collect()
    by_place = {(r["at"], r["c"]): r["v"] for r in rows}
    order = [(i, c) for i, (_, m) in enumerate(found) for c in range(m)]
    roots = [Fraction(found[i][0], 1 << s) for i, _ in order]
    u = np.array([by_place[p] for p in order]).T
    return Whitening(n, sums, roots, u, [float(r / trace) for r in roots]), once


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exact."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + int(np.abs(sums).max(initial=0)) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _squares(c: np.ndarray) -> np.ndarray:
    top = max((abs(int(e)) for e in (c.max(initial=0), c.min(initial=0))), default=0)
    if top * top * max(c.shape[1], 1) < 1 << 63:
        return (c.astype(np.int64) ** 2).sum(axis=1)
    sums = [sum(int(e) ** 2 for e in row) for row in c]
    if max(sums) >= 1 << 63:
        raise OverflowError("a deviation does not fit into a long")
    return np.array(sums, np.int64)


def apply(vectors: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """``id_col, deviation, whitened ARRAY<DOUBLE>`` of every integer vector (``k`` numbers a row)."""
    spark = vectors.sparkSession
    schema = T.StructType([vectors.schema[id_col], T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if not model.roots:
        return spark.createDataFrame([], schema)
    by_root = model.components / np.array([math.sqrt(r) for r in model.roots])
    shared = spark.sparkContext.broadcast((model.n, model.sums, by_root))

    def kernel(batches):
        n, sums, u = shared.value
        sums = np.array(sums, object)
        for b in batches:
            if b.num_rows:
                c = _centred(_matrix(b.column(1)), n, sums)
                w = c.astype(np.float64) @ u
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(_squares(c)), pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))],
                    names=[id_col, "deviation", "whitened"])

    return vectors.where(F.size("x") == len(model.sums)).select(id_col, "x").mapInArrow(kernel, schema)


def identity_error(once: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance (divisor n) less the identity; one row a cell and task."""
    k = len(model.roots)
    white = apply(once.withColumn("_id", F.lit(0)), model, "_id")

    def kernel(batches):
        s, g = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                s += w.sum(axis=0)
                g += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.full(k, -1), i]), pa.array(np.r_[np.arange(k), j]),
                                          pa.array(np.r_[s, g[i, j]])], names=["i", "j", "v"])

    cells = white.select("whitened").mapInArrow(kernel, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    v = {(r["i"], r["j"]): r["v"] / model.n for r in cells.collect()}
    return max(abs(v[i, j] - v[-1, i] * v[-1, j] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(df: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``."""
    vectors = integer_vectors(df, id_col, vec_col)
    model, once = fit(vectors, k)
    error = identity_error(once, model) if model.roots else 0.0
    share = F.lit(model.explained).cast("array<double>")
    return apply(vectors, model, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("c", "whitened")).select(
        id_col, (F.col("c") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))
