"""Sketched SVD of a window (I1), its residual spectral norm (I2) and error.

Two equivalent ways to feed the same driver-side rounds:

* ``method="gram"`` (default, ``d <= 1024``): one distributed pass gives the
  centred Gram ``C`` of the rows; every round is then ``YtZ = C B``,
  ``ZtZ = B'C B`` on the driver, so ``max_iter`` and ``q`` cost no scans.
* ``method="rows"``: the reference's flow, one distributed sketch pass
  (A9) per round with the seed broadcast; driver state is d x s only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from matstream.functions import linalg as la
from matstream.functions.seeds import make_seed
from matstream.operators import moments as mo
from matstream.sources.frames import FEATURES

JVM_GRAM_MAX_D = 16


@dataclass
class SketchResult:
    S: np.ndarray                 # all s singular values of the last round
    V: np.ndarray                 # d x k right singular vectors
    n_rows: int
    sigma_k1: float               # S[k] of the last round
    n_iter: int = 0               # error-checked rounds
    errors: list = field(default_factory=list)
    sketch_s: list = field(default_factory=list)
    preprocess_s: float = 0.0

    @property
    def total_s(self) -> float:
        return self.preprocess_s + sum(self.sketch_s)

    @property
    def avg_sketch_s(self) -> float:
        return sum(self.sketch_s) / len(self.sketch_s) if self.sketch_s else 0.0


def _check(k: int, subsample: int, d: int):
    if subsample < 1:
        raise ValueError("subsample >= 1 is required (the (k+1)-th singular value is read)")
    if k < 1 or k >= d:
        raise ValueError(f"need 1 <= k < d (k={k}, d={d})")


def window_gram(df: DataFrame, col: str = FEATURES) -> tuple[int, np.ndarray, np.ndarray]:
    """``(n, mean, centred Gram)`` of all rows: a mean pass, then the Gram of ``y - mean``."""
    from pyspark.sql import functions as F

    n, mean = mo.mean_vector(df, col)
    d = mean.shape[0]
    if d <= JVM_GRAM_MAX_D:
        # narrow rows: the d(d+1)/2 centred products as plain JVM aggregates (whole-stage codegen, no Python)
        x = [F.col(col)[i] - F.lit(float(mean[i])) for i in range(d)]
        aggs = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
        aggs += [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
        row = df.agg(*aggs).first()
        G = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                G[i, j] = G[j, i] = row[f"g{i}_{j}"]
        s1 = np.array([row[f"s{i}"] for i in range(d)])
        return n, mean + s1 / n, G - np.outer(s1, s1) / n
    one = df.select(F.lit(0).alias("chunk"), F.col(col))
    cells = mo.chunk_moments(one, "chunk", shift={0: mean}, col=col)
    _, s1, G = mo.collect_moments(cells, mean.shape[0])[0]
    return n, mean + s1 / n, G - np.outer(s1, s1) / n


# --- driver rounds on a known centred Gram -------------------------------------------------

def sketch_from_gram(C: np.ndarray, n: int, k: int, subsample: int, max_iter: int = 1, tolerance: float = 0.05,
                     calc_error: bool = False, q: int = 10, subsample_norm: int = 1, seed="validation",
                     salt: int = 0) -> SketchResult:
    d = C.shape[0]
    _check(k, subsample, d)
    s = k + subsample
    B = make_seed(seed, d, s, salt * 2)
    res = SketchResult(np.zeros(s), np.zeros((d, k)), n, 0.0)
    prev_err = tolerance + 1
    it = 0
    while it < max_iter and prev_err > tolerance:
        t0 = time.perf_counter()
        S, V, B = la.gram_round(C, B, k)
        res.S, res.V, res.sigma_k1 = S, V, float(S[k])
        res.sketch_s.append(time.perf_counter() - t0)
        if calc_error:
            res.n_iter += 1
            spec = residual_norm_from_gram(C, V, subsample_norm, q, seed, salt * 2 + 1)
            err = relative_error(spec, res.sigma_k1)
            res.errors.append(err)
            prev_err = err
        it += 1
    return res


def residual_norm_from_gram(C: np.ndarray, V: np.ndarray, subsample_norm: int = 1, q: int = 10,
                            seed="validation", salt: int = 1) -> float:
    """I2 on a known centred Gram: top singular value of the part ``V`` leaves, 4 decimals."""
    d = C.shape[0]
    s = 1 + subsample_norm
    Vo = la.orth_basis(V)
    B = make_seed(seed, d, s, salt)
    S = 0.0
    for _ in range(q):
        seed_m = la.orth_cols(B - Vo @ (Vo.T @ B))
        seed_m = seed_m - Vo @ (Vo.T @ seed_m)
        yz = C @ seed_m
        zz = seed_m.T @ yz
        new_s, B = _norm_round(yz, (zz + zz.T) / 2, Vo, s)
        if new_s == S:
            break
        S = new_s
    return S


def _norm_round(yz, zz, Vo, s):
    Fm = la.orthonormal_factor(zz)
    A = (yz @ Fm).T
    A = A - (A @ Vo) @ Vo.T
    sv = np.linalg.svd(A, compute_uv=False) if A.size else np.zeros(1)
    B = A.T
    if B.shape[1] < s:
        B = np.hstack([B, np.zeros((B.shape[0], s - B.shape[1]))])
    return la.java_round4(float(sv[0]) if sv.size else 0.0), B


def relative_error(spectral_norm: float, sigma_k1: float) -> float:
    """``(residual norm - S[k]) / S[k]`` with the estimated (k+1)-th value."""
    return (spectral_norm - sigma_k1) / sigma_k1 if sigma_k1 else float("inf")


# --- the same rounds fed by distributed sketch passes ---------------------------------------

def sketch_from_rows(df: DataFrame, k: int, subsample: int, max_iter: int = 1, tolerance: float = 0.05,
                     calc_error: bool = False, q: int = 10, subsample_norm: int = 1, seed="validation",
                     salt: int = 0, col: str = FEATURES) -> SketchResult:
    t0 = time.perf_counter()
    n, mean = mo.mean_vector(df, col)
    return _rounds(lambda omega: mo.sketch_moments(df, omega, mean, col)[2:], n, mean.shape[0], time.perf_counter() - t0, k,
                   subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed, salt)


def sketch_from_matrix(Y: np.ndarray, k: int, subsample: int, max_iter: int = 1, tolerance: float = 0.05,
                       calc_error: bool = False, q: int = 10, subsample_norm: int = 1, seed="validation",
                       salt: int = 0) -> SketchResult:
    """:func:`sketch_from_rows` of the rows ``Y`` that a task holds; nothing of d x d."""
    t0 = time.perf_counter()
    Yc = Y - Y.mean(axis=0)

    def one_pass(omega):
        Z = Yc @ omega
        return Yc.T @ Z, Z.T @ Z

    return _rounds(one_pass, *Y.shape, time.perf_counter() - t0, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm,
                   seed, salt)


def _rounds(one_pass, n: int, d: int, preprocess_s: float, k: int, subsample: int, max_iter: int, tolerance: float,
            calc_error: bool, q: int, subsample_norm: int, seed, salt: int) -> SketchResult:
    """The rounds of a sketch; ``one_pass(omega)`` gives the centred ``YtZ, ZtZ`` of the rows with ``Z = Y omega``."""
    _check(k, subsample, d)
    s = k + subsample
    res = SketchResult(np.zeros(s), np.zeros((d, k)), n, 0.0, preprocess_s=preprocess_s)
    B = make_seed(seed, d, s, salt * 2)
    prev_err = tolerance + 1
    it = 0
    while it < max_iter and prev_err > tolerance:
        t0 = time.perf_counter()
        yz, zz = one_pass(la.orth_cols(B))
        S, V, B = la.sketch_round(yz, (zz + zz.T) / 2, k)
        res.S, res.V, res.sigma_k1 = S, V, float(S[k])
        res.sketch_s.append(time.perf_counter() - t0)
        if calc_error:
            res.n_iter += 1
            spec = _residual_rounds(one_pass, V, subsample_norm, q, seed, salt * 2 + 1)
            err = relative_error(spec, res.sigma_k1)
            res.errors.append(err)
            prev_err = err
        it += 1
    return res


def residual_norm_from_rows(df: DataFrame, V: np.ndarray, mean: np.ndarray, subsample_norm: int = 1, q: int = 10,
                            seed="validation", salt: int = 1, col: str = FEATURES) -> float:
    return _residual_rounds(lambda omega: mo.sketch_moments(df, omega, mean, col)[2:], V, subsample_norm, q, seed, salt)


def _residual_rounds(one_pass, V: np.ndarray, subsample_norm: int, q: int, seed, salt: int) -> float:
    d = V.shape[0]
    s = 1 + subsample_norm
    Vo = la.orth_basis(V)
    B = make_seed(seed, d, s, salt)
    S = 0.0
    for _ in range(q):
        seed_m = la.orth_cols(B - Vo @ (Vo.T @ B))
        seed_m = seed_m - Vo @ (Vo.T @ seed_m)
        yz, zz = one_pass(seed_m)
        new_s, B = _norm_round(yz, (zz + zz.T) / 2, Vo, s)
        if new_s == S:
            break
        S = new_s
    return S


# --- public entry points ----------------------------------------------------------------------

def sketch_svd(df: DataFrame, k: int, subsample: int, max_iter: int = 1, tolerance: float = 0.05,
               calc_error: bool = False, q: int = 10, subsample_norm: int = 1, seed="validation",
               method: str = "auto", col: str = FEATURES) -> SketchResult:
    """Top singular values and right vectors of the mean-centred rows."""
    df = df.select(col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if method == "auto":
            from matstream.sources.frames import width
            method = "gram" if width(df, col) <= 1024 else "rows"
        if method == "rows":
            return sketch_from_rows(df, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed,
                                    col=col)
        t0 = time.perf_counter()
        n, _, C = window_gram(df, col)
        res = sketch_from_gram(C, n, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed)
        res.preprocess_s = time.perf_counter() - t0
        return res
    finally:
        df.unpersist()


def residual_norm(df: DataFrame, V: np.ndarray, subsample_norm: int = 1, q: int = 10, seed="validation",
                  col: str = FEATURES, method: str = "auto") -> float:
    """I2 on rows: spectral norm of the centred rows outside ``span(V)``, rounded to 4 decimals.

    ``method="gram"`` (``d <= 1024``) needs d x d numbers on the driver; ``"rows"`` makes one distributed
    sketch pass per round and holds d x s.
    """
    V = np.asarray(V, np.float64)
    if method == "auto":
        method = "gram" if V.shape[0] <= 1024 else "rows"
    if method == "rows":
        df = df.select(col).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _, mean = mo.mean_vector(df, col)
            return residual_norm_from_rows(df, V, mean, subsample_norm, q, seed, col=col)
        finally:
            df.unpersist()
    n, _, C = window_gram(df, col)
    return residual_norm_from_gram(C, V, subsample_norm, q, seed)


# --- sparse rows ------------------------------------------------------------------------------

def _cells_moments(cells: DataFrame, omega: np.ndarray, n_rows: int):
    """``YtZ, ZtZ`` of sparse rows on the driver (d x s numbers); columns without a stored cell are zero."""
    d, s = omega.shape
    yz, zz = np.zeros((d, s)), np.zeros((s, s))
    for r in mo.sparse_sketch_cells(cells, omega, n_rows).toArrow().to_pylist():
        (yz if r["part"] == "yz" else zz)[r["i"], r["j"]] = r["v"]
    return yz, (zz + zz.T) / 2


def sketch_svd_cells(cells: DataFrame, n_rows: int, d: int, k: int, subsample: int, max_iter: int = 1,
                     tolerance: float = 0.05, calc_error: bool = False, q: int = 10, subsample_norm: int = 1,
                     seed="validation") -> SketchResult:
    """I1 on cells ``row_id, j, v`` (zeros absent): one sparse sketch pass a round, rows never made dense.

    ``n_rows`` counts all rows, those without a stored cell included.
    """
    _check(k, subsample, d)
    t0 = time.perf_counter()
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        s = k + subsample
        res = SketchResult(np.zeros(s), np.zeros((d, k)), n_rows, 0.0, preprocess_s=time.perf_counter() - t0)
        B = make_seed(seed, d, s, 0)
        err = tolerance + 1
        for _ in range(max_iter):
            if err <= tolerance:
                break
            t0 = time.perf_counter()
            yz, zz = _cells_moments(cells, la.orth_cols(B), n_rows)
            S, V, B = la.sketch_round(yz, zz, k)
            res.S, res.V, res.sigma_k1 = S, V, float(S[k])
            res.sketch_s.append(time.perf_counter() - t0)
            if calc_error:
                res.n_iter += 1
                err = relative_error(residual_norm_cells(cells, n_rows, V, subsample_norm, q, seed), res.sigma_k1)
                res.errors.append(err)
        return res
    finally:
        cells.unpersist()


def residual_norm_cells(cells: DataFrame, n_rows: int, V: np.ndarray, subsample_norm: int = 1, q: int = 10,
                        seed="validation") -> float:
    """I2 on cells: the rounds of :func:`residual_norm` with the sparse sketch pass."""
    Vo = la.orth_basis(V)
    s = 1 + subsample_norm
    B = make_seed(seed, V.shape[0], s, 1)
    S = 0.0
    for _ in range(q):
        seed_m = la.orth_cols(B - Vo @ (Vo.T @ B))
        seed_m = seed_m - Vo @ (Vo.T @ seed_m)
        new_s, B = _norm_round(*_cells_moments(cells, seed_m, n_rows), Vo, s)
        if new_s == S:
            break
        S = new_s
    return S


def singular_values_frame(spark: SparkSession, res: SketchResult, digits: int | None = None) -> DataFrame:
    """``comp, sigma`` for all s values of a result."""
    vals = [float(x) if digits is None else round(float(x), digits) for x in res.S]
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "comp INT, sigma DOUBLE")
