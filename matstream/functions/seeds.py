"""Seed matrices for the sketch (G1-G3): d x s, as numpy arrays or as cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: entries come from an arithmetic hash of (seed, i, j), the same in numpy, Spark and SQL: products stay below 2**63
PRIME = (1 << 31) - 1
_ROW, _COL, _SEED, _ADD, _MUL, _ROUNDS = 1_000_003, 7_919, 104_729, 12_345, 48_271, 3


def _hash(i, j, seed: int):
    """Hash in 0..PRIME-1 of cell (i, j); works on int64 arrays and on Spark BIGINT columns."""
    x = (i % PRIME * _ROW + j * _COL + (seed % PRIME) * _SEED + _ADD) % PRIME
    for _ in range(_ROUNDS):
        x = (x * x + x * _MUL + 11) % PRIME
    return x


def _one_seed(seed) -> int:
    """A seed, or the parts of one, as a number."""
    if seed is None:
        return int(np.random.default_rng().integers(PRIME))
    parts = seed if isinstance(seed, (list, tuple)) else [seed]
    out = 0
    for p in parts:
        out = (out * 1_000_033 + int(p)) % PRIME
    return out


def _indices(d: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.indices((d, s))
    return i.astype(np.int64), j.astype(np.int64)


def seed_gaussian(d: int, s: int, seed=None) -> np.ndarray:
    """G1: N(0, 1) entries by Box and Muller's transform of two hashes (the reference draws unseeded)."""
    i, j = _indices(d, s)
    seed = _one_seed(seed)
    a, b = _hash(i, 2 * j, seed), _hash(i, 2 * j + 1, seed)
    return np.sqrt(-2 * np.log((a + 1) / (PRIME + 1.0))) * np.cos(2 * np.pi * (b / float(PRIME)))


def seed_uniform(d: int, s: int, seed=None) -> np.ndarray:
    """U[0, 1) entries."""
    return _hash(*_indices(d, s), _one_seed(seed)) / float(PRIME)


def seed_validation(d: int, s: int) -> np.ndarray:
    """The deterministic validation seed ``(i + j) % 10 + 1``."""
    i, j = np.indices((d, s))
    return ((i + j) % 10 + 1).astype(np.float64)


def make_seed(kind, d: int, s: int, salt: int = 0) -> np.ndarray:
    """Seed by name: ``'validation'``, ``'uniform:<seed>'``, or an int for a Gaussian seed.

    ``salt`` separates the seeds of different calls in one run (step, purpose).
    """
    if kind == "validation":
        return seed_validation(d, s)
    if isinstance(kind, str) and kind.startswith("uniform"):
        base = int(kind.split(":", 1)[1]) if ":" in kind else 0
        return seed_uniform(d, s, [base, salt])
    if kind is None:
        return seed_gaussian(d, s, None)
    return seed_gaussian(d, s, [int(kind), salt])


def seed_cells(spark: SparkSession, d: int, s: int, kind: str = "validation", seed: int = 0) -> DataFrame:
    """The seed as cells ``i, j, v`` built by Spark from ``spark.range(d * s)``: the numbers of the numpy forms."""
    base = spark.range(d * s).select((F.col("id") / F.lit(s)).cast("int").alias("i"),
                                     (F.col("id") % F.lit(s)).cast("int").alias("j"))
    if kind == "validation":
        v = ((F.col("i") + F.col("j")) % 10 + 1).cast("double")
    elif kind == "gaussian":
        i, j = F.col("i").cast("long"), F.col("j").cast("long")
        a, b = _hash(i, j * 2, _one_seed(seed)), _hash(i, j * 2 + 1, _one_seed(seed))
        v = F.sqrt(F.lit(-2.0) * F.log((a + 1) / F.lit(PRIME + 1.0))) * F.cos(F.lit(2 * np.pi) * (b / F.lit(float(PRIME))))
    elif kind == "uniform":
        v = _hash(F.col("i").cast("long"), F.col("j").cast("long"), _one_seed(seed)) / F.lit(float(PRIME))
    else:
        raise ValueError(kind)
    return base.select("i", "j", v.alias("v"))
