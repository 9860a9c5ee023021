"""Row algebra on rows form and cells form.

Dense products with a small matrix (P1, P4, P10, P11) are numpy block
products inside Arrow batches with the matrix broadcast once; everything
else is built-in higher-order functions (``zip_with``, ``aggregate``,
``transform``) that stay inside whole-stage codegen.  Frames are aligned by
``row_id`` joins; small operands (a mean, a matrix in cells form) are
broadcast with their size known on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matstream.functions.arrowmat import from_matrix, to_matrix
from matstream.sources.frames import FEATURES, ROW_ID


def _dense_map(df: DataFrame, fn, col: str = FEATURES, out_col: str | None = None) -> DataFrame:
    """Apply ``fn(Y) -> (n, m)`` to the feature matrix of every Arrow batch; other columns pass through."""
    out_col = out_col or col
    spark = df.sparkSession
    names = df.columns
    fields = [f for f in df.schema.fields if f.name != col]
    schema = T.StructType(fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()), True)])
    bfn = spark.sparkContext.broadcast(fn)
    pos = names.index(col)

    def kernel(batches):
        f = bfn.value
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns) if i != pos]
            if b.num_rows == 0:
                out = from_matrix(np.zeros((0, 0)))
            else:
                out = from_matrix(f(to_matrix(b.column(pos))))
            yield pa.RecordBatch.from_arrays(cols + [out], names=[fl.name for fl in schema.fields])

    return df.mapInArrow(kernel, schema)


class _Product:
    """A picklable ``Y -> Y @ M`` (M broadcast with the closure)."""

    def __init__(self, M: np.ndarray, mode: str = "right"):
        self.M = np.asarray(M, np.float64)
        self.mode = mode

    def __call__(self, Y: np.ndarray) -> np.ndarray:
        if self.mode == "right":
            return Y @ self.M
        if self.mode == "transpose":
            return Y @ self.M.T
        # deflate: Y - (Y V) V'
        return Y - (Y @ self.M) @ self.M.T


def project(df: DataFrame, M: np.ndarray, col: str = FEATURES, out_col: str | None = None) -> DataFrame:
    """Row times matrix (d x m)."""
    return _dense_map(df, _Product(M, "right"), col, out_col)


def project_t(df: DataFrame, M: np.ndarray, col: str = FEATURES, out_col: str | None = None) -> DataFrame:
    """Row times the transpose of a matrix (m x d)."""
    return _dense_map(df, _Product(M, "transpose"), col, out_col)


def deflate(df: DataFrame, V: np.ndarray, col: str = FEATURES) -> DataFrame:
    """P10: ``Y (I - V V')`` as ``Y - (Y V) V'``; not centred."""
    return _dense_map(df, _Product(V, "deflate"), col)


def score(df: DataFrame, V: np.ndarray, col: str = FEATURES) -> DataFrame:
    """Scores of raw, uncentred rows ``Y V`` in column ``scores``."""
    return _dense_map(df, _Product(V, "right"), col, "scores")


BROADCAST_CELLS = 2_000_000  # of 16 bytes


def matrix_cells(spark, M: np.ndarray, names=("j", "c", "m")) -> DataFrame:
    """A small driver matrix as cells (its size is known: d x m)."""
    M = np.asarray(M, np.float64)
    rows = [(int(a), int(b), float(M[a, b])) for a in range(M.shape[0]) for b in range(M.shape[1])]
    return spark.createDataFrame(rows, f"{names[0]} INT, {names[1]} INT, {names[2]} DOUBLE")


def project_sparse(cells: DataFrame, M: np.ndarray, drop_zeros: bool = False) -> DataFrame:
    """Sparse rows (cells ``row_id, j, v``) times a matrix: sums over stored cells only.

    Output cells ``row_id, c, v``; with ``drop_zeros`` results equal to 0 are dropped.  The matrix is
    broadcast up to ``BROADCAST_CELLS`` cells and joined by shuffle beyond.
    """
    mc = matrix_cells(cells.sparkSession, M)
    mc = F.broadcast(mc) if np.size(M) <= BROADCAST_CELLS else mc
    out = cells.join(mc, "j").groupBy(ROW_ID, "c").agg(F.sum(F.col("v") * F.col("m")).alias("v"))
    return out.where(F.col("v") != 0) if drop_zeros else out


def _lit_vec(x) -> Column:
    return F.lit([float(v) for v in np.asarray(x, np.float64)]).cast("array<double>")


def center(df: DataFrame, mean, col: str = FEATURES) -> DataFrame:
    """P5: row minus the mean on every column (``mean`` is d numbers or an array column)."""
    m = mean if isinstance(mean, Column) else _lit_vec(mean)
    return df.withColumn(col, F.zip_with(col, m, lambda x, y: x - y))


def center_sparse(cells: DataFrame, mean_cells: DataFrame) -> DataFrame:
    """Subtract the mean only where a cell is stored (``mean_cells``: ``j, v``; d rows).

    Catalyst broadcasts the mean if its size allows and shuffles by ``j`` otherwise.
    """
    mc = mean_cells.select("j", F.col("v").alias("_m"))
    return cells.join(mc, "j").select(ROW_ID, "j", (F.col("v") - F.col("_m")).alias("v"))


def subtract(a: DataFrame, b: DataFrame, col: str = FEATURES) -> DataFrame:
    """Row-wise ``a - b`` of two frames aligned by ``row_id``."""
    bb = b.select(ROW_ID, F.col(col).alias("_b"))
    return a.join(bb, ROW_ID).withColumn(col, F.zip_with(col, "_b", lambda x, y: x - y)).drop("_b")


def subtract2(a: DataFrame, b: DataFrame, c: DataFrame, col: str = FEATURES) -> DataFrame:
    """``a - b - c`` in one go."""
    bb = b.select(ROW_ID, F.col(col).alias("_b"))
    cc = c.select(ROW_ID, F.col(col).alias("_c"))
    j = a.join(bb, ROW_ID).join(cc, ROW_ID)
    diff = F.zip_with(F.zip_with(col, "_b", lambda x, y: x - y), "_c", lambda x, y: x - y)
    return j.withColumn(col, diff).drop("_b", "_c")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def dot(df: DataFrame, w, col: str = FEATURES) -> DataFrame:
    """Inner product of every row with a vector."""
    return df.select(ROW_ID, _dot(F.col(col), _lit_vec(w)).alias("v"))


def dot_rows(a: DataFrame, b: DataFrame, col: str = FEATURES) -> DataFrame:
    """Inner product of aligned rows of two frames."""
    bb = b.select(ROW_ID, F.col(col).alias("_b"))
    return a.join(bb, ROW_ID).select(ROW_ID, _dot(F.col(col), F.col("_b")).alias("v"))


def to_cells(df: DataFrame, col: str = FEATURES, drop_zeros: bool = True) -> DataFrame:
    """Rows form to cells ``row_id, j, v`` (zeros absent unless ``drop_zeros=False``)."""
    cells = df.select(ROW_ID, F.posexplode(col).alias("j", "v"))
    return cells.where(F.col("v") != 0) if drop_zeros else cells


def to_rows(cells: DataFrame, d: int) -> DataFrame:
    """Cells back to rows form of width ``d``, 0 for absent cells (a group is one row: <= d cells)."""
    grouped = cells.groupBy(ROW_ID).agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0)))
    return grouped.select(ROW_ID, dense.alias(FEATURES))


def hash_draw(rid: Column) -> Column:
    """An arithmetic draw in [0, 1) from the row id, equal in every SQL engine."""
    return ((rid * F.lit(7919)) % F.lit(1000)) / F.lit(1000.0)


def sample_rows(df: DataFrame, rate: float, seed: int | None = None, draw: Column | None = None) -> DataFrame:
    """A row passes when its draw is above ``rate``: ``rate`` is the share dropped."""
    u = draw if draw is not None else F.rand(seed)
    return df.where(u > F.lit(rate))
