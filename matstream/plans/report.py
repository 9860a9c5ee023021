"""Run reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.operators import moments as mo
from matstream.sources.frames import FEATURES


def run_summary(stats: DataFrame) -> DataFrame:
    """I8: mean run time and mean spectral error over all steps, the first block included."""
    return stats.agg(F.avg("total_s").alias("mean_run_s"), F.avg("spectral_error").alias("mean_spectral_error"))


def avg_sketch_time(stats: DataFrame) -> DataFrame:
    """Mean of the per-round sketch times of every step."""
    return stats.select("step", F.aggregate("sketch_s", F.lit(0.0), lambda a, x: a + x).alias("_t"),
                        F.size("sketch_s").alias("_n")) \
        .select("step", F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(0.0).alias("avg_sketch_s"))


def centred_gram_cells(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """Centred Gram ``Yc'Yc`` of all rows as cells ``i, j, v`` (upper triangle), computed by Spark.

    A mean pass gives the shift (d numbers); the Gram of ``y - mean`` has no
    cancellation; the remaining ``s s'/n`` correction is applied in the JVM.
    """
    n, mean = mo.mean_vector(df, col)
    one = df.select(F.lit(0).alias("chunk"), F.col(col))
    cells = mo.chunk_moments(one, "chunk", shift={0: mean}, col=col).cache()
    sums = cells.where((F.col("i") == -1) & (F.col("j") >= 0)).select(F.col("j").alias("k"), F.col("v").alias("s"))
    gram = cells.where(F.col("i") >= 0)
    si = F.broadcast(sums.select(F.col("k").alias("ii"), F.col("s").alias("si")))
    sj = F.broadcast(sums.select(F.col("k").alias("jj"), F.col("s").alias("sj")))
    out = gram.join(si, gram.i == si.ii).join(sj, gram.j == sj.jj)
    return out.select("i", "j", (F.col("v") - F.col("si") * F.col("sj") / F.lit(float(n))).alias("v"))


def explained_variance(df: DataFrame, V: np.ndarray, col: str = FEATURES) -> DataFrame:
    """Explained, residual and total sums of squares of the centred rows for orthonormal components ``V``.

    One pass after the mean: every centred row's squared norm (JVM) and its
    projection on ``V`` (Arrow-batch product), summed by Spark;
    ``residual = total - explained``.
    """
    from matstream.operators.rows import center, project

    V = np.asarray(V, np.float64)
    _, mean = mo.mean_vector(df, col)
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
    centred = center(df.select(col), mean, col).withColumn("_sq", sq(F.col(col)))
    proj = project(centred, V, col, "_p")
    return proj.agg(F.sum(sq(F.col("_p"))).alias("explained"), F.sum("_sq").alias("total")) \
        .select("explained", (F.col("total") - F.col("explained")).alias("residual"), "total")
