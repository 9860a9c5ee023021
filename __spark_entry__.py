"""

Every query reads the given tables whole, but for those whose feature is a
prefix or range of rows (``first_block``, ``rows_at``, ``slide_window``,
``first_rows_by_time``, ``window_spectral_error``, ``events_sliding_head``).  Computed columns are aliased identically on both
sides; doubles are rounded to 6 decimals (plus 0.0, so -0.0 cannot differ);
ids are BIGINT and positions INT on both sides.

Fixtures derived from the tables, the same in Spark and SQL:

* *rows*: ``embeddings`` with ``row_id = vec_id`` (dense 0..N-1), doubles;
* *quantised*: the rows rounded to multiples of 1/8 (many exact zeros, exact
  sums), the sparse matrix for the cells-form operators;
* *pairs V*: components ``(e_0+e_1)/sqrt 2, (e_2+e_3)/sqrt 2, (e_4+e_5)/sqrt 2``;
* *validation seed*: ``(i + j) % 10 + 1``, d taken from the table.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sliding_oracle
from matstream.functions.seeds import seed_gaussian, seed_uniform, seed_validation
from matstream.operators import moments as mo
from matstream.operators import rows as ro
from matstream.operators.rowid import first_block, rows_at, with_row_id
from matstream.operators.windows import (expand_windows, schedule_frame, slide, window_rows, window_schedule,
                                         with_chunk)
from matstream.plans import report
from matstream.plans.sketch import singular_values_frame, sketch_svd
from matstream.plans.sliding import change_points, skipped_keys, sliding_pca, sliding_pca_by_key, window_spectral_error, window_spectral_errors
from matstream.sources import sinks
from matstream.session import scratch_path
from matstream.sources.frames import FEATURES, ROW_ID, from_array, from_columns, parse_dense_lines, read_dense_csv

SF0001 = "/root/testdata/sf0.001"

# flagship settings
K, BLOCK, STRIDE, SUBSAMPLE, MAX_ITER = 3, 100, 50, 4, 2
SEED_S = 4  # sketch width for the operator-level oracles


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _rows(spark, sf_dir) -> DataFrame:
    return from_array(_t(spark, sf_dir, "embeddings"), "embedding", row_id="vec_id")


def _quantised(spark, sf_dir) -> DataFrame:
    r = _rows(spark, sf_dir)
    return r.withColumn(FEATURES, F.transform(FEATURES, lambda x: F.round(x * 8.0) / 8.0))


def _pairs_v(d: int, k: int = 3) -> np.ndarray:
    V = np.zeros((d, k))
    for c in range(k):
        V[2 * c, c] = V[2 * c + 1, c] = 1 / math.sqrt(2)
    return V


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _cells_out(df: DataFrame, drop_zeros: bool = False) -> DataFrame:
    c = ro.to_cells(df, drop_zeros=drop_zeros)
    return c.select(F.col(ROW_ID).cast("long").alias(ROW_ID), F.col("j").cast("int").alias("j"), _r6(F.col("v")).alias("v"))


def _width(df: DataFrame) -> int:
    return df.select(F.size(FEATURES)).first()[0]


def _n(df: DataFrame) -> int:
    return df.count()


# --- flagship ------------------------------------------------------------------------------------

def _flagship(spark: SparkSession, sf_dir: str):
    return sliding_pca(_rows(spark, sf_dir), k=K, block=BLOCK, stride=STRIDE, subsample=SUBSAMPLE,
                       max_iter=MAX_ITER, dataset="embeddings")


def entry(spark: SparkSession) -> DataFrame:
    """Sliding-window PCA of ``embeddings`` at sf0.001: the scores of every scheduled row."""
    return _flagship(spark, SF0001).scores


# --- sources -------------------------------------------------------------------------------------

def q_rows_from_columns(spark, sf_dir):
    r = from_columns(_t(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], order_by="o_orderkey")
    return _cells_out(r)


def q_dense_csv_roundtrip(spark, sf_dir):
    lines = sinks.csv_lines(_rows(spark, sf_dir))
    back = parse_dense_lines(lines).select(ROW_ID, FEATURES)
    return _cells_out(back)


def q_dense_csv_file(spark, sf_dir):
    """The rows written as text files and read back in file order."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(_rows(spark, sf_dir), path)
    return _cells_out(read_dense_csv(spark, path))


def q_dense_text(spark, sf_dir):
    return sinks.dense_text_lines(_rows(spark, sf_dir), digits=6)


def q_lil_text(spark, sf_dir):
    return sinks.lil_lines(_quantised(spark, sf_dir), digits=6)


def q_coo_cells(spark, sf_dir):
    c = sinks.coo_cells(_quantised(spark, sf_dir))
    return c.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), _r6(F.col("v")).alias("v"))


# --- row numbering, windows ----------------------------------------------------------------------

def q_row_id_by_time(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", "ts")
    return with_row_id(ev, "ts", ties=["event_id"]).select("event_id", ROW_ID)


def _row_sums(df):
    return df.select(F.col(ROW_ID).cast("long").alias(ROW_ID),
                     _r6(F.aggregate(FEATURES, F.lit(0.0), lambda a, x: a + x)).alias("row_sum"))


def q_first_block(spark, sf_dir):
    return _row_sums(first_block(_rows(spark, sf_dir), BLOCK))


def q_rows_at(spark, sf_dir):
    r = _rows(spark, sf_dir)
    sched = schedule_frame(spark, _n(r), BLOCK, STRIDE)
    step = sched.where(F.col("step") == 3)
    ids = step.select(F.explode(F.sequence("enter_lo", F.col("enter_hi") - 1)).alias(ROW_ID))
    return _row_sums(rows_at(r, ids))


def q_window_schedule(spark, sf_dir):
    return schedule_frame(spark, _n(_t(spark, sf_dir, "embeddings")), BLOCK, STRIDE, None)


def q_window_schedule_short(spark, sf_dir):
    return schedule_frame(spark, _n(_t(spark, sf_dir, "embeddings")), 97, 41, None)


def q_slide_window(spark, sf_dir):
    r = _rows(spark, sf_dir)
    sched = window_schedule(_n(r), BLOCK, STRIDE)
    win = window_rows(r, sched, 2)
    _, _, _, lo, hi = sched.steps[3]
    return _row_sums(slide(win, r.where((F.col(ROW_ID) >= lo) & (F.col(ROW_ID) < hi)), hi - lo))


def q_expand_windows(spark, sf_dir):
    r = _rows(spark, sf_dir)
    sched = window_schedule(_n(r), BLOCK, STRIDE)
    return expand_windows(r, sched).select(F.col("step").cast("int").alias("step"), ROW_ID)


def q_expand_windows_short(spark, sf_dir):
    r = _rows(spark, sf_dir)
    sched = window_schedule(_n(r), 97, 41, None)
    return expand_windows(r, sched).select(F.col("step").cast("int").alias("step"), ROW_ID)


# --- aggregations --------------------------------------------------------------------------------

def q_row_count(spark, sf_dir):
    li = from_columns(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return mo.row_count(li)


def _jv(df):
    return df.select(F.col("j").cast("int").alias("j"), _r6(F.col("v")).alias("v"))


def q_column_sum(spark, sf_dir):
    return _jv(mo.column_sum(_rows(spark, sf_dir)))


def q_column_mean(spark, sf_dir):
    return _jv(mo.column_mean(_rows(spark, sf_dir)))


def q_column_abs_sum(spark, sf_dir):
    return _jv(mo.column_abs_sum(_rows(spark, sf_dir)))


def q_column_max(spark, sf_dir):
    return _jv(mo.column_max(_rows(spark, sf_dir)))


def q_row_max(spark, sf_dir):
    return mo.row_max(_rows(spark, sf_dir)).select(ROW_ID, _r6(F.col("v")).alias("v"))


_LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem_rows(spark, sf_dir):
    # lineitem has no unique key: order-free operators only (unique, non-dense ids)
    return from_columns(_t(spark, sf_dir, "lineitem"), _LI_COLS)


def q_lineitem_column_stats(spark, sf_dir):
    st = mo.column_stats(_lineitem_rows(spark, sf_dir), ("count", "mean", "max"))
    z = st.select("count", F.posexplode(F.arrays_zip("mean", "max")).alias("j", "s"))
    # the columns have two decimals: the exact sum comes back from the mean, so both engines round the same number
    mean = F.round(F.col("s.mean") * F.col("count"), 2) / F.col("count")
    return z.select(F.col("j").cast("int").alias("j"), _r6(mean).alias("mean"),
                    _r6(F.greatest(F.col("s.max"), F.lit(0.0))).alias("max"))


def q_lineitem_sketch_svd(spark, sf_dir):
    res = sketch_svd(_lineitem_rows(spark, sf_dir), k=1, subsample=2, max_iter=4, seed="validation")
    return singular_values_frame(spark, res)


def q_matrix_sum(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    cells = emb.select("label", F.posexplode("embedding").alias("p", "v")).select(
        "label", (F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).cast("int").alias("j"),
        F.col("v").cast("double").alias("v"))
    return mo.matrix_sum(cells, by="label").select("label", "i", "j", _r6(F.col("v")).alias("v"))


def _sketch_cells(spark, sf_dir):
    r = _rows(spark, sf_dir)
    d = _width(r)
    _, mean = mo.mean_vector(r)
    return mo.centred_sketch_cells(r, seed_validation(d, SEED_S), mean)


def q_sketch_sum(spark, sf_dir):
    c = _sketch_cells(spark, sf_dir)
    return c.where(F.col("part") == "z").select(F.col("j").cast("int").alias("j"), _r6(F.col("v")).alias("v"))


def q_cross_moment(spark, sf_dir):
    c = _sketch_cells(spark, sf_dir)
    return c.where(F.col("part") == "yz").select("i", "j", _r6(F.col("v")).alias("v"))


def q_sketch_gram(spark, sf_dir):
    c = _sketch_cells(spark, sf_dir)
    return c.where(F.col("part") == "zz").select("i", "j", _r6(F.col("v")).alias("v"))


def q_chunk_moments(spark, sf_dir):
    r = _rows(spark, sf_dir)
    sched = window_schedule(_n(r), BLOCK, STRIDE)
    cells = mo.chunk_moments(with_chunk(r, sched))
    return cells.select("chunk", "i", "j", _r6(F.col("v")).alias("v"))


def q_total_variance(spark, sf_dir):
    g = report.centred_gram_cells(_rows(spark, sf_dir))
    return mo.total_variance(g).select(_r6(F.col("total_variance")).alias("total_variance"))


def q_centred_gram(spark, sf_dir):
    g = report.centred_gram_cells(_rows(spark, sf_dir))
    return g.select("i", "j", _r6(F.col("v")).alias("v"))


# --- projections and row algebra -----------------------------------------------------------------

def q_project_seed(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _cells_out(ro.project(r, seed_validation(_width(r), SEED_S)))


def q_project_t(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _cells_out(ro.project_t(r, seed_validation(_width(r), SEED_S).T))


def _sparse_cells(spark, sf_dir):
    return ro.to_cells(_quantised(spark, sf_dir))


def q_project_sparse(spark, sf_dir):
    q = _quantised(spark, sf_dir)
    out = ro.project_sparse(ro.to_cells(q), seed_validation(_width(q), SEED_S))
    return out.select(ROW_ID, F.col("c").cast("int").alias("c"), _r6(F.col("v")).alias("v"))


def q_project_sparse_nz(spark, sf_dir):
    q = _quantised(spark, sf_dir)
    M = seed_validation(_width(q), SEED_S) - 5.5   # signed weights, so exact zeros occur
    out = ro.project_sparse(ro.to_cells(q), M, drop_zeros=True)
    return out.select(ROW_ID, F.col("c").cast("int").alias("c"), _r6(F.col("v")).alias("v"))


def q_center(spark, sf_dir):
    r = _rows(spark, sf_dir)
    _, mean = mo.mean_vector(r)
    return _cells_out(ro.center(r, mean))


def q_center_sparse(spark, sf_dir):
    q = _quantised(spark, sf_dir)
    out = ro.center_sparse(ro.to_cells(q), mo.column_mean(q))
    return out.select(ROW_ID, F.col("j").cast("int").alias("j"), _r6(F.col("v")).alias("v"))


def _reconstruction(r):
    V = _pairs_v(_width(r))
    return ro.project_t(ro.project(r, V), V)


def q_subtract(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _cells_out(ro.subtract(r, _reconstruction(r)))


def q_subtract2(spark, sf_dir):
    r = _rows(spark, sf_dir)
    _, mean = mo.mean_vector(r)
    means = r.select(ROW_ID, F.lit([float(x) for x in mean]).cast("array<double>").alias(FEATURES))
    return _cells_out(ro.subtract2(r, means, _reconstruction(r)))


def q_dot_vector(spark, sf_dir):
    r = _rows(spark, sf_dir)
    w = seed_validation(_width(r), 1)[:, 0]
    return ro.dot(r, w).select(ROW_ID, _r6(F.col("v")).alias("v"))


def q_dot_rows(spark, sf_dir):
    r = _rows(spark, sf_dir)
    _, mean = mo.mean_vector(r)
    return ro.dot_rows(r, ro.center(r, mean)).select(ROW_ID, _r6(F.col("v")).alias("v"))


def q_deflate_fixed_v(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _cells_out(ro.deflate(r, _pairs_v(_width(r))))


def q_score_fixed_v(spark, sf_dir):
    r = _rows(spark, sf_dir)
    s = ro.score(r, _pairs_v(_width(r)))
    return s.select(ROW_ID, F.posexplode("scores").alias("comp", "v")).select(
        ROW_ID, F.col("comp").cast("int").alias("comp"), _r6(F.col("v")).alias("v"))


def q_cells_roundtrip(spark, sf_dir):
    q = _quantised(spark, sf_dir)
    back = ro.to_rows(ro.to_cells(q), _width(q))
    return _cells_out(back, drop_zeros=False)


def q_sample_rows(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return ro.sample_rows(r, 0.3, draw=ro.hash_draw(F.col(ROW_ID))).select(ROW_ID)


def q_project_gaussian(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _cells_out(ro.project(r, seed_gaussian(_width(r), SEED_S, 7)))


def q_project_uniform(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return _cells_out(ro.project(r, seed_uniform(_width(r), SEED_S, 7)))


def q_sparse_sketch(spark, sf_dir):
    """A7 and A8 from the cells of the quantised rows."""
    q = _quantised(spark, sf_dir)
    out = mo.sparse_sketch_cells(ro.to_cells(q), seed_validation(_width(q), SEED_S), _n(q))
    return out.select("part", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), _r6(F.col("v")).alias("v"))


# --- iterative analytics -------------------------------------------------------------------------

def q_sketch_svd(spark, sf_dir):
    res = sketch_svd(_rows(spark, sf_dir), k=1, subsample=1, max_iter=10, seed="validation")
    return singular_values_frame(spark, res, 6)


def q_sketch_svd_rows(spark, sf_dir):
    res = sketch_svd(_rows(spark, sf_dir), k=1, subsample=1, max_iter=10, seed="validation", method="rows")
    return singular_values_frame(spark, res, 6)


def q_sketch_svd_error(spark, sf_dir):
    res = sketch_svd(_rows(spark, sf_dir), k=3, subsample=4, max_iter=5, calc_error=True, q=10,
                     subsample_norm=2, seed=11)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(res.errors)], "round INT, rel_error DOUBLE")


def q_sketch_svd_error_k1(spark, sf_dir):
    """I1 with the error loop (I2, I3) in the configuration the SQL oracle follows in closed form."""
    res = sketch_svd(_rows(spark, sf_dir), k=1, subsample=1, max_iter=5, tolerance=0.05, calc_error=True, q=10,
                     subsample_norm=1, seed="validation")
    return spark.createDataFrame([(i, round(float(e), 6) + 0.0) for i, e in enumerate(res.errors)],
                                 "round INT, rel_error DOUBLE")


def q_lineitem_sketch_svd_k1(spark, sf_dir):
    """2-wide sketch of the whole ``lineitem`` numerics (steep spectrum, values ~1e7): 2 decimals."""
    res = sketch_svd(_lineitem_rows(spark, sf_dir), k=1, subsample=1, max_iter=4, seed="validation")
    return singular_values_frame(spark, res).select("comp", (F.round("sigma", 2) + F.lit(0.0)).alias("sigma"))


def q_window_spectral_error(spark, sf_dir):
    from matstream.plans.sketch import window_gram
    r = first_block(_rows(spark, sf_dir), BLOCK)
    n, _, C = window_gram(r)
    val = window_spectral_error(C, n, _pairs_v(C.shape[0]), seed="validation")
    return spark.createDataFrame([(round(val, 6),)], "spectral_error DOUBLE")


def q_residual_norm(spark, sf_dir):
    from matstream.plans.sketch import residual_norm
    r = _rows(spark, sf_dir)
    val = residual_norm(r, _pairs_v(_width(r)), subsample_norm=1, q=10, seed="validation")
    return spark.createDataFrame([(val,)], "residual_norm DOUBLE")


def q_explained_variance(spark, sf_dir):
    r = _rows(spark, sf_dir)
    ev = report.explained_variance(r, _pairs_v(_width(r)))
    return ev.select(*[_r6(F.col(c)).alias(c) for c in ("explained", "residual", "total")])


def q_sliding_pca(spark, sf_dir):
    return _flagship(spark, sf_dir).scores


def q_sliding_pca_k1(spark, sf_dir):
    """The sliding run with one component and a 2-wide sketch: the configuration the SQL oracle can follow."""
    res = sliding_pca(_rows(spark, sf_dir), k=1, block=BLOCK, stride=STRIDE, subsample=1, max_iter=1,
                      seed="validation", dataset="embeddings")
    return res.scores.select(ROW_ID, "step", F.posexplode("scores").alias("comp", "v")).select(
        ROW_ID, "step", F.col("comp").cast("int").alias("comp"), _r6(F.col("v")).alias("v"))


def q_sliding_stats_k1(spark, sf_dir):
    res = sliding_pca(_rows(spark, sf_dir), k=1, block=BLOCK, stride=STRIDE, subsample=1, max_iter=1,
                      seed="validation", dataset="embeddings")
    return res.stats.select("step", "n_rows", _r6(F.col("sigma_k1")).alias("sigma_k1"),
                            _r6(F.col("spectral_error")).alias("spectral_error"))


def q_sliding_by_label_k1(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    r = emb.select(F.col("vec_id").alias(ROW_ID), F.col("embedding").cast("array<double>").alias(FEATURES), "label")
    out = sliding_pca_by_key(r, ["label"], k=1, block=30, stride=5, subsample=1, max_iter=1)
    return out.select("label", ROW_ID, "step", F.posexplode("scores").alias("comp", "v")).select(
        "label", ROW_ID, "step", F.col("comp").cast("int").alias("comp"), _r6(F.col("v")).alias("v"))


def q_stream_pca_k1(spark, sf_dir):
    from matstream.streaming.stream import stream_pca_table
    out = stream_pca_table(spark, sf_dir, "embeddings", k=1, block=BLOCK, stride=STRIDE, subsample=1, max_iter=1)
    return out.select(ROW_ID, "step", F.posexplode("scores").alias("comp", "v")).select(
        ROW_ID, "step", F.col("comp").cast("int").alias("comp"), _r6(F.col("v")).alias("v"))


def _k1_run(spark, sf_dir):
    return sliding_pca(_rows(spark, sf_dir), k=1, block=BLOCK, stride=STRIDE, subsample=1, max_iter=1,
                       seed="validation", dataset="embeddings")


def q_change_points_k1(spark, sf_dir):
    return change_points(_k1_run(spark, sf_dir).stats).select("step", F.col(ROW_ID).cast("long").alias(ROW_ID))


def q_run_summary_k1(spark, sf_dir):
    return report.run_summary(_k1_run(spark, sf_dir).stats).select(
        _r6(F.col("mean_spectral_error")).alias("mean_spectral_error"))


def q_sliding_model_k1(spark, sf_dir):
    m = _k1_run(spark, sf_dir).model
    return m.select("step", "comp", _r6(F.col("sigma")).alias("sigma"), F.posexplode("v").alias("i", "x")).select(
        "step", "comp", "sigma", F.col("i").cast("int").alias("i"), _r6(F.col("x")).alias("x"))


def _k2_run(spark, sf_dir, **more):
    """Two components and a 3-wide sketch: the widest configuration that SQL follows in closed form."""
    return sliding_pca(_rows(spark, sf_dir), k=2, block=BLOCK, stride=STRIDE, subsample=1, max_iter=1,
                       seed="validation", dataset="embeddings", **more)


def _score_cells(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.select(*keys, ROW_ID, "step", F.posexplode("scores").alias("comp", "v")).select(
        *keys, ROW_ID, "step", F.col("comp").cast("int").alias("comp"), _r6(F.col("v")).alias("v"))


def q_sliding_pca_k2(spark, sf_dir):
    return _score_cells(_k2_run(spark, sf_dir).scores)


def q_sliding_pca_k2_rows(spark, sf_dir):
    """The same run with the window kept as a DataFrame."""
    return _score_cells(_k2_run(spark, sf_dir, method="rows").scores)


def q_sliding_model_k2(spark, sf_dir):
    m = _k2_run(spark, sf_dir).model
    return m.select("step", "comp", _r6(F.col("sigma")).alias("sigma"), F.posexplode("v").alias("i", "x")).select(
        "step", "comp", "sigma", F.col("i").cast("int").alias("i"), _r6(F.col("x")).alias("x"))


def q_sliding_stats_k2(spark, sf_dir):
    return _k2_run(spark, sf_dir).stats.select("step", "n_rows", _r6(F.col("sigma_k1")).alias("sigma_k1"),
                                               _r6(F.col("spectral_error")).alias("spectral_error"))


def q_change_points_k2(spark, sf_dir):
    return change_points(_k2_run(spark, sf_dir).stats).select("step", F.col(ROW_ID).cast("long").alias(ROW_ID))


def q_run_summary_k2(spark, sf_dir):
    return report.run_summary(_k2_run(spark, sf_dir).stats).select(
        _r6(F.col("mean_spectral_error")).alias("mean_spectral_error"))


def q_sliding_by_label_k2(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    r = emb.select(F.col("vec_id").alias(ROW_ID), F.col("embedding").cast("array<double>").alias(FEATURES), "label")
    return _score_cells(sliding_pca_by_key(r, ["label"], k=2, block=30, stride=5, subsample=1, max_iter=1), "label")


def q_stream_pca_k2(spark, sf_dir):
    """The run over a stream of five ordered micro-batches, the third delivered twice."""
    from matstream.streaming.stream import stream_pca_table
    return _score_cells(stream_pca_table(spark, sf_dir, "embeddings", k=2, block=BLOCK, stride=STRIDE, subsample=1,
                                         max_iter=1, batches=5, replay=2))


def q_sliding_pca_k2_window(spark, sf_dir):
    """The same run over the rows in order, the window's rows held by one task."""
    return _score_cells(_k2_run(spark, sf_dir, method="window").scores)


def q_sliding_pca_k2_bands(spark, sf_dir):
    """The same run written in bands of three steps."""
    return _score_cells(_k2_run(spark, sf_dir, run_path=scratch_path(spark, "bands"), band_steps=3).scores)


def q_sketch_svd_cells(spark, sf_dir):
    """I1 from the cells of the quantised rows, never dense."""
    from matstream.plans.sketch import sketch_svd_cells
    r = _quantised(spark, sf_dir)
    res = sketch_svd_cells(ro.to_cells(r), _n(r), _width(r), k=1, subsample=1, max_iter=3, seed="validation")
    return singular_values_frame(spark, res, 6)


def q_residual_norm_cells(spark, sf_dir):
    """I2 from the cells of the quantised rows."""
    from matstream.plans.sketch import residual_norm_cells
    r = _quantised(spark, sf_dir)
    val = residual_norm_cells(ro.to_cells(r), _n(r), _pairs_v(_width(r)), subsample_norm=1, q=3, seed="validation")
    return spark.createDataFrame([(val,)], "residual_norm DOUBLE")


def q_window_spectral_errors(spark, sf_dir):
    """I4 for every window of the schedule, from the moments of its chunks."""
    r = _rows(spark, sf_dir)
    return window_spectral_errors(r, _pairs_v(_width(r)), BLOCK, STRIDE).select(
        "step", _r6(F.col("spectral_error")).alias("spectral_error"))


def q_residual_norm_rows(spark, sf_dir):
    from matstream.plans.sketch import residual_norm
    r = _rows(spark, sf_dir)
    val = residual_norm(r, _pairs_v(_width(r)), subsample_norm=1, q=10, seed="validation", method="rows")
    return spark.createDataFrame([(val,)], "residual_norm DOUBLE")


def q_scores_sink(spark, sf_dir):
    """The scores of the k1 run written with their settings and read back."""
    path = scratch_path(spark, "scores")
    sinks.write_scores(_k1_run(spark, sf_dir).scores, path, block=BLOCK, stride=STRIDE)
    return spark.read.parquet(path).select(ROW_ID, "step", F.posexplode("scores").alias("comp", "v"), "block", "stride").select(
        ROW_ID, "step", F.col("comp").cast("int").alias("comp"), _r6(F.col("v")).alias("v"), "block", "stride")


def q_model_sink(spark, sf_dir):
    """The model of the k1 run, as for the scores."""
    path = scratch_path(spark, "model")
    sinks.write_model(_k1_run(spark, sf_dir).model, path, block=BLOCK, stride=STRIDE)
    m = spark.read.parquet(path)
    return m.select("step", "comp", _r6(F.col("sigma")).alias("sigma"), F.posexplode("v").alias("i", "x"), "block", "stride").select(
        "step", "comp", "sigma", F.col("i").cast("int").alias("i"), _r6(F.col("x")).alias("x"), "block", "stride")


def q_stats_sink(spark, sf_dir):
    """The statistics of the k1 run, as for the scores."""
    path = scratch_path(spark, "stats")
    sinks.write_stats(_k1_run(spark, sf_dir).stats, path, block=BLOCK, stride=STRIDE)
    return spark.read.parquet(path).select("step", "n_rows", _r6(F.col("sigma_k1")).alias("sigma_k1"),
                                           _r6(F.col("spectral_error")).alias("spectral_error"), "block", "stride")


def q_skipped_keys(spark, sf_dir):
    """Customers with too few orders for a block of 10."""
    return skipped_keys(_t(spark, sf_dir, "orders"), ["o_custkey"], 10)


def q_events_sliding_k1(spark, sf_dir):
    """Uncapped k=1 run over all ``events`` in time order (value, hour, minute, day of week); 4 decimals."""
    ev = _t(spark, sf_dir, "events").select("ts", "event_id", "value", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"),
                                             F.dayofweek("ts").alias("dow"))
    rows = from_columns(ev, ["value", "hour", "minute", "dow"], order_by="ts", ties=["event_id"])
    res = sliding_pca(rows, k=1, block=1000, stride=500, subsample=1, max_iter=1, max_slides=None,
                      seed="validation", dataset="events")
    return res.scores.select(ROW_ID, "step", F.posexplode("scores").alias("comp", "v")).select(
        ROW_ID, "step", F.col("comp").cast("int").alias("comp"), (F.round("v", 4) + F.lit(0.0)).alias("v"))


def q_sliding_model(spark, sf_dir):
    return _flagship(spark, sf_dir).model


def q_sliding_stats(spark, sf_dir):
    return _flagship(spark, sf_dir).stats.drop("preprocess_s", "sketch_s", "avg_sketch_s", "total_s")


def q_change_points(spark, sf_dir):
    return change_points(_flagship(spark, sf_dir).stats)


def q_run_summary(spark, sf_dir):
    return report.run_summary(_flagship(spark, sf_dir).stats).select("mean_spectral_error")


def q_avg_sketch_time(spark, sf_dir):
    return report.avg_sketch_time(_flagship(spark, sf_dir).stats)


def q_sliding_pca_uncapped(spark, sf_dir):
    res = sliding_pca(_rows(spark, sf_dir), k=K, block=97, stride=41, subsample=2, max_iter=3, max_slides=None,
                      seed=7, dataset="embeddings")
    return res.scores


def q_events_sliding_pca(spark, sf_dir):
    """Sliding PCA over the whole ``events`` table in time order: value plus time features, no slide cap."""
    ev = _t(spark, sf_dir, "events").select(
        "ts", "event_id", "value", "user_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"),
        F.dayofweek("ts").alias("dow"))
    rows = from_columns(ev, ["value", "user_id", "hour", "minute", "dow"], order_by="ts", ties=["event_id"])
    res = sliding_pca(rows, k=1, block=1000, stride=500, subsample=1, max_iter=3, max_slides=None, seed=3,
                      dataset="events")
    return res.scores


def q_events_sliding_head(spark, sf_dir):
    """Capped sliding PCA (20 slides) over ``events`` in time order without stored ids: only the prefix is numbered."""
    ev = _t(spark, sf_dir, "events").select(
        "ts", "event_id", F.array("value", "user_id", F.hour("ts"), F.minute("ts"), F.dayofweek("ts"))
        .cast("array<double>").alias(FEATURES))
    res = sliding_pca(ev, k=1, block=1000, stride=200, subsample=1, max_slides=20, max_iter=3, order_by="ts", seed=3,
                      dataset="events", ties=("event_id",))
    return res.scores


def q_first_rows_by_time(spark, sf_dir):
    from matstream.operators.rowid import first_rows
    ev = _t(spark, sf_dir, "events").select("event_id", "ts")
    return first_rows(ev, "ts", 2500, ties=["event_id"]).select("event_id", ROW_ID)


def q_sliding_by_label(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings")
    r = emb.select(F.col("vec_id").alias(ROW_ID), F.col("embedding").cast("array<double>").alias(FEATURES), "label")
    return sliding_pca_by_key(r, ["label"], k=2, block=30, stride=5, subsample=2, max_iter=2)


def q_stream_score(spark, sf_dir):
    from matstream.streaming.stream import stream_score_table
    d = _width(_rows(spark, sf_dir))
    s = stream_score_table(spark, sf_dir, "embeddings", _pairs_v(d))
    return s.select(F.col(ROW_ID).cast("long").alias(ROW_ID), F.posexplode("scores").alias("comp", "v")).select(
        ROW_ID, F.col("comp").cast("int").alias("comp"), _r6(F.col("v")).alias("v"))


def q_stream_pca(spark, sf_dir):
    from matstream.streaming.stream import stream_pca_table
    return stream_pca_table(spark, sf_dir, "embeddings", k=K, block=BLOCK, stride=STRIDE, subsample=SUBSAMPLE,
                            max_iter=MAX_ITER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
    return own | _llm_queries()


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the llm subpackage and the corpus pipeline, if they are there."""
    try:
        import corpus_pipeline
        from matstream.llm.queries import QUERIES
    except ModuleNotFoundError as e:
        if (e.name or "").startswith(("matstream.llm", "corpus_pipeline")):
            return {}
        raise
    return QUERIES | {"pipeline": corpus_pipeline.run}


def _llm_oracles() -> dict[str, str]:
    if not _llm_queries():
        return {}
    import corpus_pipeline
    from matstream.llm.oracles import ORACLES
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


# --- DuckDB oracles ------------------------------------------------------------------------------

_CELLS = ("select vec_id::BIGINT as row_id, unnest(range(len(embedding)))::INTEGER as j, "
          "unnest(embedding)::DOUBLE as v from embeddings")
_QCELLS = ("select row_id, j, round(v * 8.0) / 8.0 as v from (" + _CELLS + ")")
_R6 = "round({}, 6) + 0.0"


def _r(x: str) -> str:
    return _R6.format(x)


_SCHED = """
with nn as (select count(*) as n from embeddings),
steps as (
  select 0::INTEGER as step, 0::BIGINT as drop_lo, 0::BIGINT as drop_hi, 0::BIGINT as enter_lo,
         {block}::BIGINT as enter_hi from nn
  union all
  select t::INTEGER, ((t - 1) * {stride})::BIGINT,
         ((t - 1) * {stride} + least({block} + (t - 1) * {stride} + {stride}, n) - ({block} + (t - 1) * {stride}))::BIGINT,
         ({block} + (t - 1) * {stride})::BIGINT, least({block} + (t - 1) * {stride} + {stride}, n)::BIGINT
  from nn, range(1, n + 1) r(t)
  where {block} + (t - 1) * {stride} < n {cap}
)"""


def _sched(block, stride, cap):
    return _SCHED.format(block=block, stride=stride, cap=f"and t <= {cap}" if cap else "")


# centred Gram of a cells relation `src(row_id, j, v)` as list of rows, and the
# 2-wide subspace iteration (k=1, subsample=1) with the validation seed, in closed form
_SKETCH2 = """
cmean as (select j, avg(v) as m from src group by j),
cc as (select s.row_id, s.j, s.v - cm.m as v from src s join cmean cm using (j)),
gram as (select a.j as i, b.j as j, sum(a.v * b.v) as g from cc a join cc b on a.row_id = b.row_id group by 1, 2),
grows as (select i, list(g order by j) as r from gram group by i),
mat as (select list(r order by i) as m, count(*) as d from grows),
st(it, b1, b2, s0, s1) as (
  select 0, list_transform(range(d), lambda x: ((x % 10) + 1)::DOUBLE),
         list_transform(range(d), lambda x: (((x + 1) % 10) + 1)::DOUBLE), null::DOUBLE, null::DOUBLE from mat
  union all
  select it + 1, n1, n2,
         sqrt((g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2)),
         sqrt(greatest((g11 + g22) / 2 - sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2), 0))
  from (
    select it, n1, n2, list_inner_product(n1, n1) as g11, list_inner_product(n1, n2) as g12,
           list_inner_product(n2, n2) as g22
    from (
      select it, list_transform(y1, lambda x: x / l11) as n1,
             list_transform(range(len(y1)), lambda p: (y2[p + 1] - y1[p + 1] * l21 / l11) / l22) as n2
      from (
        select it, y1, y2, l11, l21, sqrt(z22 - l21 * l21) as l22
        from (
          select it, y1, y2, sqrt(z11) as l11, z12 / sqrt(z11) as l21, z22
          from (
            select it, y1, y2, list_inner_product(b1, y1) as z11, list_inner_product(b1, y2) as z12,
                   list_inner_product(b2, y2) as z22
            from (
              select it, b1, b2, list_transform(m, lambda rr: list_inner_product(rr, b1)) as y1,
                     list_transform(m, lambda rr: list_inner_product(rr, b2)) as y2
              from st, mat where it < {iters}
            )
          )
        )
      )
    )
  )
)"""

_PAIRS_DEFLATED = ("select row_id, j, case when j < 6 then v - avg(v) over (partition by row_id, j // 2) "
                   "else v end as v from (" + _CELLS + ")")


def _dfl(x: str) -> str:
    """Deflate a list by the pairs V: subtract the pair average on the first six positions."""
    return (f"list_transform(range(len({x})), lambda p: case when p < 6 then {x}[p + 1] - "
            f"({x}[2 * (p // 2) + 1] + {x}[2 * (p // 2) + 2]) / 2.0 else {x}[p + 1] end)")


# residual norm (I2) with s = 2: deflated seed, one round, deflated result, top value rounded half up
# to 4 decimals; stops when the rounded value repeats
_RESNORM = """
cmean as (select j, avg(v) as m from src group by j),
cc as (select s.row_id, s.j, s.v - cm.m as v from src s join cmean cm using (j)),
gram as (select a.j as i, b.j as j, sum(a.v * b.v) as g from cc a join cc b on a.row_id = b.row_id group by 1, 2),
grows as (select i, list(g order by j) as r from gram group by i),
mat as (select list(r order by i) as m, count(*) as d from grows),
st(it, b1, b2, s, stop) as (
  select 0, list_transform(range(d), lambda x: ((x % 10) + 1)::DOUBLE),
         list_transform(range(d), lambda x: (((x + 1) % 10) + 1)::DOUBLE), 0.0::DOUBLE, false from mat
  union all
  select it + 1, n1d, n2d, s_new, s_new = s from (
    select it, s, n1d, n2d,
           floor(sqrt((g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2)) * 10000 + 0.5) / 10000 as s_new
    from (
      select it, s, n1d, n2d, list_inner_product(n1d, n1d) as g11, list_inner_product(n1d, n2d) as g12,
             list_inner_product(n2d, n2d) as g22
      from (
        select it, s, {d_n1} as n1d, {d_n2} as n2d
        from (
          select it, s, list_transform(y1, lambda x: x / l11) as n1,
                 list_transform(range(len(y1)), lambda p: (y2[p + 1] - y1[p + 1] * l21 / l11) / l22) as n2
          from (
            select it, s, y1, y2, l11, l21, sqrt(z22 - l21 * l21) as l22
            from (
              select it, s, y1, y2, sqrt(z11) as l11, z12 / sqrt(z11) as l21, z22
              from (
                select it, s, y1, y2, list_inner_product(e1, y1) as z11, list_inner_product(e1, y2) as z12,
                       list_inner_product(e2, y2) as z22
                from (
                  select it, s, e1, e2, list_transform(m, lambda rr: list_inner_product(rr, e1)) as y1,
                         list_transform(m, lambda rr: list_inner_product(rr, e2)) as y2
                  from (select it, s, {d_b1} as e1, {d_b2} as e2 from st where it < {q} and not stop), mat
                )
              )
            )
          )
        )
      )
    )
  )
)"""


def _k1_round(src: str, keep: list[str]) -> str:
    """One 2-wide sketch round (k=1, subsample=1, validation seed) on a window given as a list of rows ``w``.

    Outputs ``keep..., w, s0, vnew``: the top singular value and its right
    vector with the canonical sign (largest-magnitude entry positive).
    """
    k = ", ".join(keep + ["w"])
    return f"""(
  select {k}, s0, s1, list_transform(vv, lambda x: x * sg) as vnew from (
    select {k}, s0, s1, vv,
           case when vv[list_position(list_transform(vv, lambda x: abs(x)),
                                      list_max(list_transform(vv, lambda x: abs(x))))] < 0 then -1.0 else 1.0 end as sg
    from (
      select {k}, sqrt(lam) as s0, sqrt(greatest(g11 + g22 - lam, 0)) as s1,
             list_transform(range(len(n1)), lambda p: (e1 * n1[p + 1] + e2 * n2[p + 1]) / sqrt(e1 * e1 + e2 * e2)
                                                       / sqrt(lam)) as vv
      from (
        select {k}, n1, n2, lam, g11, g22,
               case when g12 <> 0 then g12 when g11 >= g22 then 1.0 else 0.0 end as e1,
               case when g12 <> 0 then lam - g11 when g11 >= g22 then 0.0 else 1.0 end as e2
        from (
          select {k}, n1, n2, g11, g12, g22, (g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2) as lam
          from (
            select {k}, n1, n2, list_inner_product(n1, n1) as g11, list_inner_product(n1, n2) as g12,
                   list_inner_product(n2, n2) as g22
            from (
              select {k}, list_transform(y1, lambda x: x / l11) as n1,
                     list_transform(range(len(y1)), lambda p: (y2[p + 1] - y1[p + 1] * l21 / l11) / l22) as n2
              from (
                select {k}, y1, y2, l11, l21, sqrt(z22 - l21 * l21) as l22 from (
                  select {k}, y1, y2, sqrt(z11) as l11, z12 / sqrt(z11) as l21, z22 from (
                    select {k}, y1, y2, list_inner_product(b1, y1) as z11, list_inner_product(b1, y2) as z12,
                           list_inner_product(b2, y2) as z22 from (
                      select {k}, b1, b2, list_transform(c, lambda rr: list_inner_product(rr, b1)) as y1,
                             list_transform(c, lambda rr: list_inner_product(rr, b2)) as y2 from (
                        select {k}, list_transform(range(len(m)), lambda i: list_transform(range(len(m)),
                                 lambda j: list_sum(list_transform(w, lambda r: (r[i + 1] - m[i + 1]) * (r[j + 1] - m[j + 1])))))
                                 as c
                        from (
                          select {k}, list_transform(range(len(w[1])),
                                                     lambda j: list_avg(list_transform(w, lambda r: r[j + 1]))) as m
                          from {src}
                        )
                      ), seedb
                    )
                  )
                )
              )
            )
          )
        )
      )
    )
  )
)"""


_EMB_TAB = "select vec_id::BIGINT as rid, list_transform(embedding, lambda x: x::DOUBLE) as y from embeddings"


def _sliding_k1_ctes(block: int, stride: int, cap: int | None, tab: str = _EMB_TAB) -> str:
    """The sliding run (k=1, subsample=1, one round, validation seed) with the window kept as a list of rows.

    ``tab`` gives the numbered rows ``rid, y``; the schedule is derived from its row count.
    """
    sched = _sched(block, stride, cap).replace("with nn as (select count(*) as n from embeddings)",
                                               f"with recursive tab as ({tab}),\nnn as (select count(*) as n from tab)", 1)
    first = (f"(select 0 as t0, list(y order by rid) as w from tab where rid < {block})")
    slid = ("(select st.t, st.v, st.s, list_transform(list_concat(list_slice(st.w, e.st + 1, len(st.w)), e.rows), "
            "lambda r: list_transform(range(len(r)), lambda p: r[p + 1] - list_inner_product(r, st.v) * st.v[p + 1])) "
            "as w from st join entering e on e.step = st.t + 1)")
    return f"""{sched},
dd as (select max(len(y)) as d from tab),
seedb as (select list_transform(range(d), lambda x: ((x % 10) + 1)::DOUBLE) as b1,
                 list_transform(range(d), lambda x: (((x + 1) % 10) + 1)::DOUBLE) as b2 from dd),
entering as (select s.step, list(t.y order by t.rid) as rows, count(*) as st
             from steps s join tab t on t.rid >= s.enter_lo and t.rid < s.enter_hi where s.step > 0 group by s.step),
st(t, w, v, s, s1) as (
  select 0, w, vnew, s0, s1 from {_k1_round(first, ["t0"])}
  union all
  select t + 1, w, case when s0 > s then vnew else v end, case when s0 > s then s0 else s end, s1
  from {_k1_round(slid, ["t", "v", "s"])}
)"""


def _sliding_k1_sql(block: int, stride: int, cap: int | None, tab: str = _EMB_TAB, digits: int = 6) -> str:
    rnd = _r if digits == 6 else (lambda x: f"round({x}, {digits}) + 0.0")
    return _sliding_k1_ctes(block, stride, cap, tab) + f"""
select tab.rid as row_id, st.t::INTEGER as step, 0::INTEGER as comp, {rnd('list_inner_product(tab.y, st.v)')} as v
from tab join st on st.t = (case when tab.rid < {block} then 0 else floor((tab.rid - {block}) / {stride})::INTEGER + 1 end)
where tab.rid < (select max(enter_hi) from steps)"""


def _sliding_k1_stats_sql(block: int, stride: int, cap: int | None, rnd=None) -> str:
    """Per step: window rows, the (k+1)-th singular value and the spectral error (10 rounds on the deflated window)."""
    return _sliding_k1_ctes(block, stride, cap) + """,
sw as (select t, list_transform(w, lambda r: list_transform(range(len(r)),
               lambda p: r[p + 1] - list_inner_product(r, v) * v[p + 1])) as w from st),
swm as (select t, w, list_transform(range(len(w[1])), lambda j: list_avg(list_transform(w, lambda r: r[j + 1]))) as mu
        from sw),
cm as (select t, list_transform(range(len(mu)), lambda i: list_transform(range(len(mu)),
         lambda j: list_sum(list_transform(w, lambda r: (r[i + 1] - mu[i + 1]) * (r[j + 1] - mu[j + 1]))))) as m
       from swm),
rec(t, it, b1, b2, s0) as (
  select t, 0, b1, b2, null::DOUBLE from cm, seedb
  union all
  select t, it + 1, n1, n2, sqrt((g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2)) from (
    select t, it, n1, n2, list_inner_product(n1, n1) as g11, list_inner_product(n1, n2) as g12,
           list_inner_product(n2, n2) as g22 from (
      select t, it, list_transform(y1, lambda x: x / l11) as n1,
             list_transform(range(len(y1)), lambda p: (y2[p + 1] - y1[p + 1] * l21 / l11) / l22) as n2 from (
        select t, it, y1, y2, l11, l21, sqrt(z22 - l21 * l21) as l22 from (
          select t, it, y1, y2, sqrt(z11) as l11, z12 / sqrt(z11) as l21, z22 from (
            select t, it, y1, y2, list_inner_product(b1, y1) as z11, list_inner_product(b1, y2) as z12,
                   list_inner_product(b2, y2) as z22 from (
              select rec.t, rec.it, rec.b1, rec.b2,
                     list_transform(cm.m, lambda rr: list_inner_product(rr, rec.b1)) as y1,
                     list_transform(cm.m, lambda rr: list_inner_product(rr, rec.b2)) as y2
              from rec join cm on cm.t = rec.t where rec.it < 10
            )
          )
        )
      )
    )
  )
)
select st.t::INTEGER as step, len(st.w)::BIGINT as n_rows, """ + (rnd or _r)("st.s1") + """ as sigma_k1, """ + \
        (rnd or _r)("rec.s0") + """ as spectral_error
from st join rec on rec.t = st.t and rec.it = 10"""


def _sliding_k1_by_label_sql(block: int, stride: int, cap: int) -> str:
    """The k=1 sliding run per ``label``: rows numbered within the label by ``vec_id``, one recursion per label."""
    first = (f"(select label, list(y order by rid) as w from tab where rid < {block} "
             f"and label in (select label from nn) group by label)")
    slid = ("(select st.label, st.t, st.v, st.s, list_transform(list_concat(list_slice(st.w, e.st + 1, len(st.w)), "
            "e.rows), lambda r: list_transform(range(len(r)), lambda p: r[p + 1] - list_inner_product(r, st.v) * "
            "st.v[p + 1])) as w from st join entering e on e.label = st.label and e.step = st.t + 1)")
    return f"""
with recursive
tab as (select label, (row_number() over (partition by label order by vec_id) - 1)::BIGINT as rid,
               list_transform(embedding, lambda x: x::DOUBLE) as y from embeddings),
nn as (select label, count(*) as n from tab group by label having count(*) >= {block}),
steps as (
  select label, 0 as step, {block}::BIGINT as enter_lo, {block}::BIGINT as enter_hi from nn
  union all
  select label, t::INTEGER, ({block} + (t - 1) * {stride})::BIGINT,
         least({block} + (t - 1) * {stride} + {stride}, n)::BIGINT
  from nn, range(1, n + 1) r(t) where {block} + (t - 1) * {stride} < n and t <= {cap}
),
dd as (select max(len(y)) as d from tab),
seedb as (select list_transform(range(d), lambda x: ((x % 10) + 1)::DOUBLE) as b1,
                 list_transform(range(d), lambda x: (((x + 1) % 10) + 1)::DOUBLE) as b2 from dd),
entering as (select s.label, s.step, list(t.y order by t.rid) as rows, count(*) as st
             from steps s join tab t on t.label = s.label and t.rid >= s.enter_lo and t.rid < s.enter_hi
             where s.step > 0 group by s.label, s.step),
st(label, t, w, v, s) as (
  select label, 0, w, vnew, s0 from {_k1_round(first, ["label"])}
  union all
  select label, t + 1, w, case when s0 > s then vnew else v end, case when s0 > s then s0 else s end
  from {_k1_round(slid, ["label", "t", "v", "s"])}
),
ends as (select label, max(enter_hi) as e from steps group by label)
select tab.label, tab.rid as row_id, st.t::INTEGER as step, 0::INTEGER as comp,
       {_r('list_inner_product(tab.y, st.v)')} as v
from tab join ends using (label)
join st on st.label = tab.label
  and st.t = (case when tab.rid < {block} then 0 else floor((tab.rid - {block}) / {stride})::INTEGER + 1 end)
where tab.rid < ends.e"""


def _sliding_k1_tail(select: str) -> str:
    return _sliding_k1_ctes(BLOCK, STRIDE, 1_000_000_000) + "\n" + select


def _dfl_v(x: str, v: str) -> str:
    """Deflate list ``x`` by the unit vector ``v``: ``x - v (x . v)``."""
    return f"list_transform(range(len({x})), lambda p: {x}[p + 1] - {v}[p + 1] * list_inner_product({x}, {v}))"


def _round_from(b1: str, b2: str, tail: str) -> str:
    """SQL columns of one 2-wide round on matrix ``m`` from seed columns ``b1, b2``: y1, y2 -> n1, n2."""
    return f"""
        select *, list_transform(y1, lambda x: x / l11) as n1,
               list_transform(range(len(y1)), lambda p: (y2[p + 1] - y1[p + 1] * l21 / l11) / l22) as n2 from (
          select *, sqrt(z22 - l21 * l21) as l22 from (
            select *, sqrt(z11) as l11, z12 / sqrt(z11) as l21 from (
              select *, list_inner_product({b1}, y1) as z11, list_inner_product({b1}, y2) as z12,
                     list_inner_product({b2}, y2) as z22 from (
                select *, list_transform(m, lambda rr: list_inner_product(rr, {b1})) as y1,
                       list_transform(m, lambda rr: list_inner_product(rr, {b2})) as y2 from (
                  {tail}
                )
              )
            )
          )
        )"""


def _sketch_error_k1_sql(max_iter: int, q: int, tol: float) -> str:
    """I1 with the error loop (I2, I3): k=1, subsample 1, subsample_norm 1, validation seeds, whole ``embeddings``."""
    main_round = _round_from("b1", "b2", "select main.*, mat.m from main, mat where main.r < " + str(max_iter - 1))
    norm_round = _round_from("e1", "e2", "select nrm.*, " + _dfl_v("nrm.b1", "main.v") + " as e1, "
                             + _dfl_v("nrm.b2", "main.v") + " as e2, main.v as vr, mat.m from nrm join main "
                             "using (r), mat where nrm.it < " + str(q) + " and not nrm.stop")
    return f"""
with recursive src as ({_CELLS}),
cmean as (select j, avg(v) as m from src group by j),
cc as (select s.row_id, s.j, s.v - cm.m as v from src s join cmean cm using (j)),
gram as (select a.j as i, b.j as j, sum(a.v * b.v) as g from cc a join cc b on a.row_id = b.row_id group by 1, 2),
grows as (select i, list(g order by j) as r from gram group by i),
mat as (select list(r order by i) as m, count(*) as d from grows),
main(r, b1, b2, s1, v) as (
  select -1, list_transform(range(d), lambda x: ((x % 10) + 1)::DOUBLE),
         list_transform(range(d), lambda x: (((x + 1) % 10) + 1)::DOUBLE), null::DOUBLE, null::DOUBLE[] from mat
  union all
  select r + 1, n1, n2, sqrt(greatest(g11 + g22 - lam, 0)),
         list_transform(vv, lambda x: x * (case when vv[list_position(list_transform(vv, lambda y: abs(y)),
                                           list_max(list_transform(vv, lambda y: abs(y))))] < 0 then -1.0 else 1.0 end))
  from (
    select *, list_transform(range(len(n1)), lambda p: (e1 * n1[p + 1] + e2 * n2[p + 1]) / sqrt(e1 * e1 + e2 * e2)
                                                       / sqrt(lam)) as vv from (
      select *, case when g12 <> 0 then g12 when g11 >= g22 then 1.0 else 0.0 end as e1,
             case when g12 <> 0 then lam - g11 when g11 >= g22 then 0.0 else 1.0 end as e2 from (
        select *, (g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2) as lam from (
          select r, n1, n2, list_inner_product(n1, n1) as g11, list_inner_product(n1, n2) as g12,
                 list_inner_product(n2, n2) as g22 from ({main_round})
        )
      )
    )
  )
),
nrm(r, it, b1, b2, s, stop) as (
  select r, 0, list_transform(range(d), lambda x: ((x % 10) + 1)::DOUBLE),
         list_transform(range(d), lambda x: (((x + 1) % 10) + 1)::DOUBLE), 0.0::DOUBLE, false from main, mat where r >= 0
  union all
  select r, it + 1, a1, a2, s_new, s_new = s from (
    select r, it, s, a1, a2,
           floor(sqrt((g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ^ 2 + g12 ^ 2)) * 10000 + 0.5) / 10000 as s_new from (
      select r, it, s, a1, a2, list_inner_product(a1, a1) as g11, list_inner_product(a1, a2) as g12,
             list_inner_product(a2, a2) as g22 from (
        select r, it, s, {_dfl_v("n1", "vr")} as a1, {_dfl_v("n2", "vr")} as a2 from ({norm_round})
      )
    )
  )
),
spec as (select r, arg_max(s, it) as spec from nrm group by r),
err as (select main.r, (spec.spec - main.s1) / main.s1 as e from main join spec using (r)),
last as (select coalesce(min(r) filter (where e <= {tol}), {max_iter - 1}) as rr from err)
select r::INTEGER as round, {_r('e')} as rel_error from err, last where r <= rr"""


def oracle_sql() -> dict[str, str]:
    seedw = SEED_S
    z = (f"select c.row_id, s.jj as j, sum(c.v * ((c.j + s.jj) % 10 + 1)) as z "
         f"from ({_CELLS}) c, range({seedw}) s(jj) group by c.row_id, s.jj")
    sketch_ctes = (f"with cells as ({_CELLS}), cm as (select j, avg(v) as m from cells group by j), "
                   f"zz0 as ({z}), zm as (select j, avg(z) as m from zz0 group by j), "
                   f"yc as (select c.row_id, c.j, c.v - cm.m as v from cells c join cm using (j)), "
                   f"zc as (select zz0.row_id, zz0.j, zz0.z - zm.m as z from zz0 join zm using (j))")
    chunk = f"""{_sched(BLOCK, STRIDE, None)},
lastc as (select max(step) as T, max(drop_hi) filter (where step = (select max(step) from steps)) as ldh from steps),
ch as (
  select c.row_id, c.j, c.v,
    ((case when c.row_id < {BLOCK} then 0 else floor((c.row_id - {BLOCK}) / {STRIDE})::INTEGER + 1 end) * (T + 1)
     + case when c.row_id >= ldh then T else least(floor(c.row_id / {STRIDE})::INTEGER, greatest(T - 1, 0)) end)::BIGINT
      as chunk
  from ({_CELLS}) c, lastc
  where c.row_id < (select max(enter_hi) from steps)
)"""
    expand = ("select s.step, c.row_id from steps s join (select distinct vec_id::BIGINT as row_id from embeddings) c "
              "on c.row_id >= s.drop_hi and c.row_id < s.enter_hi")
    row_sum = f"select vec_id::BIGINT as row_id, {_r('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} as row_sum from embeddings"
    q = {}
    q["rows_from_columns"] = f"""
with o as (select o_totalprice, o_custkey, (row_number() over (order by o_orderkey) - 1)::BIGINT as row_id from orders)
select row_id, 0::INTEGER as j, {_r('o_totalprice::DOUBLE')} as v from o
union all select row_id, 1::INTEGER as j, {_r('o_custkey::DOUBLE')} as v from o"""
    q["dense_csv_roundtrip"] = f"select row_id, j, {_r('v')} as v from ({_CELLS})"
    q["dense_csv_file"] = q["dense_csv_roundtrip"]
    q["skipped_keys"] = "select o_custkey, count(*) as n_rows from orders group by o_custkey having count(*) < 10"
    q["dense_text"] = ("select vec_id::BIGINT as row_id, array_to_string(list_transform(embedding, "
                       "lambda x: printf('%.6f', x::DOUBLE)), ' ') || ' ' as line from embeddings")
    q["lil_text"] = f"""
select e.row_id, '{{' || coalesce(l.body, '') || '}}' as line
from (select distinct vec_id::BIGINT as row_id from embeddings) e left join (
  select row_id, string_agg(j::VARCHAR || ':' || printf('%.6f', v), ',' order by j) as body
  from ({_QCELLS}) where v <> 0 group by row_id) l using (row_id)"""
    q["coo_cells"] = f"select row_id as i, j, {_r('v')} as v from ({_QCELLS}) where v <> 0"
    q["row_id_by_time"] = "select event_id, (row_number() over (order by ts) - 1)::BIGINT as row_id from events"
    q["first_rows_by_time"] = ("select * from (select event_id, (row_number() over (order by ts) - 1)::BIGINT as row_id "
                               "from events) where row_id < 2500")
    q["first_block"] = f"select * from ({row_sum}) where row_id < {BLOCK}"
    q["rows_at"] = f"{_sched(BLOCK, STRIDE, None)} select * from ({row_sum}) where row_id >= (select enter_lo from steps where step = 3) and row_id < (select enter_hi from steps where step = 3)"
    q["window_schedule"] = f"{_sched(BLOCK, STRIDE, None)} select * from steps"
    q["window_schedule_short"] = f"{_sched(97, 41, None)} select * from steps"
    q["slide_window"] = f"{_sched(BLOCK, STRIDE, None)} select * from ({row_sum}) where row_id >= (select drop_hi from steps where step = 3) and row_id < (select enter_hi from steps where step = 3)"
    q["expand_windows"] = f"{_sched(BLOCK, STRIDE, None)} {expand}"
    q["expand_windows_short"] = f"{_sched(97, 41, None)} {expand}"
    q["row_count"] = "select count(*) as n from lineitem"
    li = " union all ".join(
        f"select {j}::INTEGER as j, {_r(f'(round(avg({c}) * count(*), 2) / count(*))')} as mean, {_r(f'greatest(max({c}), 0)')} as max from lineitem"
        for j, c in enumerate(_LI_COLS))
    q["lineitem_column_stats"] = li
    q["column_sum"] = f"select j, {_r('sum(v)')} as v from ({_CELLS}) group by j"
    q["column_mean"] = f"select j, {_r('avg(v)')} as v from ({_CELLS}) group by j"
    q["column_abs_sum"] = f"select j, {_r('sum(abs(v))')} as v from ({_CELLS}) group by j"
    q["column_max"] = f"select j, {_r('greatest(max(v), 0)')} as v from ({_CELLS}) group by j"
    q["row_max"] = f"select vec_id::BIGINT as row_id, {_r('greatest(list_max(embedding)::DOUBLE, 0)')} as v from embeddings"
    q["matrix_sum"] = f"""
select label, (p // 8)::INTEGER as i, (p % 8)::INTEGER as j, {_r('sum(v)')} as v
from (select label, unnest(range(len(embedding))) as p, unnest(embedding)::DOUBLE as v from embeddings)
group by 1, 2, 3"""
    q["sketch_sum"] = f"{sketch_ctes} select j::INTEGER as j, {_r('sum(z)')} as v from zz0 group by j"
    q["cross_moment"] = (f"{sketch_ctes} select yc.j::INTEGER as i, zc.j::INTEGER as j, {_r('sum(yc.v * zc.z)')} as v "
                         f"from yc join zc using (row_id) group by 1, 2")
    q["sketch_gram"] = (f"{sketch_ctes} select a.j::INTEGER as i, b.j::INTEGER as j, {_r('sum(a.z * b.z)')} as v "
                        f"from zc a join zc b using (row_id) group by 1, 2")
    q["chunk_moments"] = f"""{chunk}
select chunk, -1::INTEGER as i, -1::INTEGER as j, {_r('count(distinct row_id)::DOUBLE')} as v from ch group by chunk
union all select chunk, -1::INTEGER, j, {_r('sum(v)')} from ch group by chunk, j
union all select a.chunk, a.j, b.j, {_r('sum(a.v * b.v)')} from ch a join ch b
  on a.row_id = b.row_id and a.j <= b.j group by a.chunk, a.j, b.j"""
    gram_sql = (f"with src as ({_CELLS}), cmean as (select j, avg(v) as m from src group by j), "
                f"cc as (select s.row_id, s.j, s.v - cm.m as v from src s join cmean cm using (j)) ")
    q["total_variance"] = f"{gram_sql} select {_r('sum(v * v)')} as total_variance from cc"
    q["centred_gram"] = (f"{gram_sql} select a.j as i, b.j as j, {_r('sum(a.v * b.v)')} as v from cc a join cc b "
                         f"on a.row_id = b.row_id and a.j <= b.j group by 1, 2")
    q["project_seed"] = (f"select row_id, s.c::INTEGER as j, {_r('sum(v * ((j + s.c) % 10 + 1))')} as v "
                         f"from ({_CELLS}), range({seedw}) s(c) group by row_id, s.c")
    q["project_t"] = q["project_seed"]
    q["project_sparse"] = (f"select row_id, s.c::INTEGER as c, {_r('sum(v * ((j + s.c) % 10 + 1))')} as v "
                           f"from ({_QCELLS}), range({seedw}) s(c) where v <> 0 group by row_id, s.c")
    q["project_sparse_nz"] = (f"select * from (select row_id, s.c::INTEGER as c, "
                              f"{_r('sum(v * ((j + s.c) % 10 + 1 - 5.5))')} as v "
                              f"from ({_QCELLS}), range({seedw}) s(c) where v <> 0 group by row_id, s.c) where v <> 0")
    q["center"] = f"select row_id, j, {_r('v - avg(v) over (partition by j)')} as v from ({_CELLS})"
    q["center_sparse"] = (f"select row_id, j, {_r('v - m')} as v from (select row_id, j, v, avg(v) over (partition by j) as m "
                          f"from ({_QCELLS})) where v <> 0")
    recon = "case when j < 6 then avg(v) over (partition by row_id, j // 2) else 0 end"
    q["subtract"] = f"select row_id, j, {_r('v - ' + recon)} as v from ({_CELLS})"
    q["subtract2"] = (f"select row_id, j, {_r('v - avg(v) over (partition by j) - ' + recon)} as v from ({_CELLS})")
    q["dot_vector"] = f"select row_id, {_r('sum(v * ((j % 10) + 1))')} as v from ({_CELLS}) group by row_id"
    q["dot_rows"] = (f"select row_id, {_r('sum(v * (v - m))')} as v from (select row_id, j, v, avg(v) over (partition by j) as m "
                     f"from ({_CELLS})) group by row_id")
    q["deflate_fixed_v"] = f"select row_id, j, {_r('v')} as v from ({_PAIRS_DEFLATED})"
    q["score_fixed_v"] = (f"select row_id, (j // 2)::INTEGER as comp, {_r('sum(v) / sqrt(2)')} as v from ({_CELLS}) "
                          f"where j < 6 group by row_id, j // 2")
    q["stream_score"] = q["score_fixed_v"]
    q["cells_roundtrip"] = f"select row_id, j, {_r('v')} as v from ({_QCELLS})"
    q["sample_rows"] = "select vec_id::BIGINT as row_id from embeddings where ((vec_id * 7919) % 1000) / 1000.0 > 0.3"
    hashed = "select i, j, (i * 1000003 + j * 7919 + 7 * 104729 + 12345) % 2147483647 as x " \
             f"from range((select max(len(embedding)) from embeddings)) a(i), range({2 * seedw}) b(j)"
    for _ in range(3):
        hashed = f"select i, j, (x * x + x * 48271 + 11) % 2147483647 as x from ({hashed})"
    on_seed = "with h as ({h}), w as ({w}) select row_id, c::INTEGER as j, {v} as v from ({cells}) s join w on w.i = s.j group by row_id, c"
    q["project_uniform"] = on_seed.format(
        h=hashed, w=f"select i, j as c, x / 2147483647.0::DOUBLE as m from h where j < {seedw}", v=_r("sum(v * m)"), cells=_CELLS)
    q["project_gaussian"] = on_seed.format(
        h=hashed, v=_r("sum(v * m)"), cells=_CELLS,
        w="select a.i, a.j // 2 as c, sqrt(-2 * ln((a.x + 1) / 2147483648.0::DOUBLE)) * cos(2 * pi() * (b.x / 2147483647.0::DOUBLE)) as m "
          "from h a join h b on a.i = b.i and b.j = a.j + 1 where a.j % 2 = 0")
    sparse_ctes = sketch_ctes.replace(_CELLS, _QCELLS)
    stored = f"(select distinct j from ({_QCELLS}) where v <> 0)"
    q["sparse_sketch"] = (f"{sparse_ctes} select 'yz' as part, yc.j::INTEGER as i, zc.j::INTEGER as j, {_r('sum(yc.v * zc.z)')} as v "
                          f"from yc join zc using (row_id) where yc.j in {stored} group by 2, 3 union all "
                          f"select 'zz', a.j::INTEGER, b.j::INTEGER, {_r('sum(a.z * b.z)')} "
                          f"from zc a join zc b using (row_id) group by 2, 3")
    sk = "with recursive src as ({src}), " + _SKETCH2.format(iters=10)
    sv_out = (" select 0::INTEGER as comp, {a} as sigma from st where it = 10 "
              "union all select 1::INTEGER, {b} from st where it = 10").format(a=_r("s0"), b=_r("s1"))
    q["sketch_svd"] = sk.format(src=_CELLS) + sv_out
    q["sketch_svd_rows"] = q["sketch_svd"]
    li_cells = ("select row_id, unnest(range(4))::INTEGER as j, unnest(y) as v from (select row_number() over () "
                "as row_id, [l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[] as y from lineitem)")
    q["lineitem_sketch_svd_k1"] = (("with recursive src as ({src}), " + _SKETCH2.format(iters=4)).format(src=li_cells)
                                   + " select 0::INTEGER as comp, round(s0, 2) + 0.0 as sigma from st where it = 4"
                                   " union all select 1::INTEGER, round(s1, 2) + 0.0 from st where it = 4")
    first = f"select * from ({_PAIRS_DEFLATED}) where row_id < {BLOCK}"
    q["window_spectral_error"] = sk.format(src=first) + f" select {_r('s0')} as spectral_error from st where it = 10"
    rn = _RESNORM.format(d_n1=_dfl("n1"), d_n2=_dfl("n2"), d_b1=_dfl("b1"), d_b2=_dfl("b2"), q=10)
    q["residual_norm"] = (f"with recursive src as ({_CELLS}), {rn} "
                          f"select s as residual_norm from st order by it desc limit 1")
    q["residual_norm_rows"] = q["residual_norm"]
    q["sliding_pca_k1"] = _sliding_k1_sql(BLOCK, STRIDE, 1_000_000_000)
    q["sketch_svd_error_k1"] = _sketch_error_k1_sql(5, 10, 0.05)
    q["events_sliding_k1"] = _sliding_k1_sql(
        1000, 500, None, digits=4,
        tab="select (row_number() over (order by ts) - 1)::BIGINT as rid, "
            "[value, hour(ts), minute(ts), dayofweek(ts) + 1]::DOUBLE[] as y from events")
    q["sliding_stats_k1"] = _sliding_k1_stats_sql(BLOCK, STRIDE, 1_000_000_000)
    q["sliding_by_label_k1"] = _sliding_k1_by_label_sql(30, 5, 1_000_000_000)
    q["change_points_k1"] = _sliding_k1_tail(
        "select st.t::INTEGER as step, steps.enter_lo::BIGINT as row_id from st join st p on p.t = st.t - 1 "
        "join steps on steps.step = st.t where st.s > p.s")
    q["sliding_model_k1"] = _sliding_k1_tail(
        f"select t::INTEGER as step, 0::INTEGER as comp, {_r('s')} as sigma, (i - 1)::INTEGER as i, {_r('x')} as x "
        f"from (select t, s, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from st)")
    stats_k1 = _sliding_k1_stats_sql(BLOCK, STRIDE, 1_000_000_000, rnd=lambda x: x)   # average the unrounded values
    q["run_summary_k1"] = (f"select {_r('avg(spectral_error)')} as mean_spectral_error from ("
                           + stats_k1.replace("with recursive", "select * from (with recursive", 1) + "))")
    q["stream_pca_k1"] = q["sliding_pca_k1"]
    one = "select 0 as label, rid, y from (" + _EMB_TAB + ")"
    by_label = ("select label, (row_number() over (partition by label order by vec_id) - 1)::BIGINT as rid, "
                "list_transform(embedding, lambda x: x::DOUBLE) as y from embeddings")
    q["sliding_pca_k2"] = sliding_oracle.scores(BLOCK, STRIDE, one)
    for same in ("sliding_pca_k2_rows", "sliding_pca_k2_window", "sliding_pca_k2_bands", "stream_pca_k2"):
        q[same] = q["sliding_pca_k2"]
    q["sketch_svd_cells"] = ("with recursive src as (" + _QCELLS + "), " + _SKETCH2.format(iters=3)
                             + sv_out.replace("it = 10", "it = 3"))
    few = _RESNORM.format(d_n1=_dfl("n1"), d_n2=_dfl("n2"), d_b1=_dfl("b1"), d_b2=_dfl("b2"), q=3)
    q["residual_norm_cells"] = f"with recursive src as ({_QCELLS}), {few} select s as residual_norm from st order by it desc limit 1"
    q["sliding_model_k2"] = sliding_oracle.model(BLOCK, STRIDE, one)
    q["sliding_stats_k2"] = sliding_oracle.stats(BLOCK, STRIDE, one)
    q["change_points_k2"] = sliding_oracle.changes(BLOCK, STRIDE, one)
    q["run_summary_k2"] = sliding_oracle.mean_error(BLOCK, STRIDE, one)
    q["sliding_by_label_k2"] = sliding_oracle.scores(30, 5, by_label, label=True)
    q["window_spectral_errors"] = sliding_oracle.window_errors(BLOCK, STRIDE, one, _dfl("y"))
    for sink, run in (("scores_sink", "sliding_pca_k1"), ("model_sink", "sliding_model_k1"), ("stats_sink", "sliding_stats_k1")):
        q[sink] = f"select *, {BLOCK} as block, {STRIDE} as stride from ({q[run]})"
    q["explained_variance"] = f"""{gram_sql},
tot as (select sum(v * v) as total from cc),
ex as (select sum(p * p) as explained from (select row_id, sum(v) / sqrt(2) as p from cc where j < 6 group by row_id, j // 2))
select {_r('explained')} as explained, {_r('total - explained')} as residual, {_r('total')} as total from tot, ex"""
    return q | _llm_oracles()
