import numpy as np
import pytest
from pyspark.sql import functions as F

from bruteforce import sliding_rows
from matstream.operators.rowid import with_row_id
from matstream.plans.sliding import replace_component, sliding_pca, sliding_pca_by_key


@pytest.mark.parametrize("k,block,stride,sub,it,seed,cap", [(3, 100, 50, 4, 2, "validation", 20),
                                                           (3, 97, 41, 2, 3, 7, None),
                                                           (2, 60, 20, 2, 1, 11, 5)])
def test_moments_path_equals_row_by_row(emb_rows, emb_matrix, k, block, stride, sub, it, seed, cap):
    res = sliding_pca(emb_rows, k=k, block=block, stride=stride, subsample=sub, max_iter=it, seed=seed,
                      max_slides=cap)
    sc, specs, models, changes = sliding_rows(emb_matrix, k, block, stride, sub, it, max_slides=cap, seed=seed)
    got = res.scores.orderBy("row_id").toPandas()
    assert list(got.row_id) == list(range(res.schedule.end))     # every scheduled row scored once
    assert np.abs(np.array(list(got.scores)) - sc).max() < 1e-10
    st = res.stats.orderBy("step").toPandas()
    assert np.abs(st.spectral_error.to_numpy() - np.array(specs)).max() < 1e-10
    assert [c for cs in st.change_at for c in cs] == changes
    for (S1, V1), (S2, V2) in zip(res.models, models):
        assert np.abs(V1 @ V1.T - V2 @ V2.T).max() < 1e-10
        assert np.allclose(V1.T @ V1, np.eye(k), atol=1e-10)   # V stays orthonormal
    mins = [Sm.min() for Sm, _ in res.models]
    assert all(b >= a for a, b in zip(mins, mins[1:]))          # the weakest kept value never falls
    assert (st.n_rows == block).all()                           # window size stays block


def test_partitioning_does_not_change_results(emb_rows):
    a = sliding_pca(emb_rows, k=3, block=100, stride=50, subsample=4, max_iter=2)
    b = sliding_pca(emb_rows.repartition(11), k=3, block=100, stride=50, subsample=4, max_iter=2)
    for (S1, V1), (S2, V2) in zip(a.models, b.models):
        assert np.abs(S1 - S2).max() < 1e-9


def test_replace_component_rules():
    S = np.array([3.0, 1.0, 1.0])
    V = np.eye(3)
    Sn = np.array([2.0, 2.0, 0.5, 9.0])
    Vn = np.arange(12.0).reshape(3, 4)
    S2, V2, sw = replace_component(S, V, Sn, Vn, 3)
    assert sw and list(S2) == [3.0, 2.0, 1.0] and list(V2[:, 1]) == list(Vn[:, 0])
    _, _, sw = replace_component(S, V, np.array([1.0, 0.5, 0.2]), Vn, 3)
    assert not sw   # strictly greater only


def test_by_key_equals_each_slice(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    r = emb.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
                   "label")
    out = sliding_pca_by_key(r, ["label"], k=2, block=30, stride=5, subsample=2, max_iter=2).toPandas()
    for lab in (0, 5):
        sl = emb.where(F.col("label") == lab).select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
        res = sliding_pca(with_row_id(sl, "vec_id"), k=2, block=30, stride=5, subsample=2, max_iter=2)
        a = res.scores.orderBy("row_id").toPandas()
        b = out[out.label == lab].sort_values("row_id")
        assert np.abs(np.array(list(a.scores)) - np.array(list(b.scores))).max() < 1e-10


def test_banded_driver_state_gives_same_result(emb_rows, monkeypatch):
    import matstream.plans.sliding as sl

    a = sliding_pca(emb_rows, k=3, block=97, stride=41, subsample=2, max_iter=2, max_slides=None)
    monkeypatch.setattr(sl, "DRIVER_STATE_BYTES", 2 * 64 * 64 * 8 * 2)   # two entry steps per band
    b = sliding_pca(emb_rows, k=3, block=97, stride=41, subsample=2, max_iter=2, max_slides=None)
    for (S1, V1), (S2, V2) in zip(a.models, b.models):
        assert np.abs(S1 - S2).max() < 1e-12 and np.abs(V1 - V2).max() < 1e-12


def test_rows_path_equals_moments_path(emb_rows):
    a = sliding_pca(emb_rows, k=3, block=97, stride=41, subsample=2, max_iter=2, max_slides=4, method="moments")
    b = sliding_pca(emb_rows, k=3, block=97, stride=41, subsample=2, max_iter=2, max_slides=4, method="rows")
    for (S1, V1), (S2, V2) in zip(a.models, b.models):
        assert np.abs(S1 - S2).max() < 1e-9
        assert np.abs(V1 @ V1.T - V2 @ V2.T).max() < 1e-9
    sa = a.stats.orderBy("step").toPandas()
    sb = b.stats.orderBy("step").toPandas()
    assert np.abs(sa.spectral_error.to_numpy() - sb.spectral_error.to_numpy()).max() < 1e-9
    assert list(sa.change_at.map(list)) == list(sb.change_at.map(list))
    A = np.array(list(a.scores.orderBy("row_id").toPandas().scores))
    B = np.array(list(b.scores.orderBy("row_id").toPandas().scores))
    assert np.abs(A - B).max() < 1e-9


def test_events_in_time_order_equals_row_by_row(spark):
    import __spark_entry__ as E

    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        "ts", "value", "user_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"),
        F.dayofweek("ts").alias("dow")).orderBy("ts").toPandas()
    X = ev[["value", "user_id", "hour", "minute", "dow"]].to_numpy(float)
    got = E.queries()["events_sliding_pca"](spark, "/root/testdata/sf0.01").orderBy("row_id").toPandas()
    sc, _, _, _ = sliding_rows(X, 1, 1000, 500, 1, 3, max_slides=None, seed=3)
    A = np.array(list(got.scores))
    assert A.shape == sc.shape
    assert np.abs(A - sc).max() < 1e-8 * max(1.0, np.abs(sc).max())


def test_capped_run_on_unnumbered_rows_reads_a_prefix(spark):
    from matstream.sources.frames import from_columns

    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        "ts", F.array("value", "user_id", F.hour("ts"), F.minute("ts"), F.dayofweek("ts"))
        .cast("array<double>").alias("features"))
    a = sliding_pca(ev, k=1, block=500, stride=100, subsample=1, max_iter=2, order_by="ts", max_slides=10, seed=1)
    full = with_row_id(ev, "ts")
    b = sliding_pca(full, k=1, block=500, stride=100, subsample=1, max_iter=2, max_slides=10, seed=1)
    A = np.array(list(a.scores.orderBy("row_id").toPandas().scores))
    B = np.array(list(b.scores.orderBy("row_id").toPandas().scores))
    assert A.shape == B.shape == (1500, 1)
    assert np.abs(A - B).max() < 1e-9 * max(1.0, np.abs(B).max())


def test_degenerate_columns_and_duplicate_rows(spark):
    rng = np.random.default_rng(5)
    X = rng.standard_normal((300, 8))
    X[:, 3] = 7.0                      # a constant column
    X[100:150] = X[100]                # a run of identical rows
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(X)],
                               "row_id long, features array<double>")
    res = sliding_pca(df, k=2, block=60, stride=20, subsample=2, max_iter=2, seed=4)
    sc, specs, _, changes = sliding_rows(X, 2, 60, 20, 2, 2, seed=4)
    A = np.array(list(res.scores.orderBy("row_id").toPandas().scores))
    assert np.isfinite(A).all()
    assert np.abs(A - sc).max() < 1e-8
    st = res.stats.orderBy("step").toPandas()
    assert np.abs(st.spectral_error.to_numpy() - np.array(specs)).max() < 1e-8


def test_bad_rows_fail_the_job(spark):
    from matstream.operators import moments as mo

    ragged = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [1.0, 2.0, 3.0])],
                                   "row_id long, chunk int, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="different widths"):
        mo.chunk_moments(ragged).collect()
    nan = spark.createDataFrame([(0, 0, [1.0, float("nan")])], "row_id long, chunk int, features array<double>")
    with pytest.raises(Exception, match="NaN"):
        mo.chunk_moments(nan).collect()


def test_kernel_flushes_partial_sums(spark, emb_rows, emb_matrix, monkeypatch):
    from matstream.operators import moments as mo
    from matstream.operators.windows import window_schedule, with_chunk

    monkeypatch.setattr(mo, "KERNEL_STATE_BYTES", 64 * 64 * 8 * 2)   # flush after two chunks
    s = window_schedule(500, 97, 41, None)
    shuffled = with_chunk(emb_rows, s).orderBy(F.rand(3)).coalesce(1)
    got = mo.collect_moments(mo.chunk_moments(shuffled), 64)
    for c, lo, hi, _, _ in s.chunk_bounds():
        assert np.allclose(got[c][2], emb_matrix[lo:hi].T @ emb_matrix[lo:hi])


def test_by_key_with_a_hot_key(spark):
    rng = np.random.default_rng(8)
    n = 900
    keys = np.where(np.arange(n) % 3 == 0, 0, 1 + np.arange(n) % 4)   # key 0 holds a third of the rows
    X = rng.standard_normal((n, 6)) + keys[:, None]
    df = spark.createDataFrame([(int(i), int(k), [float(v) for v in X[i]]) for i, k in enumerate(keys)],
                               "ord long, key int, features array<double>").repartition(7)
    out = sliding_pca_by_key(df, ["key"], k=1, block=40, stride=10, subsample=2, max_iter=2,
                             order_by="ord").toPandas()
    for key in (0, 2):
        Xk = X[keys == key]
        sc, _, _, _ = sliding_rows(Xk, 1, 40, 10, 2, 2, max_slides=None)
        got = out[out.key == key].sort_values("row_id")
        assert np.abs(np.array(list(got.scores)) - sc).max() < 1e-9


def test_key_prefixes_trim_hot_keys_exactly(spark):
    from matstream.plans.sliding import _key_prefixes

    rows = [(0, int(o), [float(o)]) for o in range(5000)] + [(1, int(o), [float(o)]) for o in range(100)]
    df = spark.createDataFrame(rows, "key int, _ord long, features array<double>").repartition(5)
    kept, per_key = _key_prefixes(df, ["key"], 240)
    got = kept.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("_ord").alias("mx")).toPandas() \
        .set_index("key")
    assert 240 <= got.loc[0, "c"] < 1000      # the hot key is trimmed to a prefix ...
    assert got.loc[0, "mx"] == got.loc[0, "c"] - 1   # ... that is exactly its first rows in order
    assert got.loc[1, "c"] == 100             # a small key keeps all its rows
    assert dict(per_key.toPandas().values.tolist()) == {0: 5000, 1: 100}   # true counts for the schedule


def test_ids_that_are_not_dense_are_rejected(spark, emb_rows):
    gappy = emb_rows.withColumn("row_id", F.col("row_id") * 2)
    with pytest.raises(ValueError, match="not dense"):
        sliding_pca(gappy, k=2, block=60, stride=20, subsample=2)


def test_sliding_error_loop_same_on_both_paths(emb_rows):
    kw = dict(k=2, block=97, stride=41, subsample=2, max_iter=2, max_slides=2, calc_error=True, q=5,
              tolerance=0.01, subsample_norm=1)
    a = sliding_pca(emb_rows, method="moments", **kw).stats.orderBy("step").toPandas()
    b = sliding_pca(emb_rows, method="rows", **kw).stats.orderBy("step").toPandas()
    assert list(a.n_iter) == list(b.n_iter)
    for ea, eb in zip(a.errors, b.errors):
        assert np.allclose(list(ea), list(eb), atol=1e-9)


def test_reports_match_the_stats(emb_rows):
    from matstream.plans.report import avg_sketch_time, run_summary

    res = sliding_pca(emb_rows, k=2, block=100, stride=50, subsample=2, max_iter=3)
    st = res.stats.orderBy("step").toPandas()
    avg = avg_sketch_time(res.stats).orderBy("step").toPandas()
    assert np.allclose(avg.avg_sketch_s, [np.mean(list(x)) for x in st.sketch_s])
    summ = run_summary(res.stats).first()
    assert abs(summ.mean_spectral_error - st.spectral_error.mean()) < 1e-12
    assert abs(summ.mean_run_s - st.total_s.mean()) < 1e-12
    assert (st.block_num == st.step + 1).all() and all(len(list(x)) == 3 for x in st.sketch_s)


def test_keys_without_a_run_are_named(spark):
    from matstream.plans.sliding import skipped_keys

    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)] * 4 + [(None, 1)] * 9, "k string, x int")
    assert sorted(map(tuple, skipped_keys(df, ["k"], 5).collect()), key=str) == [("b", 4), (None, 9)]
    assert skipped_keys(df.where("k = 'a'"), ["k"], 5).isEmpty()
