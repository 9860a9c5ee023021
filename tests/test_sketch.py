import numpy as np
import pytest

from matstream.functions import linalg as la
from matstream.functions.seeds import seed_validation
from matstream.plans.sketch import (residual_norm_from_gram, sketch_from_gram, sketch_svd, window_gram)
from matstream.plans.report import explained_variance


def test_gram_path_equals_rows_path(emb_rows):
    a = sketch_svd(emb_rows, k=3, subsample=4, max_iter=3, seed="validation", method="gram")
    b = sketch_svd(emb_rows, k=3, subsample=4, max_iter=3, seed="validation", method="rows")
    assert np.allclose(a.S, b.S, atol=1e-9)
    assert np.allclose(a.V @ a.V.T, b.V @ b.V.T, atol=1e-9)


def test_orthonormal_and_descending(emb_rows):
    r = sketch_svd(emb_rows, k=4, subsample=3, max_iter=2, seed=5)
    assert np.allclose(r.V.T @ r.V, np.eye(4), atol=1e-10)
    assert all(r.S[i] >= r.S[i + 1] for i in range(len(r.S) - 1))
    r2 = sketch_svd(emb_rows, k=4, subsample=3, max_iter=2, seed=5)
    assert np.array_equal(r.S, r2.S)   # same seed, same result


def test_converges_to_exact_on_steep_spectrum():
    rng = np.random.default_rng(0)
    U, _ = np.linalg.qr(rng.standard_normal((300, 8)))
    W, _ = np.linalg.qr(rng.standard_normal((8, 8)))
    X = U @ np.diag([100, 50, 20, 5, 1, 0.5, 0.2, 0.1]) @ W.T
    Xc = X - X.mean(0)
    C = Xc.T @ Xc
    exact = np.linalg.svd(Xc, compute_uv=False)
    r = sketch_from_gram(C, 300, 2, 2, max_iter=30, seed=1)
    assert np.allclose(r.S[:2], exact[:2], rtol=1e-8)
    # residual norm at the exact V is about sigma_{k+1}
    _, _, Vt = np.linalg.svd(Xc, full_matrices=False)
    rn = residual_norm_from_gram(C, Vt[:2].T, subsample_norm=2, q=50, seed=3)
    assert abs(rn - exact[2]) < 1e-3


def test_error_loop_stops_at_tolerance():
    rng = np.random.default_rng(1)
    X = rng.standard_normal((200, 10)) @ np.diag(np.linspace(10, 1, 10))
    Xc = X - X.mean(0)
    r = sketch_from_gram(Xc.T @ Xc, 200, 2, 3, max_iter=20, tolerance=0.05, calc_error=True, q=20, seed=2)
    assert r.n_iter == len(r.errors) >= 1
    assert r.errors[-1] <= 0.05 or r.n_iter == 20


def test_rank_deficient_window_pads_with_zeros():
    rng = np.random.default_rng(2)
    X = rng.standard_normal((4, 20))   # centred rank 3 < sketch width 6
    Xc = X - X.mean(0)
    r = sketch_from_gram(Xc.T @ Xc, 4, 2, 4, max_iter=2, seed=0)
    assert np.isfinite(r.S).all() and r.S[-1] == 0.0


def test_java_rounding():
    assert la.java_round4(0.00005) == 0.0001
    assert la.java_round4(2.12344999) == 2.1234


def test_explained_plus_residual_is_total(emb_rows, emb_matrix):
    V, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((64, 3)))
    row = explained_variance(emb_rows, V).first()
    Xc = emb_matrix - emb_matrix.mean(0)
    assert abs(row.total - (Xc ** 2).sum()) < 1e-9
    assert abs(row.explained - ((Xc @ V) ** 2).sum()) < 1e-9
    assert abs(row.explained + row.residual - row.total) < 1e-9


def test_window_gram(emb_rows, emb_matrix):
    n, mean, C = window_gram(emb_rows)
    Xc = emb_matrix - emb_matrix.mean(0)
    assert n == 500 and np.allclose(C, Xc.T @ Xc) and np.allclose(mean, emb_matrix.mean(0))


def test_narrow_gram_in_jvm_equals_numpy(spark):
    from matstream.sources.frames import from_columns

    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    rows = from_columns(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    n, mean, C = window_gram(rows)
    X = li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax").toPandas().to_numpy(float)
    Xc = X - X.mean(0)
    assert n == X.shape[0]
    assert np.allclose(C, Xc.T @ Xc, rtol=1e-10)


def test_random_seeds_have_their_distributions(spark):
    from matstream.functions.seeds import seed_cells, seed_gaussian, seed_uniform

    g = seed_cells(spark, 400, 50, "gaussian", seed=3).toPandas()
    u = seed_cells(spark, 400, 50, "uniform", seed=3).toPandas()
    assert len(g) == 20000 and set(g.j) == set(range(50)) and set(g.i) == set(range(400))
    assert abs(g.v.mean()) < 0.05 and abs(g.v.std() - 1) < 0.05
    assert 0 <= u.v.min() and u.v.max() < 1 and abs(u.v.mean() - 0.5) < 0.02
    for got, want in ((g, seed_gaussian(400, 50, 3)), (u, seed_uniform(400, 50, 3))):  # the same in every form
        assert np.allclose(got.sort_values(["i", "j"]).v.to_numpy(), want.reshape(-1), rtol=1e-12, atol=1e-12)
    a, b = seed_gaussian(64, 7, [1, 2]), seed_gaussian(64, 7, [1, 2])
    assert np.array_equal(a, b) and not np.array_equal(a, seed_gaussian(64, 7, [1, 3]))
    assert seed_uniform(64, 7, 5).min() >= 0


def test_steep_spectrum_keeps_its_second_direction():
    # singular values 1e7 and 1e3: the seed fed back unnormalised would square the conditioning every round
    rng = np.random.default_rng(6)
    U, _ = np.linalg.qr(rng.standard_normal((2000, 4)))
    W, _ = np.linalg.qr(rng.standard_normal((4, 4)))
    X = U @ np.diag([1e7, 1e3, 7.0, 5.0]) @ W.T + 5e4
    Xc = X - X.mean(0)
    exact = np.linalg.svd(Xc, compute_uv=False)
    r = sketch_from_gram(Xc.T @ Xc, 2000, 1, 1, max_iter=8, seed="validation")
    assert np.allclose(r.S[:2], exact[:2], rtol=1e-6)


def test_error_loop_rows_path_equals_gram_path(emb_rows):
    a = sketch_svd(emb_rows, k=2, subsample=2, max_iter=3, calc_error=True, q=6, subsample_norm=2,
                   tolerance=0.01, seed="validation", method="gram")
    b = sketch_svd(emb_rows, k=2, subsample=2, max_iter=3, calc_error=True, q=6, subsample_norm=2,
                   tolerance=0.01, seed="validation", method="rows")
    assert a.n_iter == b.n_iter == len(a.errors) == len(b.errors)
    assert np.allclose(a.errors, b.errors, atol=1e-9)
    assert np.allclose(a.S, b.S, atol=1e-9)
