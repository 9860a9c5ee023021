import numpy as np
from pyspark.sql import functions as F

from matstream.functions.seeds import seed_validation
from matstream.operators import moments as mo
from matstream.operators.windows import window_schedule, with_chunk


def test_column_stats(emb_rows, emb_matrix):
    X = emb_matrix
    s = {r.j: r.v for r in mo.column_sum(emb_rows).collect()}
    assert np.allclose([s[j] for j in range(X.shape[1])], X.sum(0))
    m = {r.j: r.v for r in mo.column_mean(emb_rows).collect()}
    assert np.allclose([m[j] for j in range(X.shape[1])], X.mean(0))
    a = {r.j: r.v for r in mo.column_abs_sum(emb_rows).collect()}
    assert np.allclose([a[j] for j in range(X.shape[1])], np.abs(X).sum(0))
    mx = {r.j: r.v for r in mo.column_max(emb_rows).collect()}
    assert np.allclose([mx[j] for j in range(X.shape[1])], np.maximum(X.max(0), 0))


def test_chunk_moments_match_numpy(emb_rows, emb_matrix):
    X = emb_matrix
    s = window_schedule(X.shape[0], 97, 41, None)
    cells = mo.chunk_moments(with_chunk(emb_rows, s))
    got = mo.collect_moments(cells, X.shape[1])
    for c, lo, hi, _, _ in s.chunk_bounds():
        n, s1, G = got[c]
        Y = X[lo:hi]
        assert n == hi - lo
        assert np.allclose(s1, Y.sum(0))
        assert np.allclose(G, Y.T @ Y)


def test_chunk_moments_with_shift_are_centred(emb_rows, emb_matrix):
    X = emb_matrix
    one = emb_rows.select(F.lit(0).alias("chunk"), "features")
    mean = X.mean(0)
    n, s1, G = mo.collect_moments(mo.chunk_moments(one, shift={0: mean}), X.shape[1])[0]
    assert np.allclose(s1, 0, atol=1e-10)
    Xc = X - mean
    assert np.allclose(G, Xc.T @ Xc)


def test_partitioning_does_not_change_moments(emb_rows, emb_matrix):
    one = emb_rows.select(F.lit(0).alias("chunk"), "features")
    a = mo.collect_moments(mo.chunk_moments(one.repartition(1)), 64)[0]
    b = mo.collect_moments(mo.chunk_moments(one.repartition(13)), 64)[0]
    assert np.abs(a[2] - b[2]).max() < 1e-9


def test_sketch_pass(emb_rows, emb_matrix):
    X = emb_matrix
    om = seed_validation(X.shape[1], 5)
    ym = X.mean(0)
    n, sz, yz, zz = mo.sketch_moments(emb_rows, om, ym)
    Z = X @ om
    Zc = Z - Z.mean(0)
    assert n == X.shape[0]
    assert np.allclose(sz, Z.sum(0))
    assert np.allclose(yz, (X - ym).T @ Zc)
    assert np.allclose(zz, Zc.T @ Zc)
