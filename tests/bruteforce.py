"""Row-by-row numpy restatement of the sliding sketch PCA, used as a test oracle.

It keeps the window as a dense matrix of rows and follows the run literally:
deflate the rows, centre with the window mean, sketch, swap, score raw rows.
Only small fixtures go through it. The round works on the centred rows themselves
(orthonormal basis of the sketch, then an SVD), not on moments; nothing but the
random seeds comes from the engine.
"""

from __future__ import annotations

import numpy as np

from matstream.functions.seeds import make_seed


def sketch_rows(Y, k, subsample, max_iter=1, seed="validation", salt=0):
    d = Y.shape[1]
    s = k + subsample
    Yc = Y - Y.mean(axis=0)
    if seed == "validation":
        B = np.array([[(i + j) % 10 + 1 for j in range(s)] for i in range(d)], dtype=float)
    else:
        B = make_seed(seed, d, s, salt * 2)
    S = V = None
    for _ in range(max_iter):
        U, size, _ = np.linalg.svd(Yc @ B, full_matrices=False)
        Q = U[:, size > 1e-9 * size[0]]
        A = Q.T @ Yc
        _, some, Vt = np.linalg.svd(A, full_matrices=False)
        S = np.zeros(s)
        S[:len(some)] = some
        V = np.zeros((d, k))
        for c, v in enumerate(Vt[:k]):
            V[:, c] = v if v[np.argmax(np.abs(v))] > 0 else -v
        B = A.T
    return S, V


def sliding_rows(X, k, block, stride, subsample, max_iter=1, max_slides=20, seed="validation"):
    n, d = X.shape
    win = X[:block].copy()
    S0, V0 = sketch_rows(win, k, subsample, max_iter, seed, salt=0)
    S, V = S0[:k].copy(), V0.copy()
    scores = [X[:block] @ V]
    specs = [spectral(win, V, seed, 1)]
    models = [(S.copy(), V.copy())]
    changes = []
    i, t = block, 0
    while i < n:
        t += 1
        st = min(stride, n - i)
        win = np.vstack([win[st:], X[i:i + st]])
        win = win - (win @ V) @ V.T
        Sn, Vn = sketch_rows(win, k, subsample, max_iter, seed, salt=2 * t)
        lo, hi = int(np.argmin(S)), int(np.argmax(Sn[:k]))
        if Sn[hi] > S[lo]:
            S[lo] = Sn[hi]
            V[:, lo] = Vn[:, hi]
            changes.append(i)
        scores.append(X[i:i + st] @ V)
        specs.append(spectral(win, V, seed, 2 * t + 1))
        models.append((S.copy(), V.copy()))
        i += st
        if t == max_slides:
            break
    return np.vstack(scores), specs, models, changes


def spectral(win, V, seed, salt):
    w = win - (win @ V) @ V.T
    S, _ = sketch_rows(w, 1, 1, 10, seed, salt)
    return float(S[0])
