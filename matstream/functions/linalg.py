"""Driver-side algebra on small matrices (d x d, d x s, s x s).

Everything here works on moments that Spark has already reduced; no row of
data is touched.  Deflation ``P = I - V V'`` acts on moments as
``mean -> P mean`` and ``W -> P W P`` (never forming the d x d projector).
"""

from __future__ import annotations

import math

import numpy as np

RANK_TOL = 1e-12


def java_round4(x: float) -> float:
    """Round half up to 4 decimals, as ``Math.round(x * 10000) / 10000.0``."""
    return math.floor(x * 10000.0 + 0.5) / 10000.0


def orthonormal_factor(ztz: np.ndarray) -> np.ndarray:
    """A matrix ``F`` with ``F' ZtZ F = I`` on the range of ``ZtZ``.

    Cholesky ``ZtZ = R'R`` gives ``F = R^-1`` (the reference's QR by
    Cholesky).  When ``ZtZ`` is not positive definite (the window has lower
    rank than the sketch), a symmetric eigen-decomposition keeps the
    directions above ``1e-12 * max eigenvalue``; ``F`` then has fewer columns.
    """
    try:
        L = np.linalg.cholesky(ztz)
        diag = np.abs(np.diag(L))
        if diag.min() > math.sqrt(RANK_TOL) * max(diag.max(), 1e-300):
            return np.linalg.inv(L.T)
    except np.linalg.LinAlgError:
        pass
    w, E = np.linalg.eigh((ztz + ztz.T) / 2)
    keep = w > RANK_TOL * max(w.max(), 0.0)
    if not keep.any():
        return np.zeros((ztz.shape[0], 0))
    return E[:, keep] / np.sqrt(w[keep])


def sketch_round(yz: np.ndarray, zz: np.ndarray, k: int):
    """One subspace-iteration round from centred ``YtZ`` (d x s) and ``ZtZ`` (s x s).

    Returns ``(S, V, B)``: all singular values of ``(YtZ R^-1)'`` padded with
    zeros to ``s``, the first ``k`` right singular vectors (d x k), and the
    next seed ``B = YtZ R^-1`` (padded to s columns).
    """
    s = zz.shape[0]
    Fm = orthonormal_factor(zz)
    A = (yz @ Fm).T  # r x d, r <= s
    _, S, Vt = np.linalg.svd(A, full_matrices=False)
    S = np.concatenate([S, np.zeros(s - S.shape[0])])
    V = canonical_signs(Vt.T)
    if V.shape[1] < k:
        V = np.hstack([V, np.zeros((V.shape[0], k - V.shape[1]))])
    B = A.T
    if B.shape[1] < s:
        B = np.hstack([B, np.zeros((B.shape[0], s - B.shape[1]))])
    return S, V[:, :k], B


def canonical_signs(V: np.ndarray) -> np.ndarray:
    """Flip each column so its largest-magnitude entry (the first on ties) is positive.

    Singular vectors are defined up to sign; fixing it makes scores
    reproducible across BLAS builds and comparable with other engines.
    """
    if V.size == 0:
        return V
    idx = np.argmax(np.abs(V), axis=0)
    signs = np.sign(V[idx, np.arange(V.shape[1])])
    signs[signs == 0] = 1.0
    return V * signs


def orth_cols(B: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of the seed (same span and rank, so the same sketch subspace).

    Feeding ``YtZ R^-1`` back unnormalised squares the conditioning of
    ``ZtZ`` once more every round; on a steep spectrum a real direction then
    falls below the rank tolerance.  Re-orthonormalising keeps ``S`` and ``V``
    identical in exact arithmetic and the conditioning at ``(s_i / s_1)^2``.
    """
    U, sv, _ = np.linalg.svd(B, full_matrices=False)
    keep = sv > RANK_TOL * max(sv.max(initial=0.0), 1e-300)
    # the rank of the seed is kept: null directions stay zero columns (the rank fallback drops them)
    return np.hstack([U[:, keep], np.zeros((B.shape[0], B.shape[1] - int(keep.sum())))])


def gram_round(C: np.ndarray, B: np.ndarray, k: int):
    """A sketch round when the centred Gram ``C`` of the window is known: ``YtZ = C B``, ``ZtZ = B'C B``."""
    B = orth_cols(B)
    yz = C @ B
    zz = B.T @ yz
    return sketch_round(yz, (zz + zz.T) / 2, k)


def deflate_gram(W: np.ndarray, V: np.ndarray) -> np.ndarray:
    """``P W P`` with ``P = I - V V'`` in O(d^2 k)."""
    WV = W @ V
    VtWV = V.T @ WV
    out = W - V @ WV.T - WV @ V.T + V @ VtWV @ V.T
    return (out + out.T) / 2


def deflate_vec(m: np.ndarray, V: np.ndarray) -> np.ndarray:
    return m - V @ (V.T @ m)


def pooled_gram(parts) -> tuple[int, np.ndarray, np.ndarray]:
    """Pool ``(n, mean, within-centred Gram)`` parts into the same for their union."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    C = sum(p[2] for p in parts)
    for n_i, m_i, _ in parts:
        dm = m_i - mean
        C = C + n_i * np.outer(dm, dm)
    return n, mean, C


def orth_basis(V: np.ndarray) -> np.ndarray:
    """Left singular vectors of ``V`` (an orthonormal basis of its columns, d x k)."""
    U, _, _ = np.linalg.svd(V, full_matrices=False)
    return U
