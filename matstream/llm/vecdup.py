"""Operator 7: near-duplicate vectors by int8 tile products with error bounds.

Equal vectors of a label are one entry with a count. Entries of a label are dealt into
blocks of about ``BLOCK``; every pair of blocks
is a tile. Unit vectors are quantised per vector: ``x = s q + e`` with int8
``q``, and ``|e|`` is computed, not assumed. For a pair,
``|x.y - s_x s_y q_x.q_y| <= |e_x| + |e_y| + |e_x| |e_y|``
(unit x and y, Cauchy-Schwarz), so a pair whose quantised product plus this bound is below the threshold
cannot be linked. Tiles get codes, scales and errors alone; a vector with a possible partner in a tile is
fetched for that tile in double precision, and only the possible pairs are computed again.

A tile sends on vectors with a possible partner, then each one's number of links and a spanning forest of the
links, at most one edge a vector, never its pairs; so a group of thousands of
copies costs linear output.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label or id, link with nothing and keep
themselves; vectors of different lengths never link; rows with the same id are
separate vectors that may link; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.llm.common import materialise
from matstream.llm.components import connected_components

THRESHOLD = 0.98
BLOCK = 2048
_SLACK = 1e-9  # float rounding of the bound itself


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and exact error norms of the rows of ``x`` (unit, float64)."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.linalg.norm(x - scale[:, None] * q, axis=1)
    return q, scale, err


class Codes:
    """Quantised unit vectors: int8 codes (rows), scales and error norms."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, err: np.ndarray):
        self.q, self.scale, self.err = q, scale, err

    def at(self, i: np.ndarray) -> Codes:
        return Codes(self.q[i], self.scale[i], self.err[i])


def possible_pairs(x: Codes, y: Codes, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) whose cosine may reach the threshold, some rows of x at a time; i < j within one block."""
    # products of int8 codes are below 2**24 in sum for 1,000 components, exact in float32; else float64
    exact = np.float32 if x.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qyt = y.q.astype(exact).T
    for lo in range(0, len(x.q), 256):
        part = slice(lo, lo + 256)
        approx = (x.q[part].astype(exact) @ qyt).astype(np.float64) * (x.scale[part, None] * y.scale[None, :])
        bound = x.err[part, None] + y.err[None, :] + x.err[part, None] * y.err[None, :] + _SLACK
        i, j = np.nonzero(approx + bound >= threshold)
        i = i + lo
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        yield i, j


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine >= threshold of unit-free rows x and y; i < j within one block."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    cx, cy = Codes(*quantise(x / nx[:, None])), Codes(*quantise(y / ny[:, None]))
    out_i, out_j = [], []
    for i, j in possible_pairs(cx, cy, same, threshold):
        for a in range(0, len(i), 100_000):
            ii, jj = i[a:a + 100_000], j[a:a + 100_000]
            cos = (x[ii] * y[jj]).sum(axis=1) / (nx[ii] * ny[jj])
            ok = cos >= threshold
            out_i.append(ii[ok])
            out_j.append(jj[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Positions of links that join two parts of 0..n-1 for the first time."""
    parent = list(range(n))
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def _sides(rows: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray]:
    left = np.asarray(rows.column("side").to_numpy()) == 0
    return np.flatnonzero(left), np.flatnonzero(left if same else ~left)


_DEALT = "label {label}, dim int, i long, j long, row long, n_same long, side int"


def _tile_possible(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of a tile of codes that may have a link in it."""
    dim = key[1].as_py()
    codes = Codes(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(rows), dim),
                  rows.column("scale").to_numpy(), rows.column("err").to_numpy())
    same = key[2].as_py() == key[3].as_py()
    li, ri = _sides(rows, same)
    keep = np.zeros(len(rows), dtype=bool)
    for i, j in possible_pairs(codes.at(li), codes.at(ri), same, THRESHOLD) if len(li) and len(ri) else ():
        keep[li[i]] = True
        keep[ri[j]] = True
    return rows.select(["label", "dim", "i", "j", "row", "n_same", "side"]).filter(pa.array(keep))


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Link counts (b null) and forest edges of one tile; an entry counts for all its equal vectors."""
    rows = rows.combine_chunks()
    ids, n_same = rows.column("row").to_numpy(), rows.column("n_same").to_numpy()
    vecs = rows.column("vec").combine_chunks()
    x = np.asarray(vecs.flatten(), dtype=np.float64).reshape(len(ids), key[1].as_py())
    same = key[2].as_py() == key[3].as_py()
    li, ri = _sides(rows, same)
    i, j = tile_links(x[li], x[ri], same) if len(li) and len(ri) else (np.zeros(0, int), np.zeros(0, int))
    a, b = li[i], ri[j]
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, a, n_same[b])
    np.add.at(count, b, n_same[a])
    some = np.flatnonzero(count)
    edges = _forest(a, b, len(ids))
    return pa.table({
        "a": pa.concat_arrays([pa.array(ids[some]), pa.array(ids[a[edges]])]),
        "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[b[edges]])]),
        "n": pa.concat_arrays([pa.array(count[some]), pa.nulls(len(edges), pa.int64())])})


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries as int8 codes of the unit vector with scale and error norm."""
    for batch in batches:
        code, scale, err = [], [], []
        for v in batch.column("vec"):
            x = np.asarray(v.values, dtype=np.float64)
            q, s, e = quantise((x / np.linalg.norm(x))[None, :])
            code.append(q.tobytes())
            scale.append(s[0])
            err.append(e[0])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("label", "dim", "row", "n_same")], pa.array(code, pa.binary()),
             pa.array(scale, pa.float64()), pa.array(err, pa.float64())],
            names=["label", "dim", "row", "n_same", "code", "scale", "err"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors usable for comparison; others become null."""
    for batch in batches:
        col = batch.column("embedding")
        good = np.array([_usable(v) for v in col], dtype=bool)
        vec = pa.array([v.as_py() if g else None for v, g in zip(col, good, strict=True)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), vec],
                                         names=["vec_id", "label", "vec"])


def _usable(v: pa.Scalar) -> bool:
    if not v.is_valid or not len(v.values) or v.values.null_count:
        return False
    x = np.asarray(v.values, dtype=np.float64)
    with np.errstate(over="ignore"):
        norm = np.sqrt((x * x).sum())
    return bool(np.isfinite(x).all() and 0 < norm < np.inf)


def similar_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``vec_id, n_links, component_id, kept``."""
    label = vectors.schema["label"].dataType.simpleString()
    v = vectors.select("vec_id", "label", "embedding").mapInArrow(
        _clean, f"vec_id long, label {label}, vec array<double>")
    # a row number fixed by writing it out, as ids may repeat or be null
    v = materialise(v.withColumn("row", F.monotonically_increasing_id()), "vd-row")
    usable = v.where(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumn(
        "dim", F.size("vec"))
    # equal vectors are one entry, known by its smallest row number
    entries = materialise(usable.groupBy("label", "dim", "vec").agg(
        F.min("row").alias("row"), F.count("*").alias("n_same")), "vd-entry")
    own_entry = materialise(usable.join(entries.withColumnRenamed("row", "entry"), ["label", "dim", "vec"]).select(
        "row", "entry", "n_same"), "vd-of")
    coded = materialise(entries.select("label", "dim", "row", "n_same", "vec").mapInArrow(
        _coded, f"label {label}, dim int, row long, n_same long, code binary, scale double, err double"), "vd-code")
    blocks = materialise(coded.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "vd-block")
    dealt = coded.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("row"), "blocks"))
    # an entry of block k is the left side of tiles (k, j >= k) and the right side of tiles (i < k, k)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("*", every).select(
        "label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row", "n_same",
        (F.col("own") > F.col("other")).cast("int").alias("side"), "code", "scale", "err")
    possible = materialise(tiles.groupBy("label", "dim", "i", "j").applyInArrow(
        _tile_possible, _DEALT.format(label=label)), "vd-possible")
    doubles = possible.join(entries.select("row", "vec"), "row")
    found = materialise(doubles.groupBy("label", "dim", "i", "j").applyInArrow(_tile, "a long, b long, n long"), "vd-link")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("others"))
    comp = connected_components(found.where(F.col("b").isNotNull()))
    named = own_entry.join(v.select("row", "vec_id"), "row").join(
        comp.withColumnRenamed("id", "entry"), "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    least = materialise(named.groupBy("component").agg(F.min("vec_id").alias("least")), "vd-least")
    links = F.coalesce("others", F.lit(0)) + F.col("n_same") - 1
    of_row = materialise(named.join(least, "component").join(counts, "entry", "left").select(
        "row", "least", links.alias("n_links")), "vd-comp")
    out = v.select("row", "vec_id").join(of_row, "row", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
