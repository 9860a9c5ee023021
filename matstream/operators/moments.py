"""Column and cross moments of a matrix in rows form.

Column statistics run in the JVM (``ml.stat.Summarizer`` over the row
vectors: one pass, partial aggregation, no explode).  Cross moments with a
sketch matrix (A6-A9) and per-chunk Gram matrices (A10) are block products
inside Arrow batches (``mapInArrow``), one partial per partition and key,
then summed by a Spark aggregate over *cells* ``(key, i, j)`` so the final
merge is spread over many reducers even when one key holds most rows.
"""

from __future__ import annotations

import itertools
from typing import Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.functions.arrowmat import to_matrix
from matstream.sources.frames import FEATURES, ROW_ID

CELLS_SCHEMA = "chunk BIGINT, i INT, j INT, v DOUBLE"
KERNEL_STATE_BYTES = 256 << 20  # per-task accumulator budget of the chunk-moment kernel


# --- column statistics (A1-A4, A12) ------------------------------------------------------

def column_stats(df: DataFrame, metrics=("count", "sum", "mean", "normL1", "max"), col: str = FEATURES) -> DataFrame:
    """One-row frame of column statistics as arrays (``count`` is a long)."""
    summ = Summarizer.metrics(*metrics).summary(array_to_vector(col)).alias("s")
    out = df.select(summ)
    cols = []
    for m in metrics:
        c = F.col(f"s.{m}")
        cols.append(c.alias(m) if m == "count" else vector_to_array(c).alias(m))
    return out.select(*cols)


def _vector_cells(stats: DataFrame, metric: str, name: str = "v") -> DataFrame:
    return stats.select(F.posexplode(metric).alias("j", name))


def row_count(df: DataFrame) -> DataFrame:
    """A1: ``n``."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def column_sum(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """A2: ``j, v`` elementwise sum of the rows."""
    return _vector_cells(column_stats(df, ("sum",), col), "sum")


def column_mean(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """A3: ``j, v`` column means."""
    return _vector_cells(column_stats(df, ("mean",), col), "mean")


def column_abs_sum(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """A4: ``j, v`` sum of absolute values (abs per row, so partitioning cannot change it)."""
    return _vector_cells(column_stats(df, ("normL1",), col), "normL1")


def column_max(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """``j, v`` column maximum floored at 0 (the scan starts from 0)."""
    cells = _vector_cells(column_stats(df, ("max",), col), "max", "m")
    return cells.select("j", F.greatest(F.col("m"), F.lit(0.0)).alias("v"))


def row_max(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """``row_id, v`` maximum inside a row floored at 0."""
    return df.select(ROW_ID, F.greatest(F.array_max(col), F.lit(0.0)).alias("v"))


def mean_vector(df: DataFrame, col: str = FEATURES) -> tuple[int, np.ndarray]:
    """``(n, column means)`` on the driver (d numbers)."""
    row = column_stats(df, ("count", "mean"), col).first()
    mean = np.asarray(row["mean"], dtype=np.float64)
    if not np.isfinite(mean).all():
        raise ValueError("matrix holds NaN or infinite values")
    return int(row["count"]), mean


def matrix_sum(cells: DataFrame, by: str | None = None) -> DataFrame:
    """A5: elementwise sum of matrices given as cells ``[by,] i, j, v``."""
    keys = ([by] if by else []) + ["i", "j"]
    return cells.groupBy(*keys).agg(F.sum("v").alias("v"))


def total_variance(gram_cells: DataFrame) -> DataFrame:
    """Trace of a (centred) Gram given as cells ``i, j, v``."""
    return gram_cells.where(F.col("i") == F.col("j")).agg(F.sum("v").alias("total_variance"))


# --- chunk moments (A10) -------------------------------------------------------------------

def chunk_moments(df: DataFrame, chunk_col: str = "chunk", shift: Mapping[int, np.ndarray] | None = None,
                  col: str = FEATURES) -> DataFrame:
    """A10: per chunk ``n``, column sum and upper-triangle Gram ``Y'Y`` as cells.

    Cells ``chunk, i, j, v``: ``(-1, -1)`` is the count, ``(-1, j)`` the
    column sum, ``(i, j)`` with ``i <= j`` the Gram.  With ``shift`` (chunk ->
    vector, a table bounded by the number of chunks) the moments are of
    ``y - shift[chunk]``: passing the chunk means gives the centred Gram
    without cancellation.
    """
    spark = df.sparkSession
    bshift = spark.sparkContext.broadcast({int(k): np.asarray(v, np.float64) for k, v in shift.items()}) \
        if shift is not None else None

    def flush(acc):
        for key, (n, s1, G) in acc.items():
            d = s1.shape[0]
            iu, ju = np.triu_indices(d)
            i = np.concatenate([[-1], np.full(d, -1), iu]).astype(np.int32)
            j = np.concatenate([[-1], np.arange(d), ju]).astype(np.int32)
            v = np.concatenate([[float(n)], s1, G[iu, ju]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), key, np.int64)),
                 pa.array(i), pa.array(j), pa.array(v)],
                names=["chunk", "i", "j", "v"])

    def kernel(batches):
        acc: dict[int, list] = {}
        sh = bshift.value if bshift is not None else None
        for b in batches:
            if b.num_rows == 0:
                continue
            ch = b.column(0).to_numpy(zero_copy_only=False)
            Y = to_matrix(b.column(1))
            if not np.isfinite(Y).all():
                raise ValueError("matrix holds NaN or infinite values")
            if acc and len(acc) * Y.shape[1] ** 2 * 8 > KERNEL_STATE_BYTES:
                # many chunks in one partition (unsorted input): emit partial sums early, the aggregate adds them
                yield from flush(acc)
                acc = {}
            order = np.argsort(ch, kind="stable")
            keys, starts = np.unique(ch[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            for key, s, e in zip(keys.tolist(), starts, ends):
                Yg = Y[order[s:e]]
                if sh is not None:
                    Yg = Yg - sh[key]
                a = acc.get(key)
                if a is None:
                    d = Yg.shape[1]
                    a = acc[key] = [0, np.zeros(d), np.zeros((d, d))]
                a[0] += Yg.shape[0]
                a[1] += Yg.sum(axis=0)
                a[2] += Yg.T @ Yg
        yield from flush(acc)

    partial = df.select(F.col(chunk_col).cast("long"), F.col(col)).mapInArrow(kernel, CELLS_SCHEMA)
    return partial.groupBy("chunk", "i", "j").agg(F.sum("v").alias("v"))


def unpack_cells(ch: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, d: int):
    """Yield ``(chunk, n, sum, full symmetric Gram, shift)`` from moment cells.

    Cell layout: ``(-1, -1)`` count, ``(-1, j)`` column sum, ``(i, j)`` with
    ``i <= j`` the Gram, and optionally ``(-2, j)`` the shift the moments were
    taken about (zero when absent).
    """
    order = np.argsort(ch, kind="stable")
    keys, starts = np.unique(ch[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    for key, a, b in zip(keys.tolist(), starts, ends):
        sel = order[a:b]
        ii, jj, vv = i[sel], j[sel], v[sel]
        n = int(round(vv[(ii == -1) & (jj == -1)].sum()))
        s1 = np.zeros(d)
        m = (ii == -1) & (jj >= 0)
        s1[jj[m]] = vv[m]
        shift = np.zeros(d)
        m = ii == -2
        shift[jj[m]] = vv[m]
        G = np.zeros((d, d))
        m = ii >= 0
        G[ii[m], jj[m]] = vv[m]
        yield key, n, s1, G + np.triu(G, 1).T, shift


def centred_states(ch, i, j, v, d) -> dict[int, list]:
    """Chunk -> ``[n, mean, centred Gram]`` from cells of moments taken about a shift."""
    return {key: [n, shift + s1 / n, G - np.outer(s1, s1) / n]
            for key, n, s1, G, shift in unpack_cells(ch, i, j, v, d)}


def collect_moments(cells: DataFrame, d: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Chunk moments on the driver: chunk -> (n, sum, full symmetric Gram).

    The size is ``chunks * d(d+1)/2`` numbers, bounded by the schedule; it is
    fetched as Arrow, not as Python rows.
    """
    tbl = cells.toArrow()
    cols = [tbl.column(c).to_numpy() for c in ("chunk", "i", "j", "v")]
    return {key: (n, s1, G) for key, n, s1, G, _ in unpack_cells(*cols, d)}


# --- centred chunk moments in one scan (A10, pooled) -------------------------------------------------

MOMENTS_SCHEMA = "chunk BIGINT, part INT, n BIGINT, mean ARRAY<DOUBLE>, w ARRAY<DOUBLE>"
PART_CELLS = 1 << 15   # Gram cells of a moments row: wide rows have several rows a chunk
OUT_BYTES = 8 << 20    # of moments sent in one Arrow batch


def pool_into(acc: list, n: int, mean: np.ndarray, w: np.ndarray) -> None:
    """Add a part's ``n, mean, centred Gram`` to ``acc`` by the pooling identity, in place."""
    total = acc[0] + n
    delta = mean - acc[1]
    acc[2] += w
    acc[2] += np.outer(delta * (acc[0] * n / total), delta)
    acc[1] = acc[1] + delta * (n / total)
    acc[0] = total


def _moment_batches(rows):
    """Arrow batches of about ``OUT_BYTES`` from ``(chunk, part, n, mean, w)`` rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[3].nbytes + row[4].nbytes
        if size >= OUT_BYTES:
            yield _moment_batch(held)
            held, size = [], 0
    if held:
        yield _moment_batch(held)


def _moment_batch(rows) -> pa.RecordBatch:
    def lists(k):
        ends = np.cumsum([0] + [len(r[k]) for r in rows]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows])))

    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.int64()), lists(3), lists(4)], names=["chunk", "part", "n", "mean", "w"])


def moment_rows(batches):
    """``(chunk, part, n, mean, w)`` of the rows of moments batches, arrays as numpy views."""
    for b in batches:
        ch, part, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        mean, w = b.column(3), b.column(4)
        m_at, w_at = mean.offsets.to_numpy(), w.offsets.to_numpy()
        m, v = mean.values.to_numpy(zero_copy_only=False), w.values.to_numpy(zero_copy_only=False)
        for r in range(b.num_rows):
            yield int(ch[r]), int(part[r]), int(n[r]), m[m_at[r]:m_at[r + 1]], v[w_at[r]:w_at[r + 1]]


def pooled_moments(df: DataFrame, chunk_col: str = "chunk", col: str = FEATURES) -> DataFrame:
    """A10 centred, in one scan: ``chunk, part, n, mean, w`` with the within-chunk centred Gram's upper triangle.

    A task centres its rows of a chunk about their own mean; the parts of a
    chunk meet sorted by (chunk, part) and are added one after another by the
    pooling identity, so neither the chunk means nor a second scan are needed and a
    chunk that most tasks hold is folded in constant memory. A Gram of
    more than ``PART_CELLS`` cells is cut into rows that travel and fold on their own.
    """
    def scan(batches):
        acc: dict[int, list] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            ch = b.column(0).to_numpy(zero_copy_only=False)
            Y = to_matrix(b.column(1))
            if not np.isfinite(Y).all():
                raise ValueError("matrix holds NaN or infinite values")
            if acc and len(acc) * Y.shape[1] ** 2 * 8 > KERNEL_STATE_BYTES:
                yield from _moment_batches(_parts(acc))
                acc = {}
            order = np.argsort(ch, kind="stable")
            keys, starts = np.unique(ch[order], return_index=True)
            for key, at in zip(keys.tolist(), np.split(order, starts[1:])):
                Yg = Y[at]
                mean = Yg.mean(axis=0)
                Yc = Yg - mean
                w = Yc.T @ Yc
                if key in acc:
                    if len(acc[key][1]) != len(mean):
                        raise ValueError("rows have different widths")
                    pool_into(acc[key], len(at), mean, w)
                else:
                    acc[key] = [len(at), mean, w]
        yield from _moment_batches(_parts(acc))

    def fold(batches):
        def merged():
            held, cells = None, None
            for chunk, part, n, mean, w in moment_rows(batches):
                if held is not None and held[:2] == [chunk, part]:
                    if len(mean) != len(held[3]):
                        raise ValueError("rows have different widths")
                    if cells is None:
                        iu, ju = np.triu_indices(len(mean))
                        cells = iu[part * PART_CELLS:][:len(w)], ju[part * PART_CELLS:][:len(w)]
                    total, delta = held[2] + n, mean - held[3]
                    held[4] = held[4] + w + delta[cells[0]] * delta[cells[1]] * (held[2] * n / total)
                    held[3] = held[3] + delta * (n / total)
                    held[2] = total
                else:
                    if held is not None:
                        yield held
                    held, cells = [chunk, part, n, mean, w], None
            if held is not None:
                yield held

        yield from _moment_batches(merged())

    partial = df.select(F.col(chunk_col).cast("long"), F.col(col)).mapInArrow(scan, MOMENTS_SCHEMA)
    return partial.repartition("chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(fold, MOMENTS_SCHEMA)


MOMENTS_ARROW = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())),
                           ("w", pa.list_(pa.float64()))])


def state_batches(states: dict[int, list]) -> list[pa.RecordBatch]:
    """Chunk states as moments batches."""
    return [b.cast(MOMENTS_ARROW) for b in _moment_batches(_parts(states))]


def _parts(acc: dict[int, list]):
    for key, (n, mean, w) in acc.items():
        flat = w[np.triu_indices(len(mean))]
        for part, at in enumerate(range(0, len(flat), PART_CELLS)):
            yield key, part, n, mean, flat[at:at + PART_CELLS]


def whole_states(rows):
    """``(chunk, [n, mean, centred Gram])`` from moments rows ordered by (chunk, part)."""
    for chunk, group in itertools.groupby(rows, key=lambda r: r[0]):
        parts = list(group)
        n, mean = parts[0][2], np.array(parts[0][3])
        W = np.zeros((len(mean), len(mean)))
        W[np.triu_indices(len(mean))] = np.concatenate([r[4] for r in parts])
        yield chunk, [n, mean, W + np.triu(W, 1).T]


# --- sketch moments (A6-A9) ----------------------------------------------------------------

def sketch_pass(df: DataFrame, omega: np.ndarray, mean: np.ndarray, col: str = FEATURES) -> DataFrame:
    """``sum z``, ``sum y (z - zm)'`` and ``sum z (z - zm)'`` in one scan, ``z = y Omega``.

    ``zm = mean Omega``.  Rows are never centred or copied; the sketch row
    ``z`` exists only inside the batch.  Cells ``part, i, j, v`` with part
    ``n`` (count), ``z`` (i=-1), ``yz`` (d x s) and ``zz`` (s x s).
    """
    spark = df.sparkSession
    b = spark.sparkContext.broadcast((np.asarray(omega, np.float64), np.asarray(mean, np.float64)))

    def kernel(batches):
        om, ym = b.value
        zm = ym @ om
        d, s = om.shape
        n, sz, yz, zz = 0, np.zeros(s), np.zeros((d, s)), np.zeros((s, s))
        for rb in batches:
            if rb.num_rows == 0:
                continue
            Y = to_matrix(rb.column(0), d)
            Z = Y @ om
            Zc = Z - zm
            n += Y.shape[0]
            sz += Z.sum(axis=0)
            yz += Y.T @ Zc
            zz += Z.T @ Zc
        if n == 0:
            return
        parts, ii, jj, vv = ["n"], [-1], [-1], [float(n)]
        for name, mat in (("yz", yz), ("zz", zz)):
            r, c = np.indices(mat.shape)
            parts += [name] * mat.size
            ii += r.ravel().tolist()
            jj += c.ravel().tolist()
            vv += mat.ravel().tolist()
        parts += ["z"] * s
        ii += [-1] * s
        jj += list(range(s))
        vv += sz.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts), pa.array(ii, pa.int32()), pa.array(jj, pa.int32()), pa.array(vv, pa.float64())],
            names=["part", "i", "j", "v"])

    partial = df.select(col).mapInArrow(kernel, "part STRING, i INT, j INT, v DOUBLE")
    return partial.groupBy("part", "i", "j").agg(F.sum("v").alias("v"))


def centred_sketch_cells(df: DataFrame, omega: np.ndarray, mean: np.ndarray, col: str = FEATURES) -> DataFrame:
    """A6-A8 as Spark cells: the mean-propagation correction applied in the JVM.

    ``YtZ = sum y (z - zm)' - ym (sum z - N zm)'`` and the same with ``z`` on
    both sides.  Output ``part, i, j, v`` for parts ``z`` (sum), ``yz``, ``zz``.
    """
    om = np.asarray(omega, np.float64)
    ym = np.asarray(mean, np.float64)
    zm = ym @ om
    # the aggregated cells are d*s + s*s + s + 1 numbers: small, cached once
    raw = sketch_pass(df, om, ym, col).cache()
    n_total = float(raw.where(F.col("part") == "n").first()["v"])
    zsum = raw.where(F.col("part") == "z").select(F.col("j").alias("jz"), F.col("v").alias("sz"))
    body = raw.where(F.col("part").isin("yz", "zz"))
    joined = body.join(F.broadcast(zsum), body.j == zsum.jz)
    ymv = F.lit(ym.tolist()).cast("array<double>")
    zmv = F.lit(zm.tolist()).cast("array<double>")
    left = F.when(F.col("part") == "yz", F.element_at(ymv, F.col("i") + 1)).otherwise(
        F.element_at(zmv, F.col("i") + 1))
    centred = joined.select(
        "part", "i", "j",
        (F.col("v") - left * (F.col("sz") - F.lit(n_total) * F.element_at(zmv, F.col("j") + 1))).alias("v"))
    zcells = raw.where(F.col("part") == "z").select("part", "i", "j", "v")
    return centred.unionByName(zcells)


def sketch_moments(df: DataFrame, omega: np.ndarray, mean: np.ndarray, col: str = FEATURES):
    """A9 on the driver: ``(n, sum z, YtZ, ZtZ)`` centred with the given mean (d x s numbers)."""
    om = np.asarray(omega, np.float64)
    ym = np.asarray(mean, np.float64)
    d, s = om.shape
    zm = ym @ om
    tbl = sketch_pass(df, om, ym, col).toArrow()
    part = np.asarray(tbl.column("part").to_pylist())
    i = tbl.column("i").to_numpy()
    j = tbl.column("j").to_numpy()
    v = tbl.column("v").to_numpy()
    n = int(round(v[part == "n"].sum()))
    sz = np.zeros(s)
    m = part == "z"
    sz[j[m]] = v[m]
    yz = np.zeros((d, s))
    m = part == "yz"
    yz[i[m], j[m]] = v[m]
    zz = np.zeros((s, s))
    m = part == "zz"
    zz[i[m], j[m]] = v[m]
    yz -= np.outer(ym, sz - n * zm)
    zz -= np.outer(zm, sz - n * zm)
    return n, sz, yz, zz


def sparse_sketch_cells(cells: DataFrame, omega: np.ndarray, n_rows: int) -> DataFrame:
    """A7/A8 of sparse rows (cells ``row_id, j, v``), never made dense: ``part, i, j, v`` for parts ``yz``, ``zz``.

    ``n_rows`` counts all rows, those without a stored cell included.  Sums run over stored cells only;
    the means enter at the end: ``YtZ = sum y z' - (sum y)(sum z)' / n``, and the same with ``z`` twice.
    """
    from matstream.operators.rows import project_sparse

    n = F.lit(float(n_rows))
    z = project_sparse(cells, omega).select("row_id", F.col("c").alias("j"), F.col("v").alias("z"))
    wide = z.groupBy("row_id").agg(F.collect_list(F.struct("j", "z")).alias("zs"))  # s numbers a row
    z_sum = z.groupBy("j").agg(F.sum("z").alias("sz"))  # s rows
    y_sum = cells.groupBy(F.col("j").alias("i")).agg(F.sum("v").alias("sy"))
    pairs = cells.select("row_id", F.col("j").alias("i"), "v").join(wide, "row_id").select(
        "i", "v", F.inline("zs"))
    yz = pairs.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("z")).alias("v"))
    # a row with a stored cell has all s values of z, so every stored column has its s pairs
    yz = yz.join(y_sum, "i").join(F.broadcast(z_sum), "j").select(
        F.lit("yz").alias("part"), "i", "j", (F.col("v") - F.col("sy") * F.col("sz") / n).alias("v"))
    both = wide.select("zs", F.inline("zs")).select(F.col("j").alias("i"), F.col("z").alias("zi"), F.inline("zs"))
    zz = both.groupBy("i", "j").agg(F.sum(F.col("zi") * F.col("z")).alias("v"))
    left = F.broadcast(z_sum.select(F.col("j").alias("i"), F.col("sz").alias("si")))
    zz = zz.join(left, "i").join(F.broadcast(z_sum), "j").select(
        F.lit("zz").alias("part"), "i", "j", (F.col("v") - F.col("si") * F.col("sz") / n).alias("v"))
    return yz.unionByName(zz)
