"""Sliding-window PCA.

Plan of :func:`sliding_pca`:

1. rows read by the schedule (``row_id < end``, pushed to the scan when ids
   are stored) are tagged with their chunk by arithmetic on ``row_id``;
2. one scan gives each chunk's count, mean and within-chunk centred Gram
   (``mapInArrow`` block products, pooled by (chunk, part) after one shuffle);
3. the recursion over steps runs on the driver on chunk moments only
   (``chunks * d^2`` numbers, bounded by the schedule): deflation acts on
   moments (``mean -> P mean``, ``W -> P W P``), a window is the pooled
   moments of its chunks, each sketch round is d x d algebra;
4. one scoring pass joins every row with the model of the step it entered
   at (broadcast when the model table is small, checked) and takes the dot
   products in the JVM.

So a run costs two scans of the scheduled rows, whatever the number of
slides and rounds.
"""

from __future__ import annotations

import collections
import functools
import itertools
import json
import operator
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matstream.functions import linalg as la
from matstream.functions.arrowmat import from_matrix, to_matrix
from matstream.operators import moments as mo
from matstream.operators.windows import Schedule, window_schedule, with_chunk
from matstream.plans.sketch import sketch_from_gram, sketch_from_matrix
from matstream.session import drop_path, folder_names, path_exists, scratch_path, written
from matstream.sources.frames import FEATURES, ROW_ID

BROADCAST_MODEL_BYTES = 64 << 20
DRIVER_STATE_BYTES = 512 << 20
LIVE_STATE_BYTES = 2 << 30
WINDOW_STATE_BYTES = 256 << 20
ROW_BAND_BYTES = 64 << 20    # rows entering in the steps that one task runs
BAND_READ_BYTES = 64 << 20   # moments fetched at once
COMMIT_S = 20                # whole bands wait at most so long to be written together
COMMIT_STATE_BYTES = 64 << 20
MOMENTS_MAX_D = 1024
ERROR_ROWS = 10_000

MODEL_SCHEMA = "step INT, comp INT, sigma DOUBLE, v ARRAY<DOUBLE>"
STATS_SCHEMA = ("step INT, block_num INT, app STRING, dataset STRING, n_rows BIGINT, n_cols INT, n_iter INT, "
                "preprocess_s DOUBLE, sketch_s ARRAY<DOUBLE>, avg_sketch_s DOUBLE, total_s DOUBLE, "
                "sigma_k1 DOUBLE, spectral_error DOUBLE, errors ARRAY<DOUBLE>, change_at ARRAY<BIGINT>")


@dataclass
class SlidingResult:
    scores: DataFrame      # row_id, step, scores ARRAY<DOUBLE>
    model: DataFrame       # step, comp, sigma, v
    stats: DataFrame       # one row per step
    schedule: Schedule
    S: np.ndarray          # singular values after the last step
    V: np.ndarray          # d x k after the last step
    models: list           # per step (S, V) on the driver
    stats_rows: list


def replace_component(S: np.ndarray, V: np.ndarray, S_new: np.ndarray, V_new: np.ndarray, k: int):
    """Swap the weakest kept component for the strongest new one when it is stronger.

    Weakest = first minimum of ``S``; strongest = first maximum of
    ``S_new[:k]``; strictly greater; at most one swap; no re-sort.  Returns
    ``(S, V, swapped)`` (copies).
    """
    S = S.copy()
    V = V.copy()
    lo = int(np.argmin(S[:k]))
    hi = int(np.argmax(S_new[:k]))
    if S_new[hi] > S[lo]:
        S[lo] = S_new[hi]
        V[:, lo] = V_new[:, hi]
        return S, V, True
    return S, V, False


def window_spectral_error(C: np.ndarray, n: int, V: np.ndarray, seed="validation", salt: int = 0) -> float:
    """I4: deflate the window by ``V``, sketch with k=1, subsample=1, 10 rounds; the top value."""
    Cd = la.deflate_gram(C, V)
    res = sketch_from_gram(Cd, n, 1, 1, max_iter=10, tolerance=0.05, calc_error=False, seed=seed, salt=salt)
    return float(res.S[0])


def window_spectral_errors(df: DataFrame, V: np.ndarray, block: int, stride: int, max_slides: int | None = None,
                           seed="validation", id_col: str = ROW_ID, col: str = FEATURES) -> DataFrame:
    """I4 for every window of the schedule: ``step, spectral_error`` of the raw window without a fixed ``V``.

    One scan to chunk moments, sorted by chunk and streamed through one sequence of windows that holds
    the live chunks only; nothing goes to the driver but the row count.
    """
    base = df.select(F.col(id_col).cast("long").alias(ROW_ID), F.col(col).alias(FEATURES))
    sched = window_schedule(base.count(), block, stride, max_slides)
    moments = mo.pooled_moments(with_chunk(base, sched)).repartition(1).sortWithinPartitions("chunk", "part")

    def errors(batches):
        live = StreamedChunks(mo.whole_states(mo.moment_rows(batches)), sched.last + 1)
        held = []
        for t in range(sched.last + 1):
            n, _, C = la.pooled_gram(live(t))
            held.append((t, window_spectral_error(C, n, V, seed, salt=2 * t + 1)))
            if len(held) == ERROR_ROWS or t == sched.last:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int32()),
                                                  pa.array([h[1] for h in held], pa.float64())],
                                                 names=["step", "spectral_error"])
                held = []

    return moments.mapInArrow(errors, "step INT, spectral_error DOUBLE")


class _ChunkStates:
    """Within-chunk centred moments, reduced by Spark in one scan, fetched to the driver by bands of entry steps.

    A run of one band fetches them once; longer runs write them once, a folder
    a band, so every band reads its own files only.  Chunks that have left
    the window are dropped, so the driver holds the live chunks and one band.
    """

    def __init__(self, rows: DataFrame, width: int, band: int, start: int):
        self.spark, self.width, self.band, self.start = rows.sparkSession, width, band, start
        self.path = None
        moments = mo.pooled_moments(rows)
        if start + band < width:
            at = F.floor((F.floor(F.col("chunk") / F.lit(width)) - F.lit(start)) / F.lit(band)).cast("int")
            self.path = scratch_path(self.spark, "moments")
            moments.withColumn("band", at).write.partitionBy("band").parquet(self.path)
            moments = self.spark.read.parquet(self.path)
        self.moments = moments

    def load_band(self, number: int) -> dict[int, list]:
        rows = self.moments if self.path is None else self.moments.where(F.col("band") == number).drop("band")
        tbl = rows.toArrow().sort_by([("chunk", "ascending"), ("part", "ascending")]).combine_chunks()
        return dict(mo.whole_states(mo.moment_rows(tbl.to_batches())))

    def release(self):
        if self.path is not None:
            drop_path(self.spark, self.path)


class _BandedStates(dict):
    """A dict of chunk states filled band by band of entry steps as the recursion asks for them."""

    def __init__(self, source: _ChunkStates):
        super().__init__()
        self.source = source
        self.loaded_to = source.start   # entry steps before this one are loaded or hold no rows
        self.bands = 0

    def ensure(self, t: int):
        while self.loaded_to <= t:
            self.update(self.source.load_band(self.bands))
            self.bands += 1
            self.loaded_to += self.source.band


def live_state_bytes(sched: Schedule, d: int) -> int:
    """Driver memory of the moments of one window: a chunk for each entry and each drop that cuts it."""
    chunks = min(2 * -(-sched.block // sched.stride) + 2, 2 * sched.last + 2)
    return chunks * d * d * 8


def banded_states(rows: DataFrame, sched: Schedule, d: int, start: int = 0):
    """Chunk moments of ``rows`` (tagged with ``chunk``), served to the recursion a band of entry steps at a time.

    All at once when the run is short; otherwise in bands of about
    ``DRIVER_STATE_BYTES`` of moments on top of the live chunks, whose size
    (:func:`live_state_bytes`) is checked here.
    """
    need = live_state_bytes(sched, d)
    if need > LIVE_STATE_BYTES:
        raise ValueError(f"the chunks of a window take {need >> 20} MB of moments on the driver (limit "
                         f"{LIVE_STATE_BYTES >> 20} MB): use method='rows' or a larger stride")
    per_step = 2 * d * d * 8
    width = sched.last + 1
    band = width if width * per_step <= DRIVER_STATE_BYTES else max(1, DRIVER_STATE_BYTES // per_step)
    source = _ChunkStates(rows, width, band, start)
    return source, _BandedStates(source)


def sliding_pca(df: DataFrame, k: int, block: int, stride: int, subsample: int, max_iter: int = 1,
                max_slides: int | None = None, tolerance: float = 0.05, calc_error: bool = False, q: int = 10,
                subsample_norm: int = 1, seed="validation", n: int | None = None, dataset: str = "",
                id_col: str = ROW_ID, col: str = FEATURES, method: str = "auto",
                order_by: str | None = None, run_path: str | None = None,
                band_steps: int | None = None, ties: tuple[str, ...] = ()) -> SlidingResult:
    """Principal components kept up to date as a window slides along ``row_id``.

    ``df`` is rows form with dense 0-based ids, or any frame with a unique
    ``order_by`` column (then a capped run numbers only the prefix it reads,
    see :func:`first_rows`; with ``ties`` rows of an equal key are ordered by those
    columns, then by their features).  Returns the scores of every
    scheduled row (raw rows times the model of their entry step), the model
    per step and the run statistics.

    ``method="moments"`` (``d <= 1024``) runs on chunk moments; ``"rows"``
    keeps the window as a DataFrame for wide rows (d x s state on the driver):
    each step appends the entering rows, deflates the window in Arrow batches,
    cuts the lineage with a reliable checkpoint in the shared checkpoint
    folder, and runs one distributed sketch pass per round; a window that fits
    into a task goes there with the rows of many steps, then back to the folder.  ``"window"`` (chosen
    for strides below ``d / 2``, where a chunk's Gram is larger than its
    rows) sends the rows in order through one task that holds the window's
    rows only and scores as it goes.  All give the same results.

    With ``run_path`` a run of any length goes band by band (``band_steps``
    steps): model and statistics of every band are written there with the state of the
    last, the bands of ``COMMIT_S`` seconds together.  Called again with the same path
    and settings, a run that was stopped goes on behind its last whole band (one that
    was killed, behind the last written).

    ``k == d`` becomes ``d - 1``, as in the reference; then ``k + subsample <=
    min(block - 1, d - k)``, ``k <= d - 3`` and ``block >= k + 3`` are checked.
    """
    spark = df.sparkSession
    if order_by is not None:
        # rows not yet numbered: a capped run numbers only the prefix it reads
        from matstream.operators.rowid import first_rows, with_row_id

        src = df.select(F.col(order_by), *ties, F.col(col).alias(FEATURES))
        by = [*ties, FEATURES] if ties else ()
        n = src.count() if n is None else n
        if max_slides is not None:
            need = min(n, block + max_slides * stride)
            src = first_rows(src, order_by, need, total=n, ties=by)
        else:
            src = with_row_id(src, order_by, ties=by)
        df, id_col, col = src, ROW_ID, FEATURES
    base = df.select(F.col(id_col).cast("long").alias(ROW_ID), F.col(col).alias(FEATURES))
    if n is None:
        # one aggregate over the id column (pruned scan): count plus the range the ids must span
        row = base.agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("lo"), F.max(ROW_ID).alias("hi")).first()
        n = int(row["n"])
        if n and (row["lo"] != 0 or row["hi"] != n - 1):
            raise ValueError(f"{id_col} is not dense 0..n-1 (min {row['lo']}, max {row['hi']}, n {n}); "
                             "pass order_by to number the rows")
    sched = window_schedule(n, block, stride, max_slides)
    rows = with_chunk(base, sched)
    d = rows.select(F.size(FEATURES)).first()[0]
    if k == d:
        k = d - 1
    if k > d - 3 or block < k + 3:
        raise ValueError(f"need k <= d - 3 and block >= k + 3 (k={k}, d={d}, block={block})")
    if k + subsample > min(block - 1, d - k):
        raise ValueError(f"need k + subsample <= min(block - 1, d - k) (k={k}, subsample={subsample}, d={d}, "
                         f"block={block}): a deflated window has no higher rank")
    if method == "auto":
        method = "moments" if d <= MOMENTS_MAX_D and live_state_bytes(sched, d) <= LIVE_STATE_BYTES else "rows"
        if 2 * stride < d <= MOMENTS_MAX_D and block * d * 8 <= WINDOW_STATE_BYTES:
            method = "window"   # rows are smaller than the moments of their chunks
    if run_path is not None:
        if method != "moments":
            raise ValueError("run_path needs method='moments'")
        return _sliding_long(rows, sched, d, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed,
                             dataset, run_path, band_steps)
    if method == "window":
        return _sliding_window(rows, sched, d, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed,
                               dataset)
    if method == "rows":
        return _sliding_rows(rows, sched, d, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm,
                             seed, dataset)

    t0 = time.perf_counter()
    source, states = banded_states(rows, sched, d)
    states.ensure(0)
    moments_s = time.perf_counter() - t0
    models, stats_rows = run_recursion(states, sched, d, k, subsample, max_iter, tolerance, calc_error, q,
                                       subsample_norm, seed, dataset, moments_s)
    source.release()
    S, V = models[-1]

    model_rows = [(t, c, float(Sm[c]), [float(x) for x in Vm[:, c]])
                  for t, (Sm, Vm) in enumerate(models) for c in range(k)]
    model_df = spark.createDataFrame(model_rows, MODEL_SCHEMA)
    stats_df = spark.createDataFrame(stats_rows, STATS_SCHEMA)
    scores = score_by_step(rows, sched, models, spark)
    return SlidingResult(scores, model_df, stats_df, sched, S, V, models, stats_rows)


_STEP_SCHEMA = ("step INT, sigma ARRAY<DOUBLE>, v ARRAY<ARRAY<DOUBLE>>, lo BIGINT, scores ARRAY<ARRAY<DOUBLE>>, "
                "n_rows BIGINT, n_iter INT, preprocess_s DOUBLE, sketch_s ARRAY<DOUBLE>, sigma_k1 DOUBLE, "
                "spectral_error DOUBLE, errors ARRAY<DOUBLE>, change_at ARRAY<BIGINT>")


def _dense_rows(batches, at: int, d: int):
    """The matrices of batches ``row_id, features`` whose ids go on by one from ``at``."""
    for b in batches:
        if b.num_rows:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if ids[0] != at or (np.diff(ids) != 1).any():
                raise ValueError("row ids are not dense")
            at += len(ids)
            Y = to_matrix(b.column(1), d)
            if not np.isfinite(Y).all():
                raise ValueError("matrix holds NaN or infinite values")
            yield Y


def _sliding_window(rows: DataFrame, sched: Schedule, d: int, k: int, subsample: int, max_iter: int, tolerance: float,
                    calc_error: bool, q: int, subsample_norm: int, seed, dataset: str) -> SlidingResult:
    """The sliding run over rows in order, for strides whose chunks are smaller than their moments.

    The steps follow each other row by row, so one task reads the sorted rows as a stream; it holds
    ``block x d`` numbers and sends on a row a step with the model, the statistics and the entering rows' scores.
    """
    ordered = rows.select(ROW_ID, FEATURES).repartition(1).sortWithinPartitions(ROW_ID)

    def run(batches):
        window = WindowRows(_dense_rows(batches, 0, d), sched)
        held = []
        for S, V, row in iter_steps(window, range(sched.last + 1), d, k, subsample, max_iter, tolerance, calc_error, q,
                                    subsample_norm, seed, enter_lo=lambda t: sched.steps[t][3]):
            t = row[0]
            held.append((t, S[:k].tolist(), V.T.tolist(), sched.steps[t][3], (window.entering @ V).tolist(), row[4], row[6],
                         row[7], row[8], row[11], row[12], row[13], row[14]))
            if len(held) * d * k >= MODEL_BATCH_CELLS or t == sched.last:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in held], schema)
                held = []

    numbers = pa.list_(pa.float64())
    schema = pa.schema([("step", pa.int32()), ("sigma", numbers), ("v", pa.list_(numbers)), ("lo", pa.int64()),
                        ("scores", pa.list_(numbers)), ("n_rows", pa.int64()), ("n_iter", pa.int32()), ("preprocess_s", pa.float64()),
                        ("sketch_s", numbers), ("sigma_k1", pa.float64()), ("spectral_error", pa.float64()),
                        ("errors", numbers), ("change_at", pa.list_(pa.int64()))])
    steps = written(ordered.mapInArrow(run, _STEP_SCHEMA), "window-run")
    model = steps.select("step", F.posexplode(F.arrays_zip("sigma", "v")).alias("comp", "c")).select(
        "step", "comp", F.col("c.sigma").alias("sigma"), F.col("c.v").alias("v"))
    scores = steps.select("step", "lo", F.posexplode("scores").alias("at", "scores")).select(
        (F.col("lo") + F.col("at")).alias(ROW_ID), "step", "scores")
    spent = F.aggregate("sketch_s", F.lit(0.0), lambda a, x: a + x)
    stats = steps.select(
        "step", (F.col("step") + 1).alias("block_num"), F.lit("matstream").alias("app"), F.lit(dataset).alias("dataset"), "n_rows",
        F.lit(d).alias("n_cols"), "n_iter", "preprocess_s", "sketch_s",
        F.when(F.size("sketch_s") > 0, spent / F.size("sketch_s")).otherwise(F.lit(0.0)).alias("avg_sketch_s"),
        (F.col("preprocess_s") + spent).alias("total_s"), "sigma_k1", "spectral_error", "errors", "change_at")
    last = steps.where(F.col("step") == sched.last).select("sigma", "v").first()
    return SlidingResult(scores, model, stats, sched, np.array(last["sigma"]), np.array(last["v"]).T, [], [])


def _sliding_long(rows: DataFrame, sched: Schedule, d: int, k: int, subsample: int, max_iter: int, tolerance: float,
                  calc_error: bool, q: int, subsample_norm: int, seed, dataset: str, run_path: str,
                  band_steps: int | None) -> SlidingResult:
    """The sliding run on chunk moments, written band by band under ``run_path`` and resumed from its last whole band."""
    spark = rows.sparkSession
    if live_state_bytes(sched, d) > LIVE_STATE_BYTES:
        raise ValueError("the chunks of a window do not fit on the driver: use a larger stride")
    band = band_steps or max(1, DRIVER_STATE_BYTES // (2 * d * d * 8))
    at_once = max(1, BAND_READ_BYTES // (band * 2 * d * d * 8))   # bands whose moments are read together
    width = sched.last + 1
    settings = json.dumps([sched.n, sched.block, sched.stride, sched.max_slides, d, k, subsample, max_iter, tolerance, calc_error, q,
                           subsample_norm, str(seed), band, at_once])
    if path_exists(spark, f"{run_path}/settings/_SUCCESS"):
        if spark.read.text(f"{run_path}/settings").first()[0] != settings:
            raise ValueError(f"{run_path} holds a run with other settings")
    else:
        spark.createDataFrame([(settings,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{run_path}/settings")
    moments_path = f"{run_path}/moments"
    if not path_exists(spark, f"{moments_path}/_SUCCESS"):
        at = F.floor(F.floor(F.col("chunk") / F.lit(width)) / F.lit(band * at_once)).cast("int")
        mo.pooled_moments(rows).withColumn("bands", at).write.mode("overwrite").partitionBy("bands").parquet(moments_path)
    moments = spark.read.parquet(moments_path)

    def fetch(df):
        tbl = df.select("chunk", "part", "n", "mean", "w").toArrow().sort_by([("chunk", "ascending"), ("part", "ascending")])
        return dict(mo.whole_states(mo.moment_rows(tbl.combine_chunks().to_batches())))

    def saved(kind, bands):
        return f"{run_path}/{kind}/bands={bands[0]}-{bands[1]}"

    n_bands = -(-width // band)
    # runs of bands written together, by the first; a state is written last, so it commits its run
    runs = {bands[0]: bands for bands in (tuple(map(int, name[6:].split("-"))) for name in folder_names(spark, f"{run_path}/state"))
            if path_exists(spark, f"{saved('state', bands)}/_SUCCESS")}
    done, kept = 0, []
    while done in runs:
        kept.append(runs[done])
        done = runs[done][1] + 1
    states, S, V = {}, None, None
    if done:
        last = spark.read.parquet(saved("model", kept[-1])).where(F.col("step") == min(done * band, width) - 1) \
            .orderBy("comp").collect()
        S, V = np.array([r["sigma"] for r in last]), np.array([r["v"] for r in last]).T
        states = fetch(spark.read.parquet(saved("state", kept[-1])))
    wait = COMMIT_S if live_state_bytes(sched, d) <= COMMIT_STATE_BYTES else 0   # a large state is not held twice
    model_rows, stats_rows, held, ahead, read = [], [], None, {}, -1

    def commit():
        nonlocal held
        if held is not None:
            bands = (done, held[0])
            spark.createDataFrame(model_rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(saved("model", bands))
            spark.createDataFrame(stats_rows, STATS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(saved("stats", bands))
            spark.createDataFrame(pa.Table.from_batches(mo.state_batches(held[1]), mo.MOMENTS_ARROW)).write.mode("overwrite") \
                .parquet(saved("state", bands))
            kept.append(bands)
            model_rows.clear()
            stats_rows.clear()
            held = None
        return kept[-1][1] + 1 if kept else 0

    since = time.perf_counter()
    try:
        for b in range(done, n_bands):
            if b // at_once != read:
                read = b // at_once
                ahead = collections.deque(sorted(fetch(moments.where(F.col("bands") == read)).items()))
                while ahead and ahead[0][0] // width < b * band:   # of bands that are done
                    ahead.popleft()
            steps = range(b * band, min((b + 1) * band, width))
            while ahead and ahead[0][0] // width < steps.stop:
                c, state = ahead.popleft()
                states[c] = state
            bounds = {c: (c // width, c % width) for c in states}
            models, stats, S, V = advance(states, bounds, steps, d, k, subsample, max_iter, tolerance, calc_error, q,
                                          subsample_norm, seed, S, V, enter_lo=lambda t: int(sched.steps[t][3]), dataset=dataset)
            model_rows += [(t, c, float(Sm[c]), [float(x) for x in Vm[:, c]]) for t, (Sm, Vm) in zip(steps, models) for c in range(k)]
            stats_rows += stats
            held = b, {c: list(state) for c, state in states.items()}   # steps put new arrays into a state
            if time.perf_counter() - since >= wait:
                done, since = commit(), time.perf_counter()
    finally:
        commit()
    model = spark.read.schema(MODEL_SCHEMA).parquet(*[saved("model", bands) for bands in kept])
    stats = spark.read.schema(STATS_SCHEMA).parquet(*[saved("stats", bands) for bands in kept])
    comps = model.groupBy("step").agg(F.transform(F.sort_array(F.collect_list(F.struct("comp", "v"))), lambda c: c["v"]).alias("comps"))
    if width * d * k * 8 <= BROADCAST_MODEL_BYTES:
        comps = F.broadcast(comps)
    return SlidingResult(_scored(rows, sched, comps), model, stats, sched, S, V, [], [])


def _sliding_rows(rows: DataFrame, sched: Schedule, d: int, k: int, subsample: int, max_iter: int,
                  tolerance: float, calc_error: bool, q: int, subsample_norm: int, seed, dataset: str) -> SlidingResult:
    """The sliding run with the window kept as a DataFrame (wide rows).

    A window that fits into a task goes through one with the rows of the next steps, ``ROW_BAND_BYTES``
    of them; a larger one is read by distributed passes at every step.
    """
    spark = rows.sparkSession
    raw = rows.select(ROW_ID, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)   # read again at every step or band
    run = _row_bands if sched.block * d * 8 <= WINDOW_STATE_BYTES else _row_passes
    models, stats_rows = run(raw, sched, d, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed, dataset)
    S, V = models[-1]
    raw.unpersist(blocking=False)
    model_rows = [(t, c, float(Sm[c]), [float(x) for x in Vm[:, c]])
                  for t, (Sm, Vm) in enumerate(models) for c in range(k)]
    return SlidingResult(score_by_step(rows, sched, models, spark),
                         spark.createDataFrame(model_rows, MODEL_SCHEMA),
                         spark.createDataFrame(stats_rows, STATS_SCHEMA), sched, S, V, models, stats_rows)


def _row_bands(raw: DataFrame, sched: Schedule, d: int, k: int, subsample: int, max_iter: int, tolerance: float,
               calc_error: bool, q: int, subsample_norm: int, seed, dataset: str):
    """Models and statistics, step by step, from bands of steps: a task gets the window and the band's rows in order.

    It deflates and sketches the rows themselves (nothing of d x d) and sends on the steps' models and the
    window, which is written to the shared folder for the next band.
    """
    spark, rid = raw.sparkSession, F.col(ROW_ID)
    band = max(1, ROW_BAND_BYTES // (sched.stride * d * 8))
    numbers = pa.list_(pa.float64())
    schema = pa.schema([(ROW_ID, pa.int64()), (FEATURES, numbers), ("step", pa.int32()), ("s", numbers), ("v", numbers),
                        ("n_rows", pa.int64()), ("n_iter", pa.int32()), ("preprocess_s", pa.float64()), ("sketch_s", numbers),
                        ("sigma_k1", pa.float64()), ("spectral_error", pa.float64()), ("errors", numbers),
                        ("change_at", pa.list_(pa.int64()))])
    sql = (f"{ROW_ID} BIGINT, {FEATURES} ARRAY<DOUBLE>, step INT, s ARRAY<DOUBLE>, v ARRAY<DOUBLE>, n_rows BIGINT, n_iter INT, "
           "preprocess_s DOUBLE, sketch_s ARRAY<DOUBLE>, sigma_k1 DOUBLE, spectral_error DOUBLE, errors ARRAY<DOUBLE>, "
           "change_at ARRAY<BIGINT>")

    def run(steps, at, S, V):
        def of(batches):
            window = WindowRows(_dense_rows(batches, at, d), sched)
            if steps[0]:
                lo, hi = sched.window(steps[0] - 1)
                window.hold(hi - lo)
            made, model = [], (S, V)
            for t in steps:
                t0 = time.perf_counter()
                window.move(t, model[1])
                prep = time.perf_counter() - t0
                res = sketch_from_matrix(window.window, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed,
                                         salt=2 * t)
                change_at = []
                if t == 0:
                    model = res.S[:k].copy(), res.V.copy()
                else:
                    *model, swapped = replace_component(*model, res.S, res.V, k)
                    if swapped:
                        change_at.append(int(sched.steps[t][3]))
                rest = window.window - (window.window @ model[1]) @ model[1].T
                spec = sketch_from_matrix(rest, 1, 1, max_iter=10, seed=seed, salt=2 * t + 1)
                made.append((None, None, t, model[0].tolist(), model[1].reshape(-1).tolist(), int(res.n_rows), res.n_iter,
                             prep + res.preprocess_s, [float(x) for x in res.sketch_s], float(res.sigma_k1), float(spec.S[0]),
                             [float(e) for e in res.errors], change_at))
                if len(made) * d * k >= MODEL_BATCH_CELLS or t == steps[-1]:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in made], schema)
                    made = []
            first, n = sched.window(steps[-1])[0], max(1, MODEL_BATCH_CELLS // d)
            for i in range(0, len(window.window), n):
                Y = window.window[i:i + n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first + i, first + i + len(Y))), from_matrix(Y),
                     *[pa.nulls(len(Y), field.type) for field in list(schema)[2:]]], schema=schema)

        return of

    S, V = None, np.zeros((d, k))
    models, stats_rows, window, path = [], [], None, None
    for t0 in range(0, sched.last + 1, band):
        steps = range(t0, min(t0 + band, sched.last + 1))
        lo, hi = sched.steps[steps[0]][3], sched.steps[steps[-1]][4]
        part = raw.where((rid >= F.lit(lo)) & (rid < F.lit(hi)))
        part = part if window is None else window.unionByName(part)
        at = sched.window(t0 - 1)[0] if t0 else 0
        before, path = path, scratch_path(spark, "row-band")
        part.repartition(1).sortWithinPartitions(ROW_ID).mapInArrow(run(steps, at, S, V), sql).write.parquet(path)
        if before is not None:
            drop_path(spark, before)
        out = spark.read.schema(sql).parquet(path)
        for r in out.where(F.col("step").isNotNull()).orderBy("step").drop(ROW_ID, FEATURES).collect():
            S, V = np.array(r["s"]), np.array(r["v"]).reshape(d, k)
            models.append((S, V))
            stats_rows.append((r["step"], r["step"] + 1, "matstream", dataset, r["n_rows"], int(d), r["n_iter"], r["preprocess_s"],
                               r["sketch_s"], sum(r["sketch_s"]) / len(r["sketch_s"]) if r["sketch_s"] else 0.0,
                               r["preprocess_s"] + sum(r["sketch_s"]), r["sigma_k1"], r["spectral_error"], r["errors"],
                               r["change_at"]))
        window = out.where(F.col("step").isNull()).select(ROW_ID, FEATURES)
    drop_path(spark, path)
    return models, stats_rows


def _row_passes(raw: DataFrame, sched: Schedule, d: int, k: int, subsample: int, max_iter: int, tolerance: float,
                calc_error: bool, q: int, subsample_norm: int, seed, dataset: str):
    """Models and statistics, step by step, from distributed passes over the window of every step."""
    from matstream.operators.rows import deflate
    from matstream.plans.sketch import sketch_from_rows
    from matstream.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(raw.sparkSession)
    rid = F.col(ROW_ID)
    window = raw.where(rid < F.lit(sched.block)).checkpoint(eager=True)
    S, V = None, np.zeros((d, k))
    models, stats_rows = [], []
    for t in range(sched.last + 1):
        t0 = time.perf_counter()
        if t > 0:
            _, _, drop_hi, enter_lo, enter_hi = sched.steps[t]
            incoming = raw.where((rid >= F.lit(enter_lo)) & (rid < F.lit(enter_hi)))
            window = deflate(window.where(rid >= F.lit(drop_hi)).unionByName(incoming), V) \
                .checkpoint(eager=True)   # lineage cut on the shared checkpoint folder
        prep = time.perf_counter() - t0
        res = sketch_from_rows(window, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed,
                               salt=2 * t)
        change_at = []
        if t == 0:
            S, V = res.S[:k].copy(), res.V.copy()
        else:
            S, V, swapped = replace_component(S, V, res.S, res.V, k)
            if swapped:
                change_at.append(int(sched.steps[t][3]))
        spec = sketch_from_rows(deflate(window, V), 1, 1, max_iter=10, seed=seed, salt=2 * t + 1)
        models.append((S.copy(), V.copy()))
        pre = prep + res.preprocess_s
        stats_rows.append((t, t + 1, "matstream", dataset, int(res.n_rows), int(d), res.n_iter, pre,
                           [float(x) for x in res.sketch_s], res.avg_sketch_s, pre + sum(res.sketch_s),
                           float(res.sigma_k1), float(spec.S[0]), [float(e) for e in res.errors], change_at))
    return models, stats_rows


def run_recursion(states: dict, sched: Schedule, d: int, k: int, subsample: int, max_iter: int = 1,
                  tolerance: float = 0.05, calc_error: bool = False, q: int = 10, subsample_norm: int = 1,
                  seed="validation", dataset: str = "", moments_s: float = 0.0):
    """The sequential recursion over steps on chunk moments (driver or one small group).

    ``states``: chunk -> [n, mean, within-chunk centred Gram]; updated in place.
    Returns the model ``(S, V)`` after every step and the stats rows.
    """
    bounds = {c: (first, last) for c, lo, hi, first, last in sched.chunk_bounds()}
    models, stats_rows, _, _ = advance(states, bounds, range(sched.last + 1), d, k, subsample, max_iter,
                                       tolerance, calc_error, q, subsample_norm, seed,
                                       enter_lo=lambda t: int(sched.steps[t][3]), dataset=dataset,
                                       moments_s=moments_s)
    return models, stats_rows


def advance(states: dict, bounds: dict, steps, d: int, k: int, subsample: int, max_iter: int = 1,
            tolerance: float = 0.05, calc_error: bool = False, q: int = 10, subsample_norm: int = 1,
            seed="validation", S=None, V=None, enter_lo=None, dataset: str = "", moments_s: float = 0.0):
    """Run the given steps of the recursion from ``(S, V)``; ``bounds``: chunk -> (first, last) step.

    Chunk states must already carry the deflations of the steps before the
    first one run here; chunks that left the window are dropped from
    ``states``.  Returns ``(models, stats_rows, S, V)``.
    """
    order = sorted(bounds)   # along the rows both ends only grow, so the live chunks are one moving range
    at = [0, 0]

    def live(t):
        if isinstance(states, _BandedStates):
            states.ensure(t)
        while at[1] < len(order) and bounds[order[at[1]]][0] <= t:
            at[1] += 1
        while at[0] < at[1] and bounds[order[at[0]]][1] < t:
            states.pop(order[at[0]], None)   # left the window
            at[0] += 1
        return [states[c] for c in order[at[0]:at[1]] if c in states]

    models, stats_rows = [], []
    for S, V, row in iter_steps(chunk_grams(live), steps, d, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm, seed,
                                S, V, enter_lo, dataset, moments_s):
        models.append((S.copy(), V.copy()))
        stats_rows.append(row)
    return models, stats_rows, S, V


class StreamedChunks:
    """The live chunks of a window, taken from an iterator of ``(chunk, state)`` in chunk order as steps need them.

    Chunk ids are ``first * width + last`` (:meth:`Schedule.chunk`), so a
    chunk's first and last step are read off its id and only live chunks are held.
    """

    def __init__(self, chunks, width: int):
        self.chunks, self.width = chunks, width
        self.window: collections.deque = collections.deque()
        self.ahead = next(chunks, None)

    def __call__(self, t: int) -> list:
        while self.ahead is not None and self.ahead[0] // self.width <= t:
            if self.window and self.window[-1][0] >= self.ahead[0]:
                raise ValueError("chunks are out of order")
            self.window.append(self.ahead)
            self.ahead = next(self.chunks, None)
        while self.window and self.window[0][0] % self.width < t:
            self.window.popleft()
        return [state for _, state in self.window]


def chunk_grams(live):
    """``gram(t, V)`` of :func:`iter_steps` over chunk moments; ``live(t)`` gives the window's chunk states in row order."""
    def gram(t, V):
        window = live(t)
        if t > 0:
            for st in window:  # the whole window is deflated by the current V
                st[1] = la.deflate_vec(st[1], V)
                st[2] = la.deflate_gram(st[2], V)
        n, _, C = la.pooled_gram(window)
        return n, C

    return gram


class WindowRows:
    """``gram(t, V)`` of :func:`iter_steps` over rows in order: holds the window's deflated rows and nothing else.

    ``entering`` keeps the raw rows of the step for their scores.
    """

    def __init__(self, batches, sched: Schedule):
        self.batches, self.sched = batches, sched
        self.window = self.entering = None
        self.ahead: list[np.ndarray] = []

    def _take(self, n: int) -> np.ndarray:
        have = sum(len(a) for a in self.ahead)
        while have < n:
            rows = next(self.batches)
            have += len(rows)
            self.ahead.append(rows)
        all_rows = np.concatenate(self.ahead) if len(self.ahead) > 1 else self.ahead[0]
        self.ahead = [all_rows[n:]]
        return all_rows[:n]

    def hold(self, n: int) -> None:
        """Take the next ``n`` rows for the window of the step before, as they are."""
        self.window = self._take(n)

    def move(self, t: int, V: np.ndarray) -> None:
        _, drop_lo, drop_hi, enter_lo, enter_hi = self.sched.steps[t]
        self.entering = self._take(enter_hi - enter_lo)
        if t == 0:
            self.window = self.entering.copy()
        else:
            self.window = np.concatenate([self.window[drop_hi - drop_lo:], self.entering])
            self.window -= (self.window @ V) @ V.T

    def __call__(self, t: int, V: np.ndarray):
        self.move(t, V)
        Yc = self.window - self.window.mean(axis=0)
        return len(Yc), Yc.T @ Yc


def iter_steps(gram, steps, d: int, k: int, subsample: int, max_iter: int = 1, tolerance: float = 0.05,
               calc_error: bool = False, q: int = 10, subsample_norm: int = 1, seed="validation", S=None, V=None,
               enter_lo=None, dataset: str = "", moments_s: float = 0.0):
    """Run steps one by one from ``(S, V)``: yields ``(S, V, stats row)`` after each and keeps nothing behind it.

    ``gram(t, V)`` moves the window to step ``t``, deflates it by ``V`` (not at step 0) and gives its
    row count and centred Gram.
    """
    V = np.zeros((d, k)) if V is None else V
    for t in steps:
        t0 = time.perf_counter()
        n_w, C = gram(t, V)
        prep = time.perf_counter() - t0
        res = sketch_from_gram(C, n_w, k, subsample, max_iter, tolerance, calc_error, q, subsample_norm,
                               seed, salt=2 * t)
        change_at = []
        if t == 0:
            S, V = res.S[:k].copy(), res.V.copy()
        else:
            S, V, swapped = replace_component(S, V, res.S, res.V, k)
            if swapped:
                change_at.append(int(enter_lo(t)))
        spec = window_spectral_error(C, n_w, V, seed, salt=2 * t + 1)
        pre = prep + (moments_s if t == 0 else 0.0)
        yield S, V, (t, t + 1, "matstream", dataset, int(n_w), int(d), res.n_iter, pre,
                     [float(x) for x in res.sketch_s], res.avg_sketch_s, pre + sum(res.sketch_s),
                     float(res.sigma_k1), float(spec), [float(e) for e in res.errors], change_at)


def score_by_step(rows: DataFrame, sched: Schedule, models: list, spark: SparkSession) -> DataFrame:
    """P11 per step: raw row times the model of the step the row entered at (JVM dot products)."""
    comps = [(t, [[float(x) for x in Vm[:, c]] for c in range(Vm.shape[1])]) for t, (_, Vm) in enumerate(models)]
    table = spark.createDataFrame(comps, "step INT, comps ARRAY<ARRAY<DOUBLE>>")
    d, k = models[0][1].shape
    size = len(models) * d * k * 8
    if size <= BROADCAST_MODEL_BYTES:   # the model table is (steps x d x k) doubles: size known here
        table = F.broadcast(table)
    return _scored(rows, sched, table)


def _scored(rows: DataFrame, sched: Schedule, comps: DataFrame) -> DataFrame:
    entered = rows.select(ROW_ID, FEATURES, sched.first_step(F.col(ROW_ID)).alias("step"))
    joined = entered.join(comps, "step")
    scores = F.transform("comps", lambda v: F.aggregate(F.zip_with(FEATURES, v, lambda a, b: a * b),
                                                        F.lit(0.0), lambda acc, x: acc + x))
    return joined.select(ROW_ID, "step", scores.alias("scores"))


def change_points(stats: DataFrame) -> DataFrame:
    """The row position of every swap (first row id of its step)."""
    return stats.select("step", F.explode("change_at").alias("row_id"))


def _keyed_schedule_cols(n: "F.Column", block: int, stride: int, max_slides: int | None):
    """Per-key ``T`` (last step) and the last step's drop bound, as expressions of the key's row count."""
    T = F.ceil((n - F.lit(block)) / F.lit(stride)).cast("int")
    if max_slides is not None:
        T = F.least(T, F.lit(max_slides))
    last_lo = F.lit(block) + (T - 1) * F.lit(stride)
    st = F.least(F.lit(stride), n - last_lo)
    ldh = F.when(T > 0, (T - 1) * F.lit(stride) + st).otherwise(F.lit(0))
    end = F.when(T > 0, last_lo + st).otherwise(F.lit(block))
    return T, ldh, end


PREFIX_GRID = [min(1.0, 1e-6 * 2 ** i) for i in range(21)]   # quantile levels tried per key
PREFIX_ACCURACY = 1000


def _key_prefixes(base: DataFrame, keys: list[str], need: int):
    """Trim every key to the rows a capped run reads: those ordered at or below a per-key threshold.

    One aggregate gives each key's count and approximate quantiles at the
    levels of ``PREFIX_GRID``; the threshold is the lowest level above
    ``need / n`` plus the sketch's rank error.  A key whose kept rows fall
    short of ``min(need, n)`` keeps all its rows, so ids stay exact ranks.
    Rows with a null order key are kept for the numbering to reject.  Returns
    the trimmed rows and the per-key table ``keys..., _n``.
    """
    from pyspark.sql import types as T

    if not isinstance(base.schema["_ord"].dataType, (T.NumericType, T.DateType, T.TimestampType,
                                                     T.TimestampNTZType)):
        return base, base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    grid = F.array(*[F.lit(p) for p in PREFIX_GRID])
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_ord", PREFIX_GRID, PREFIX_ACCURACY).alias("_qs"))
    p_need = F.lit(float(need)) / F.col("_n") + F.lit(2.0 / PREFIX_ACCURACY)
    levels = F.filter(F.arrays_zip(grid.alias("p"), F.col("_qs").alias("q")), lambda z: z["p"] >= p_need)
    level = F.element_at(levels, 1)
    thr = F.when((p_need < 1.0) & (level["p"] < 1.0), level["q"])   # level 1.0 keeps the whole key
    stats = written(stats.select(*keys, "_n", thr.alias("_thr")), "key-prefix")
    if not stats.where(F.col("_thr").isNotNull()).limit(1).count():
        return base, stats.select(*keys, "_n")   # no key is long enough to trim
    kept = base.join(stats, keys).where(F.col("_thr").isNull() | F.col("_ord").isNull() | (F.col("_ord") <= F.col("_thr")))
    short = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).join(stats, keys) \
        .where(F.col("_k") < F.least(F.lit(need), F.col("_n"))).select(*keys)
    if short.limit(1).count():
        stats = stats.join(short.withColumn("_short", F.lit(True)), keys, "left") \
            .select(*keys, "_n", F.when(F.col("_short").isNull(), F.col("_thr")).alias("_thr"))
        kept = base.join(stats, keys).where(F.col("_thr").isNull() | F.col("_ord").isNull() | (F.col("_ord") <= F.col("_thr")))
    return kept.select(base.columns), stats.select(*keys, "_n")


MAX_BROADCAST_KEYS = 500_000  # of five numbers and the key


def skipped_keys(df: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The keys that :func:`sliding_pca_by_key` cannot run (too few rows for a block, or a null key): ``keys..., n_rows``."""
    some_null = functools.reduce(operator.or_, [F.col(c).isNull() for c in keys])
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.where((F.col("n_rows") < block) | some_null)


def sliding_pca_by_key(df: DataFrame, keys: list[str], k: int, block: int, stride: int, subsample: int,
                       max_iter: int = 1, max_slides: int | None = None, tolerance: float = 0.05,
                       calc_error: bool = False, q: int = 10, subsample_norm: int = 1, seed="validation",
                       order_by: str = ROW_ID, col: str = FEATURES) -> DataFrame:
    """:func:`sliding_pca` run independently for every key (the scale-out form).

    Rows are numbered within each key by ``order_by`` (range partitioning on
    ``(key, order)``, so a hot key is spread over many tasks), tagged with
    chunk ids from the key's own schedule, and reduced to chunk moments by
    Spark in one scan (:func:`pooled_moments`).  The moments of a key, sorted by
    chunk, stream through its recursion, which holds the window's live chunks
    only and sends every step's model on: task memory doesn't grow with the
    key's rows or slides, however many steps it has.  Keys with fewer
    than ``block`` rows or a null in them have no run; :func:`skipped_keys` names them with their rows.  Output: the scores ``keys..., row_id,
    step, scores`` of every scheduled row (``row_id`` dense within the key).
    """
    from matstream.operators.rowid import with_row_id

    base = df.select(*keys, F.col(order_by).alias("_ord"), F.col(col).cast("array<double>").alias(FEATURES))
    if max_slides is None:
        per_key = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    else:
        # one row per key: its true row count (the schedule depends on it) and, for orderable keys, a
        # key threshold below which its first block + max_slides * stride rows lie (the rest is never read)
        base, per_key = _key_prefixes(base, keys, block + max_slides * stride)
    numbered = with_row_id(base, "_ord", id_col=ROW_ID, partition_by=keys)
    per_key = with_row_id(per_key.where(F.col("_n") >= block), keys, id_col="gid")
    T, ldh, end = _keyed_schedule_cols(F.col("_n"), block, stride, max_slides)
    per_key = written(per_key.select(*keys, "gid", "_n", T.alias("_T"), ldh.alias("_ldh"), end.alias("_end")), "keys")
    n_keys, t_max = per_key.agg(F.count(F.lit(1)), F.coalesce(F.max("_T"), F.lit(0))).first()
    span = (t_max + 1) ** 2   # chunk ids of one key
    if n_keys * span >= 1 << 63:
        raise ValueError(f"{n_keys} keys of up to {t_max} slides: chunk ids would not fit into a BIGINT")
    rid = F.col(ROW_ID)
    first = F.when(rid < F.lit(block), F.lit(0)).otherwise(
        F.floor((rid - F.lit(block)) / F.lit(stride)).cast("int") + F.lit(1))
    last = F.when(rid >= F.col("_ldh"), F.col("_T")).otherwise(
        F.least(F.floor(rid / F.lit(stride)).cast("int"), F.greatest(F.col("_T") - 1, F.lit(0))))
    few = F.broadcast(per_key) if n_keys <= MAX_BROADCAST_KEYS else per_key  # a hot key's rows then stay where they are
    rows = (numbered.join(few, keys).where(rid < F.col("_end"))
            .select(*keys, "gid", ROW_ID, FEATURES, first.alias("step"),
                    (F.col("gid") * F.lit(span) + first.cast("long") * (F.col("_T") + 1) + last).alias("gchunk")))
    moments = mo.pooled_moments(rows, "gchunk").select(F.expr(f"chunk div {span}").alias("gid"),
                                                       (F.col("chunk") % F.lit(span)).alias("chunk"), "part", "n", "mean", "w")
    few = per_key.select("gid", "_n")
    moments = moments.join(F.broadcast(few) if n_keys <= MAX_BROADCAST_KEYS else few, "gid") \
        .select("gid", "_n", "chunk", "part", "n", "mean", "w")
    params = dict(k=k, subsample=subsample, max_iter=max_iter, tolerance=tolerance, calc_error=calc_error, q=q,
                  subsample_norm=subsample_norm, seed=seed)

    def by_key(batches):
        def rows_of():
            for b in batches:
                gid, n_key = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                part = pa.RecordBatch.from_arrays([b.column(c) for c in range(2, 7)],
                                                  names=["chunk", "part", "n", "mean", "w"])
                for r, row in enumerate(mo.moment_rows([part])):
                    yield int(gid[r]), int(n_key[r]), row

        held = []
        for (gid, n_key), group in itertools.groupby(rows_of(), key=lambda r: r[:2]):
            sched = window_schedule(n_key, block, stride, max_slides)
            chunks = StreamedChunks(mo.whole_states(r[2] for r in group), sched.last + 1)
            width = len(chunks.ahead[1][1])
            for _, V, row in iter_steps(chunk_grams(chunks), range(sched.last + 1), width, enter_lo=lambda t: 0, **params):
                held.append((gid, row[0], V.T.tolist()))
                if len(held) * width * k >= MODEL_BATCH_CELLS:
                    yield _models_batch(held)
                    held = []
        if held:
            yield _models_batch(held)

    models = moments.repartition("gid").sortWithinPartitions("gid", "chunk", "part").mapInArrow(
        by_key, "gid LONG, step INT, comps ARRAY<ARRAY<DOUBLE>>")
    # written once: the scores read the models of a long key by a join that adaptive execution can split
    models = written(models, "key-models")
    joined = rows.join(models, ["gid", "step"])
    scores = F.transform("comps", lambda v: F.aggregate(F.zip_with(FEATURES, v, lambda a, b: a * b),
                                                        F.lit(0.0), lambda acc, x: acc + x))
    return joined.select(*keys, ROW_ID, "step", scores.alias("scores"))


MODEL_BATCH_CELLS = 1 << 20


def _models_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.float64())))], names=["gid", "step", "comps"])
