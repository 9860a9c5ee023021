"""Structured Streaming forms (ST1, ST2).

ST2 :func:`stream_score` is stateless: the scores of arriving rows with a
fixed model (the same Arrow-batch product as P11 on a streaming frame).

ST1 :class:`StreamPCA` runs the sliding PCA over arriving rows in
``foreachBatch``.  Order is the micro-batch, then ``order_by`` within it.
The state is small and kept as Parquet in a versioned folder (one version
per batch id, the last two kept): the raw rows of the current window and the rows not yet in a
full step (at most ``block + stride`` rows), the model, and the models of
the steps whose deflations the window rows still carry.  Each batch:

1. a batch id at or below the committed version is a replay: no-op;
2. rows ordered below the last committed ``order_by`` are late: they go to a
   side table and are counted;
3. the batch is numbered after the rows seen so far, joined to the stored
   rows, tagged with chunks, reduced to chunk moments by Spark;
4. every full step now possible runs in the recursion (driver, d x d);
5. scores, stats and models of those steps are written to the batch's own
   partition (overwrite: a replay after a crash rewrites the same rows), then
   the new state version is written last.

The short last step runs only on :meth:`StreamPCA.finish`, which ends the run:
its outputs have a partition of their own, and a later batch that holds rows
raises instead of being taken for a replay.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matstream.operators import rows as ro
from matstream.operators.rowid import release, with_row_id
from matstream.operators.windows import window_schedule
from matstream.functions.linalg import deflate_gram
from matstream.plans.sliding import BROADCAST_MODEL_BYTES, MODEL_SCHEMA, STATS_SCHEMA, advance, banded_states
from matstream.session import scratch_path
from matstream.sources.frames import FEATURES, ROW_ID


ROWS_PER_STATE_FILE = 1_000_000
FINAL_PARTITION = -1   # output partition of the short last step
KEPT_VERSIONS = 2


def _order_text(c: Column, kind: str) -> Column:
    """An order key as text that does not depend on any time zone (timestamps: epoch microseconds)."""
    return (F.unix_micros(c) if kind == "timestamp" else c).cast("string")


def _order_literal(text: str, kind: str) -> Column:
    return F.timestamp_micros(F.lit(int(text))) if kind == "timestamp" else F.lit(text).cast(kind)


# --- ST2 -------------------------------------------------------------------------------------------

def stream_score(stream_df: DataFrame, V: np.ndarray, col: str = FEATURES) -> DataFrame:
    """ST2: score arriving rows with a fixed model ``V`` (stateless)."""
    return ro.score(stream_df, V, col)


def _table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream whose first micro-batch holds all of them.

    Files of a folder are in no order of any key: a batch a file would make rows of later files late.
    """
    schema = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")).schema
    # a pattern stands for a file as well as for a folder; a plain path has to be a folder
    return spark.readStream.schema(schema).parquet(os.path.join(sf_dir, f"{table}.parque[t]"))


def _ordered_stream(spark: SparkSession, sf_dir: str, table: str, batches: int, key: str = "vec_id") -> DataFrame:
    """A table as a stream of ``batches`` files along a key: files are written one after another, each is a batch."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    path = scratch_path(spark, "stream-source")
    step = -(-(hi - lo + 1) // batches)
    for b in range(batches):
        part = df.where((F.col(key) >= lo + b * step) & (F.col(key) < lo + (b + 1) * step))
        part.sort(key).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.format("parquet").schema(df.schema).option("maxFilesPerTrigger", 1).load(path)


def stream_score_table(spark: SparkSession, sf_dir: str, table: str, V: np.ndarray) -> DataFrame:
    """Score the ``embeddings``-like table read as a file stream; results go to a Parquet sink."""
    src = _table_stream(spark, sf_dir, table)
    rows = src.select(F.col("vec_id").cast("long").alias(ROW_ID), F.col("embedding").cast("array<double>").alias(FEATURES))
    out = scratch_path(spark, "stream-score")
    q = (stream_score(rows, V).writeStream.format("parquet").option("path", out + "/data")
         .option("checkpointLocation", out + "/_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out + "/data")


# --- ST1 -------------------------------------------------------------------------------------------

@dataclass
class _State:
    batch_id: int = -1
    t_done: int = -1
    next_row_id: int = 0
    last_order: str | None = None   # see _order_text
    S: np.ndarray | None = None
    V: np.ndarray | None = None
    history: dict = field(default_factory=dict)   # step -> V after that step
    late_rows: int = 0
    finished: bool = False

    @property
    def version(self) -> int:
        return 2 * self.batch_id + self.finished


class StreamPCA:
    """ST1: sliding PCA over a stream, driven by ``foreachBatch``."""

    def __init__(self, spark: SparkSession, out_path: str, state_path: str, order_by: str, k: int, block: int,
                 stride: int, subsample: int, max_iter: int = 1, max_slides: int | None = None,
                 seed="validation", col: str = FEATURES):
        if stride > block:
            raise ValueError("need stride <= block")
        self.spark, self.out, self.state_path = spark, out_path, state_path
        self.order_by, self.col = order_by, col
        self.k, self.block, self.stride, self.subsample = k, block, stride, subsample
        self.max_iter, self.max_slides, self.seed = max_iter, max_slides, seed

    # -- state ----------------------------------------------------------------------------------
    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.state_path)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return []
        out = []
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "meta/_SUCCESS")):
                out.append(int(name[2:]))
        return sorted(out)

    def _forget_old_versions(self) -> None:
        """Delete all but the last committed versions (what a replay may still read is kept)."""
        sc = self.spark.sparkContext
        for v in self._versions()[:-KEPT_VERSIONS]:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.state_path}/v={v}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def load(self) -> tuple[_State, DataFrame | None]:
        vs = self._versions()
        if not vs:
            return _State(), None
        base = f"{self.state_path}/v={vs[-1]}"
        meta = json.loads(self.spark.read.text(f"{base}/meta").first()[0])
        st = _State(meta["batch_id"], meta["t_done"], meta["next_row_id"], meta["last_order"],
                    late_rows=meta["late_rows"], finished=meta["finished"])
        if meta["t_done"] >= 0:
            mats = {r["step"]: r for r in self.spark.read.parquet(f"{base}/models").collect()}  # window's steps only
            for step, r in mats.items():
                st.history[step] = np.asarray(r["v"], np.float64).reshape(-1, self.k)
            last = mats[meta["t_done"]]
            st.S = np.asarray(last["sigma"], np.float64)
            st.V = st.history[meta["t_done"]]
        rows = self.spark.read.parquet(f"{base}/rows")
        return st, rows

    def _save(self, st: _State, rows: DataFrame, n_rows: int) -> None:
        base = f"{self.state_path}/v={st.version}"
        # the stored rows are at most block + stride: a few files sized by their count
        rows.coalesce(max(1, n_rows // ROWS_PER_STATE_FILE + 1)).write.mode("overwrite").parquet(f"{base}/rows")
        hist = [(int(s), [float(x) for x in st.S] if s == st.t_done else [],
                 [float(x) for x in V.reshape(-1)]) for s, V in st.history.items()]
        # models of the window's steps only: (block / stride + 2) small matrices, one file
        self.spark.createDataFrame(hist, "step INT, sigma ARRAY<DOUBLE>, v ARRAY<DOUBLE>").coalesce(1) \
            .write.mode("overwrite").parquet(f"{base}/models")
        meta = dict(batch_id=st.batch_id, t_done=st.t_done, next_row_id=st.next_row_id,
                    last_order=st.last_order, late_rows=st.late_rows, finished=st.finished)
        self.spark.createDataFrame([(json.dumps(meta),)], "value STRING").coalesce(1) \
            .write.mode("overwrite").text(f"{base}/meta")   # written last: the commit
        self._forget_old_versions()

    # -- one micro-batch --------------------------------------------------------------------------
    def process(self, batch: DataFrame, batch_id: int) -> None:
        st, stored = self.load()
        if batch_id <= st.batch_id:
            return  # replayed batch: already committed
        if st.finished:
            if batch.isEmpty():
                return
            raise ValueError("the stream was finished; start a new state folder for further rows")
        kind = batch.schema[self.order_by].dataType.simpleString()
        batch = batch.select(F.col(self.order_by).alias("_ord"), F.col(self.col).cast("array<double>").alias(FEATURES))
        if st.last_order is not None:
            seen = _order_literal(st.last_order, kind)
            late = batch.where(F.col("_ord") < seen)
            n_late = late.count()
            if n_late:
                late.write.mode("overwrite").parquet(f"{self.out}/late/batch_id={batch_id}")
            st.late_rows += n_late
            batch = batch.where(F.col("_ord").isNull() | (F.col("_ord") >= seen))   # a null is refused by the numbering
        ided = with_row_id(batch, "_ord")
        numbered = ided.withColumn(ROW_ID, F.col(ROW_ID) + F.lit(st.next_row_id))
        agg = numbered.agg(F.count(F.lit(1)).alias("n"), _order_text(F.max("_ord"), kind).alias("mx")).first()
        new = numbered.select(ROW_ID, FEATURES, "_ord")
        rows = new if stored is None else stored.unionByName(new)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        st.next_row_id += int(agg["n"])
        if agg["mx"] is not None:
            st.last_order = agg["mx"]
        steps = []
        t = st.t_done + 1
        while self.max_slides is None or t <= self.max_slides:
            hi = self.block if t == 0 else self.block + t * self.stride
            if hi > st.next_row_id:
                break
            steps.append(t)
            t += 1
        st.batch_id = batch_id
        if steps:
            end = self.block + steps[-1] * self.stride
            self._run(st, rows, steps, end, batch_id)
        lo = self._window_lo(st.t_done)
        keep = F.col(ROW_ID) >= F.lit(lo)
        hi = st.next_row_id
        if self.max_slides is not None and st.t_done >= self.max_slides:
            # the capped run is over: rows after its last step are never read, so they are not kept
            hi = self.block + st.t_done * self.stride
            keep = keep & (F.col(ROW_ID) < F.lit(hi))
        self._save(st, rows.where(keep), hi - lo)
        rows.unpersist(blocking=False)
        release(ided)   # a long-running stream must not accumulate cached batches

    def _window_lo(self, t: int) -> int:
        return 0 if t <= 0 else t * self.stride

    def _run(self, st: _State, rows: DataFrame, steps: list[int], end: int, batch_id: int,
             sched=None) -> None:
        sched = sched or window_schedule(end, self.block, self.stride, None)
        lo = self._window_lo(st.t_done)
        part = rows.where((F.col(ROW_ID) >= F.lit(lo)) & (F.col(ROW_ID) < F.lit(sched.end)))
        tagged = part.select(ROW_ID, FEATURES, sched.chunk(F.col(ROW_ID)).alias("chunk")).persist(
            StorageLevel.MEMORY_AND_DISK)
        d = tagged.select(F.size(FEATURES)).first()[0]
        source, states = banded_states(tagged, sched, d, start=sched.first_step_of(lo))
        states.ensure(max(st.t_done, 0))
        bounds = {c: (first, last) for c, _, _, first, last in sched.chunk_bounds(lo)}
        # chunks already in the window carry the deflations of the steps run before
        for c, (first, _) in bounds.items():
            if c in states and first <= st.t_done:
                for s in range(max(first, 1), st.t_done + 1):
                    Vp = st.history[s - 1]
                    states[c][1] = states[c][1] - Vp @ (Vp.T @ states[c][1])
                    states[c][2] = deflate_gram(states[c][2], Vp)
        models, stats_rows, S, V = advance(
            states, bounds, steps, d, self.k, self.subsample, self.max_iter, seed=self.seed,
            S=st.S, V=st.V, enter_lo=lambda t: sched.steps[t][3])
        for t, (Sm, Vm) in zip(steps, models):
            st.history[t] = Vm
        st.S, st.V, st.t_done = S, V, steps[-1]
        keep_from = max(sched.first_step_of(self._window_lo(st.t_done)), 1) - 1
        st.history = {s: v for s, v in st.history.items() if s >= keep_from}
        # outputs of this batch's steps, in the batch's own partition
        spark = self.spark
        model_rows = [(t, c, float(Sm[c]), [float(x) for x in Vm[:, c]])
                      for t, (Sm, Vm) in zip(steps, models) for c in range(self.k)]
        spark.createDataFrame(model_rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.out}/model/batch_id={batch_id}")
        spark.createDataFrame(stats_rows, STATS_SCHEMA).coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.out}/stats/batch_id={batch_id}")
        comps = spark.createDataFrame([(t, [[float(x) for x in Vm[:, c]] for c in range(self.k)])
                                       for t, (_, Vm) in zip(steps, models)], "step INT, comps ARRAY<ARRAY<DOUBLE>>")
        enter_lo, enter_hi = sched.steps[steps[0]][3], sched.steps[steps[-1]][4]
        entering = tagged.where((F.col(ROW_ID) >= F.lit(enter_lo)) & (F.col(ROW_ID) < F.lit(enter_hi))) \
            .select(ROW_ID, FEATURES, sched.first_step(F.col(ROW_ID)).alias("step"))
        if len(models) * self.k * d * 8 <= BROADCAST_MODEL_BYTES:
            comps = F.broadcast(comps)
        scores = F.transform("comps", lambda v: F.aggregate(F.zip_with(FEATURES, v, lambda a, b: a * b),
                                                            F.lit(0.0), lambda acc, x: acc + x))
        entering.join(comps, "step").select(ROW_ID, "step", scores.alias("scores")) \
            .write.mode("overwrite").parquet(f"{self.out}/scores/batch_id={batch_id}")
        source.release()
        tagged.unpersist(blocking=False)

    def finish(self) -> None:
        """Run the short last step over the rows left after the last full step; the run is over then."""
        st, stored = self.load()
        if stored is None or st.t_done < 0 or st.finished:
            return
        if self.max_slides is not None and st.t_done >= self.max_slides:
            return
        i = self.block + st.t_done * self.stride
        if st.next_row_id <= i:
            return
        sched = window_schedule(st.next_row_id, self.block, self.stride, None)
        t = st.t_done + 1
        self._run(st, stored, [t], sched.end, FINAL_PARTITION, sched=sched)
        st.finished = True
        self._save(st, stored.where(F.col(ROW_ID) >= F.lit(sched.steps[t][2])), st.next_row_id - sched.steps[t][2])

    # -- outputs --------------------------------------------------------------------------------
    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/scores")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/stats")

    def model(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/model")


def stream_pca(stream_df: DataFrame, order_by: str, out_path: str, state_path: str, k: int, block: int,
               stride: int, subsample: int, max_iter: int = 1, max_slides: int | None = None,
               seed="validation", col: str = FEATURES, trigger: dict | None = None):
    """ST1: start the streaming sliding PCA; returns ``(query, runner)``."""
    spark = stream_df.sparkSession
    runner = StreamPCA(spark, out_path, state_path, order_by, k, block, stride, subsample, max_iter, max_slides,
                       seed, col)
    w = stream_df.writeStream.foreachBatch(runner.process).option("checkpointLocation", f"{state_path}/_ckpt")
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start(), runner


def stream_pca_table(spark: SparkSession, sf_dir: str, table: str, k: int, block: int, stride: int,
                     subsample: int, max_iter: int = 1, max_slides: int | None = None, batches: int | None = None,
                     replay: int | None = None) -> DataFrame:
    """ST1 over a table read as a file stream, finished at the end; returns the scores.

    With ``batches`` the table arrives as that many files in the order of ``vec_id``, one a micro-batch;
    batch ``replay`` is then delivered a second time under its own id, as after a crash before the commit.
    """
    src = _table_stream(spark, sf_dir, table) if batches is None else _ordered_stream(spark, sf_dir, table, batches)
    rows = src.select(F.col("vec_id").cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias(FEATURES))
    base = scratch_path(spark, "stream-pca")
    runner = StreamPCA(spark, base + "/out", base + "/state", "ord", k, block, stride, subsample, max_iter, max_slides)

    def process(df, batch_id):
        runner.process(df, batch_id)
        if batch_id == replay:
            runner.process(df, batch_id)

    q = (rows.writeStream.foreachBatch(process).option("checkpointLocation", base + "/state/_ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    runner.finish()
    return runner.scores().select(ROW_ID, "step", "scores")
