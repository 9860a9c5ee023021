import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from matstream.plans.sliding import sliding_pca
from matstream.sources.frames import from_array
from matstream.streaming.stream import StreamPCA, stream_pca, stream_score


def _split(spark, tmp_dir, rows_per_file=70):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for j, i in enumerate(range(0, 500, rows_per_file)):
        part = os.path.join(tmp_dir, f"p{j}")
        emb.where((F.col("vec_id") >= i) & (F.col("vec_id") < i + rows_per_file)).coalesce(1).write.parquet(part)
        f = glob.glob(f"{part}/*.parquet")[0]
        dst = os.path.join(src, f"f{j:03d}.parquet")
        shutil.copy(f, dst)
        os.utime(dst, (1_000_000 + 10 * j, 1_000_000 + 10 * j))  # the file source orders by time
    return emb, src


def test_stream_equals_batch_and_replay_is_noop(spark, tmp_dir):
    emb, src = _split(spark, tmp_dir)
    stream = spark.readStream.schema(emb.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = stream.select(F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("features"))
    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    q, runner = stream_pca(rows, "ord", out, state, k=3, block=97, stride=41, subsample=2, max_iter=3)
    q.awaitTermination()
    runner.finish()
    got = runner.scores().orderBy("row_id").toPandas()
    res = sliding_pca(from_array(emb, "embedding", row_id="vec_id"), k=3, block=97, stride=41, subsample=2,
                      max_iter=3, max_slides=None)
    want = res.scores.orderBy("row_id").toPandas()
    assert list(got.row_id) == list(want.row_id)
    assert np.abs(np.array(list(got.scores)) - np.array(list(want.scores))).max() < 1e-10
    # a replayed batch id changes nothing
    before = runner.load()[0]
    again = StreamPCA(spark, out, state, "ord", 3, 97, 41, 2, 3)
    again.process(spark.createDataFrame([(10_000, [0.0] * 64)], "ord long, features array<double>"), 0)
    after = again.load()[0]
    assert (after.batch_id, after.t_done, after.next_row_id) == (before.batch_id, before.t_done, before.next_row_id)


def test_late_rows_go_to_side_table(spark, tmp_dir):
    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    r = StreamPCA(spark, out, state, "ord", 2, 30, 10, 2)
    rng = np.random.default_rng(0)
    mk = lambda ords: spark.createDataFrame([(int(o), rng.standard_normal(8).tolist()) for o in ords],
                                            "ord long, features array<double>")
    r.process(mk(range(100, 140)), 0)
    r.process(mk(list(range(140, 160)) + [5, 6]), 1)
    st = r.load()[0]
    assert st.late_rows == 2 and st.next_row_id == 60
    assert spark.read.parquet(os.path.join(out, "late")).count() == 2


def test_stream_score_equals_batch(spark, emb_rows, emb_matrix, tmp_dir):
    V, _ = np.linalg.qr(np.random.default_rng(9).standard_normal((64, 2)))
    emb, src = _split(spark, tmp_dir, 200)
    stream = spark.readStream.schema(emb.schema).parquet(src)
    rows = stream.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))
    outp = os.path.join(tmp_dir, "scores")
    q = (stream_score(rows, V).writeStream.format("parquet").option("path", outp)
         .option("checkpointLocation", outp + "_ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(outp).orderBy("row_id").toPandas()
    assert np.allclose(np.array(list(got.scores)), emb_matrix @ V)


def test_stream_with_banded_driver_state(spark, tmp_dir, monkeypatch):
    import matstream.plans.sliding as sl

    monkeypatch.setattr(sl, "DRIVER_STATE_BYTES", 2 * 64 * 64 * 8)   # one entry step per band
    emb, src = _split(spark, tmp_dir, 250)
    stream = spark.readStream.schema(emb.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = stream.select(F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("features"))
    q, runner = stream_pca(rows, "ord", os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state"),
                           k=2, block=80, stride=30, subsample=2, max_iter=2)
    q.awaitTermination()
    runner.finish()
    got = runner.scores().orderBy("row_id").toPandas()
    res = sliding_pca(from_array(emb, "embedding", row_id="vec_id"), k=2, block=80, stride=30, subsample=2,
                      max_iter=2, max_slides=None)
    want = res.scores.orderBy("row_id").toPandas()
    assert np.abs(np.array(list(got.scores)) - np.array(list(want.scores))).max() < 1e-10


def test_capped_stream_keeps_bounded_state(spark, tmp_dir):
    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    r = StreamPCA(spark, out, state, "ord", 1, 30, 10, 1, max_slides=2)
    rng = np.random.default_rng(1)
    mk = lambda lo, hi: spark.createDataFrame([(int(o), rng.standard_normal(6).tolist()) for o in range(lo, hi)],
                                              "ord long, features array<double>")
    for b, lo in enumerate(range(0, 400, 80)):
        r.process(mk(lo, lo + 80), b)
    st, rows = r.load()
    assert st.t_done == 2 and st.next_row_id == 400
    assert rows.count() == 30                       # the final window only: rows 20..49
    assert r.scores().count() == 50                 # block + 2 strides scored, as the batch run with the cap


def test_stream_batches_release_their_cache(spark, tmp_dir):
    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    r = StreamPCA(spark, out, state, "ord", 1, 30, 10, 1)
    rng = np.random.default_rng(2)
    mk = lambda lo, hi: spark.createDataFrame([(int(o), rng.standard_normal(6).tolist()) for o in range(lo, hi)],
                                              "ord long, features array<double>")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    for b, lo in enumerate(range(0, 240, 60)):
        r.process(mk(lo, lo + 60), b)
    after = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert after - before <= 2     # nothing per batch is left cached


def test_late_rows_with_a_timestamp_order(spark, tmp_dir):
    import datetime as dt

    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    r = StreamPCA(spark, out, state, "ts", 1, 20, 10, 1)
    rng = np.random.default_rng(4)
    t0 = dt.datetime(2024, 1, 1)
    mk = lambda secs: spark.createDataFrame([(t0 + dt.timedelta(seconds=int(x)), rng.standard_normal(5).tolist())
                                             for x in secs], "ts timestamp_ntz, features array<double>")
    r.process(mk(range(100, 130)), 0)
    r.process(mk(list(range(130, 150)) + [3]), 1)
    st = r.load()[0]
    assert st.late_rows == 1 and st.next_row_id == 50 and st.t_done == 3


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_late_rows_do_not_depend_on_the_session_zone(spark, tmp_dir, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    rng = np.random.default_rng(1)

    def mk(seconds):
        rows = [(1_700_000_000 + s, rng.standard_normal(8).tolist()) for s in seconds]
        return spark.createDataFrame(rows, "s long, features array<double>").select(
            F.timestamp_seconds("s").alias("ts"), "features")

    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        r = StreamPCA(spark, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state"), "ts", 2, 30, 10, 2)
        r.process(mk(range(0, 70)), 0)
        r.process(mk([*range(70, 140), *range(0, 10)]), 1)
        st = r.load()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (st.next_row_id, st.late_rows) == (140, 10)


def test_rows_after_finish_raise_and_old_state_goes(spark, tmp_dir):
    out, state = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state")
    r = StreamPCA(spark, out, state, "ord", 2, 30, 10, 2)
    rng = np.random.default_rng(2)
    mk = lambda ords: spark.createDataFrame([(int(o), rng.standard_normal(8).tolist()) for o in ords],
                                            "ord long, features array<double>")
    for b in range(4):
        r.process(mk(range(20 * b, 20 * b + 20)), b)
    r.process(mk(range(80, 85)), 4)
    r.finish()
    r.finish()
    assert sorted(x.row_id for x in r.scores().select("row_id").collect()) == list(range(85))
    assert len(glob.glob(f"{state}/v=*")) == 2
    r.process(mk(range(80, 85)), 4)       # a replay is still nothing
    r.process(mk([]), 5)                  # nor is an empty batch
    with pytest.raises(ValueError, match="finished"):
        r.process(mk(range(85, 120)), 5)


def test_a_table_in_a_folder_of_unordered_files_streams_whole(spark, emb_matrix, tmp_dir):
    from matstream.streaming.stream import stream_pca_table, stream_score_table

    rows = [(int(i), emb_matrix[i].tolist()) for i in np.random.default_rng(3).permutation(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    folder, one = os.path.join(tmp_dir, "folder"), os.path.join(tmp_dir, "one")
    df.repartition(5).write.parquet(os.path.join(folder, "embeddings.parquet"))
    df.coalesce(1).write.parquet(os.path.join(tmp_dir, "written"))
    os.makedirs(one)
    shutil.copy(glob.glob(os.path.join(tmp_dir, "written", "*.parquet"))[0], os.path.join(one, "embeddings.parquet"))
    want = sliding_pca(from_array(df, "embedding", row_id="vec_id"), k=2, block=60, stride=20, subsample=2) \
        .scores.orderBy("row_id").toPandas()
    V = np.linalg.qr(np.random.default_rng(9).standard_normal((64, 2)))[0]
    for at in (folder, one):
        got = stream_pca_table(spark, at, "embeddings", k=2, block=60, stride=20, subsample=2).orderBy("row_id").toPandas()
        assert list(got.row_id) == list(want.row_id)
        assert np.abs(np.array(list(got.scores)) - np.array(list(want.scores))).max() < 1e-10
        got = stream_score_table(spark, at, "embeddings", V).orderBy("row_id").toPandas()
        assert np.allclose(np.array(list(got.scores)), emb_matrix[:300] @ V)
