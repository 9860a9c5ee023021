"""Runs of many steps, hot keys and wide rows: bounded state, equal results, nothing cached or dropped in silence."""

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import bruteforce as bf
from matstream.operators import moments as mo
from matstream.operators.rowid import release, with_row_id
from matstream.operators.windows import window_schedule, with_chunk
from matstream.plans.sliding import (StreamedChunks, chunk_grams, iter_steps, skipped_keys, sliding_pca, sliding_pca_by_key)
from matstream.session import clear_scratch, path_exists, scratch_path, written
from matstream.sources.frames import FEATURES, ROW_ID, read_dense_csv

SF = "/root/testdata/sf0.01"


def frame(spark, X, **cols):
    rows = [(i, [float(x) for x in r], *[c[i] for c in cols.values()]) for i, r in enumerate(X)]
    return spark.createDataFrame(rows, f"{ROW_ID} long, {FEATURES} array<double>" + "".join(f", {n} long" for n in cols))


def by_row(scores):
    return np.array([r["scores"] for r in scores.orderBy(ROW_ID).collect()])


# --- moments in one scan ---------------------------------------------------------------------

def test_pooled_moments_match_numpy_over_any_partitions(spark, emb_rows, emb_matrix):
    rows = emb_rows.withColumn("chunk", (F.col(ROW_ID) % 3).cast("long"))
    for parts in (1, 7):
        got = mo.pooled_moments(rows.repartition(parts)).toArrow().sort_by([("chunk", "ascending"), ("part", "ascending")])
        states = dict(mo.whole_states(mo.moment_rows(got.combine_chunks().to_batches())))
        for c in range(3):
            X = emb_matrix[c::3]
            n, mean, W = states[c]
            assert n == len(X) and np.allclose(mean, X.mean(axis=0), atol=1e-13)
            assert np.allclose(W, (X - X.mean(axis=0)).T @ (X - X.mean(axis=0)), atol=1e-11)


def test_pooled_moments_need_no_join_and_one_scan(emb_rows):
    plan = mo.pooled_moments(with_chunk(emb_rows, window_schedule(500, 100, 50)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_wide_grams_travel_in_parts_and_keep_far_means(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(40, 300)) + 1e7 * np.arange(1, 301)
    rows = frame(spark, X).withColumn("chunk", F.lit(5).cast("long")).repartition(4)
    got = mo.pooled_moments(rows)
    assert got.count() == -(-300 * 301 // 2 // mo.PART_CELLS)
    tbl = got.toArrow().sort_by("part").combine_chunks()
    (_, (n, mean, W)), = mo.whole_states(mo.moment_rows(tbl.to_batches()))
    Xc = X - X.mean(axis=0)
    assert n == 40 and np.allclose(W, Xc.T @ Xc, atol=1e-5)


def test_ragged_or_nan_rows_are_rejected(spark):
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, float("nan")]]):
        df = spark.createDataFrame([(0, r) for r in bad], "chunk long, features array<double>").coalesce(1)
        with pytest.raises(Exception):
            mo.pooled_moments(df).collect()


# --- per key ---------------------------------------------------------------------------------

def test_a_key_with_nine_tenths_of_the_rows_equals_its_own_run(spark, emb_matrix):
    key = [0 if i % 10 else 1 for i in range(500)]
    df = frame(spark, emb_matrix, key=key)
    got = sliding_pca_by_key(df, ["key"], k=2, block=20, stride=7, subsample=2, max_iter=2)
    for value in (0, 1):
        X = emb_matrix[[i for i in range(500) if key[i] == value]]
        want = sliding_pca(frame(spark, X), k=2, block=20, stride=7, subsample=2, max_iter=2)
        assert np.allclose(by_row(got.where(F.col("key") == value)), by_row(want.scores), atol=1e-9)
        ref, _, _, _ = bf.sliding_rows(X, 2, 20, 7, 2, 2, max_slides=None)
        assert np.allclose(by_row(want.scores), ref, atol=1e-8)


def test_a_hundred_thousand_steps_hold_the_live_chunks_only():
    sched = window_schedule(100_000 + 20, 20, 1)
    width, d = sched.last + 1, 6
    rng = np.random.default_rng(0)

    def chunks():
        bounds = itertools.chain([(r, sched.first_step_of(r), min(r, sched.last)) for r in range(20)],
                                 ((r, r - 19, min(r, sched.last)) for r in range(20, sched.n)))
        for _, first, last in bounds:
            yield first * width + last, [1, rng.normal(size=d), np.zeros((d, d))]

    live = StreamedChunks(chunks(), width)
    tracemalloc.start()
    peaks, most = [], 0
    for S, V, row in iter_steps(chunk_grams(live), range(3_000), d, 1, 1, enter_lo=lambda t: 0):
        most = max(most, len(live.window))
        if row[0] % 1_000 == 999:
            peaks.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert most <= 21 and max(peaks) < peaks[0] + 100_000
    gen = StreamedChunks(chunks(), width)   # the whole length, windows only
    assert all(len(gen(t)) == 20 for t in range(0, width, 1))


def test_nulls_in_the_order_key_raise_in_capped_keyed_runs(spark, emb_matrix):
    X = np.tile(emb_matrix[:, :8], (6, 1))
    rows = [(1, float(i) if i % 600 else None, [float(x) for x in r]) for i, r in enumerate(X)]
    df = spark.createDataFrame(rows, f"key long, ord double, {FEATURES} array<double>")
    with pytest.raises(Exception, match="null in the order key"):
        sliding_pca_by_key(df, ["key"], k=1, block=20, stride=20, subsample=1, max_slides=3, order_by="ord").collect()
    assert skipped_keys(df, ["key"], 20).count() == 0


# --- row numbers and files -------------------------------------------------------------------

def test_numbering_caches_nothing_and_its_folder_can_be_freed(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ids = with_row_id(ev, "ts")
    assert ids.agg(F.countDistinct(ROW_ID)).first()[0] == ev.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    path = ids._matstream_scratch
    assert path_exists(spark, path)
    release(ids)
    assert not path_exists(spark, path)
    kept = written(ev, "some")
    assert kept.count() == ev.count() and clear_scratch(spark) >= 1


def test_equal_order_keys_raise(spark):
    df = spark.createDataFrame([(i % 40, i) for i in range(41)], "ord long, x long").repartition(5)
    with pytest.raises(Exception, match="equal order key"):
        with_row_id(df, "ord").count()
    grouped = spark.createDataFrame([(g, i) for g in range(3) for i in range(50)], "g long, ord long")
    assert with_row_id(grouped, "ord", partition_by=["g"]).where(F.col(ROW_ID) != F.col("ord")).count() == 0


def test_text_rows_are_neither_sorted_nor_shuffled(spark):
    path = scratch_path(spark, "csv-test")
    spark.range(0, 20_000, 1, 6).select(F.concat_ws(",", F.col("id"), F.col("id") * 2).alias("value")).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")   # several splits a file
    try:
        df = read_dense_csv(spark, path)
        got = df.orderBy(ROW_ID).collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    files = sorted(spark.read.text(path).inputFiles())
    want = [float(line.split(",")[0]) for f in files for line in open(f.replace("file://", ""))]
    assert [r[ROW_ID] for r in got] == list(range(20_000)) and [r[FEATURES][0] for r in got] == want
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Sort" not in plan


# --- long and wide runs ----------------------------------------------------------------------

def test_a_stopped_run_goes_on_behind_its_last_band(spark, emb_rows, emb_matrix, monkeypatch):
    settings = dict(k=2, block=100, stride=13, subsample=2, max_iter=2, seed=5)
    want = sliding_pca(emb_rows, **settings)
    path = scratch_path(spark, "long")
    from matstream.plans import sliding

    real, bands = sliding.advance, []

    def stops(*a, **k):
        if len(bands) == 3:
            raise KeyboardInterrupt
        bands.append(1)
        return real(*a, **k)

    monkeypatch.setattr(sliding, "advance", stops)
    with pytest.raises(KeyboardInterrupt):
        sliding_pca(emb_rows, run_path=path, band_steps=4, method="moments", **settings)
    monkeypatch.setattr(sliding, "advance", real)
    got = sliding_pca(emb_rows, run_path=path, band_steps=4, method="moments", **settings)
    assert np.allclose(by_row(got.scores), by_row(want.scores), atol=1e-9)
    assert [r["spectral_error"] for r in got.stats.orderBy("step").collect()] == pytest.approx(
        [r["spectral_error"] for r in want.stats.orderBy("step").collect()], abs=1e-9)
    assert got.model.count() == want.model.count()
    with pytest.raises(ValueError, match="other settings"):
        sliding_pca(emb_rows, run_path=path, band_steps=4, method="moments", **{**settings, "k": 1})


def test_wide_rows_with_stride_one(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(1050, 617)) * np.linspace(3, 0.2, 617)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(X)], f"{ROW_ID} long, {FEATURES} array<double>").repartition(6)
    got = sliding_pca(df, k=10, block=1000, stride=1, subsample=8, max_iter=1)
    assert got.models == [] and got.stats.count() == 51   # the rows in order, no window checkpoint
    want, specs, _, changes = bf.sliding_rows(X, 10, 1000, 1, 8, 1, max_slides=None)
    mine = by_row(got.scores)
    assert np.allclose(mine, want, atol=1e-6)
    assert [r["spectral_error"] for r in got.stats.orderBy("step").collect()] == pytest.approx(specs, abs=1e-6)
    assert [r["change_at"][0] for r in got.stats.where("size(change_at) > 0").orderBy("step").collect()] == changes


def test_short_strides_equal_the_moments_path(spark, emb_matrix):
    df = frame(spark, emb_matrix[:160])
    a = sliding_pca(df, k=3, block=90, stride=3, subsample=2, max_iter=2, method="window", calc_error=True)
    b = sliding_pca(df, k=3, block=90, stride=3, subsample=2, max_iter=2, method="moments", calc_error=True)
    assert np.allclose(by_row(a.scores), by_row(b.scores), atol=1e-9)
    for x, y in zip(a.stats.orderBy("step").collect(), b.stats.orderBy("step").collect()):
        assert x["n_rows"] == y["n_rows"] and x["change_at"] == y["change_at"] and x["n_iter"] == y["n_iter"]
        assert np.allclose(x["errors"], y["errors"], atol=1e-3) and x["sigma_k1"] == pytest.approx(y["sigma_k1"], abs=1e-9)


def test_rank_rule_of_the_reference(spark, emb_matrix):
    df = frame(spark, emb_matrix[:60])
    with pytest.raises(ValueError, match="subsample"):
        sliding_pca(df, k=10, block=30, stride=10, subsample=20)


def test_command_line_has_no_slide_cap_unless_asked():
    from matstream.cli import parse

    need = "--input a --output b --cols 5 --pcs 1 --subsample 1 --block-size 10 --stride 2".split()
    assert parse(need).max_slides == 0 and parse(need + ["--max-slides", "20"]).max_slides == 20


def test_many_bands_are_written_together(spark, emb_rows, monkeypatch):
    from matstream.plans import sliding

    settings = dict(k=2, block=100, stride=5, subsample=1, method="moments")
    want = sliding_pca(emb_rows, **settings)
    jobs = spark.sparkContext.statusTracker()
    monkeypatch.setattr(sliding, "BAND_READ_BYTES", 8 * 2 * 64 * 64 * 8)   # several reads of moments
    spark.sparkContext.setJobGroup("bands", "bands")
    got = sliding_pca(emb_rows, run_path=scratch_path(spark, "long"), band_steps=1, **settings)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("bands")) < want.stats.count()   # 81 bands of one step
    assert np.allclose(by_row(got.scores), by_row(want.scores), atol=1e-9)
    assert got.model.count() == want.model.count() and got.stats.count() == want.stats.count()


def test_window_as_a_dataframe_in_bands(spark, emb_rows, monkeypatch):
    from matstream.plans import sliding

    settings = dict(k=2, block=97, stride=10, subsample=2, max_iter=2)
    want = sliding_pca(emb_rows, method="moments", **settings)
    monkeypatch.setattr(sliding, "ROW_BAND_BYTES", 15 * 10 * 64 * 8)   # 15 steps a band
    spark.sparkContext.setJobGroup("rows", "rows")
    got = sliding_pca(emb_rows, method="rows", **settings)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rows")) < want.stats.count()
    few = dict(settings, max_slides=2)
    monkeypatch.setattr(sliding, "WINDOW_STATE_BYTES", 0)   # distributed passes at every step
    passes = sliding_pca(emb_rows, method="rows", **few)
    for a, b in ((got, want), (passes, sliding_pca(emb_rows, method="moments", **few))):
        assert np.allclose(by_row(a.scores), by_row(b.scores), atol=1e-9)
        for x, y in zip(a.stats.orderBy("step").collect(), b.stats.orderBy("step").collect(), strict=True):
            assert x["n_rows"] == y["n_rows"] and x["change_at"] == y["change_at"]
            assert x["spectral_error"] == pytest.approx(y["spectral_error"], abs=1e-9)
