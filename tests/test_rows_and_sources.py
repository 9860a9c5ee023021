import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from matstream.operators import rows as ro
from matstream.sources import sinks
from matstream.sources.frames import from_array, from_columns, read_dense_csv, validate

# fixed values: the 7 x 5 0/1 matrix shipped with the reference as a unit fixture
MAT = [
    [0, 1, 0, 1, 0],
    [1, 1, 0, 1, 0],
    [0, 0, 1, 1, 0],
    [1, 0, 1, 1, 0],
    [0, 1, 0, 1, 0],
    [1, 1, 0, 1, 0],
    [0, 0, 1, 1, 0],
]


@pytest.fixture()
def mat(spark):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(MAT)],
                                 "row_id long, features array<double>")


def test_products_match_numpy(emb_rows, emb_matrix):
    X = emb_matrix
    rng = np.random.default_rng(3)
    M = rng.standard_normal((64, 5))
    V, _ = np.linalg.qr(rng.standard_normal((64, 3)))
    P = np.array(list(ro.project(emb_rows, M).orderBy("row_id").toPandas()["features"]))
    assert np.allclose(P, X @ M)
    PT = np.array(list(ro.project_t(emb_rows, M.T).orderBy("row_id").toPandas()["features"]))
    assert np.allclose(PT, X @ M)
    D = np.array(list(ro.deflate(emb_rows, V).orderBy("row_id").toPandas()["features"]))
    assert np.allclose(D, X - X @ V @ V.T)
    assert np.abs(D @ V).max() < 1e-12  # deflated rows are orthogonal to V
    S = np.array(list(ro.score(emb_rows, V).orderBy("row_id").toPandas()["scores"]))
    assert np.allclose(S, X @ V)


def test_cells_roundtrip_and_sparse_products(spark, mat):
    cells = ro.to_cells(mat)
    assert cells.count() == sum(v != 0 for r in MAT for v in r)
    back = np.array(list(ro.to_rows(cells, 5).orderBy("row_id").toPandas()["features"]))
    assert np.array_equal(back, np.array(MAT, float))
    M = np.arange(10, dtype=float).reshape(5, 2) - 4.0
    got = {(r.row_id, r.c): r.v for r in ro.project_sparse(cells, M).collect()}
    want = np.array(MAT, float) @ M
    for (i, c), v in got.items():
        assert v == want[i, c]
    nz = ro.project_sparse(cells, M, drop_zeros=True).collect()
    assert all(r.v != 0 for r in nz)


def test_centre_subtract_dot(spark, mat):
    A = np.array(MAT, float)
    mean = A.mean(0)
    C = np.array(list(ro.center(mat, mean).orderBy("row_id").toPandas()["features"]))
    assert np.allclose(C, A - mean)
    diff = np.array(list(ro.subtract(mat, ro.center(mat, mean)).orderBy("row_id").toPandas()["features"]))
    assert np.allclose(diff, np.tile(mean, (7, 1)))
    two = np.array(list(ro.subtract2(mat, mat, mat).orderBy("row_id").toPandas()["features"]))
    assert np.allclose(two, -A)
    d = [r.v for r in ro.dot(mat, [1, 2, 3, 4, 5]).orderBy("row_id").collect()]
    assert np.allclose(d, A @ np.arange(1, 6))
    dd = [r.v for r in ro.dot_rows(mat, mat).orderBy("row_id").collect()]
    assert np.allclose(dd, (A * A).sum(1))


def test_sample_rows_rate_is_the_share_dropped(spark):
    df = spark.range(20000).withColumnRenamed("id", "row_id")
    kept = ro.sample_rows(df, 0.25, seed=5).count()
    assert 0.72 < kept / 20000 < 0.78
    assert ro.sample_rows(df, 0.25, seed=5).count() == kept


def test_text_formats(spark, mat):
    lines = [r.line for r in sinks.dense_text_lines(mat, digits=1).orderBy("row_id").collect()]
    assert lines[0] == "0.0 1.0 0.0 1.0 0.0 "
    lil = [r.line for r in sinks.lil_lines(mat, digits=1).orderBy("row_id").collect()]
    assert lil[0] == "{1:1.0,3:1.0}"
    empty = spark.createDataFrame([(0, [0.0, 0.0])], "row_id long, features array<double>")
    assert sinks.lil_lines(empty).first().line == "{}"
    coo = {(r.i, r.j) for r in sinks.coo_cells(mat).collect()}
    assert (0, 1) in coo and (0, 0) not in coo and len(coo) == 17


def test_dense_csv_roundtrip(spark, emb_rows, emb_matrix, tmp_dir):
    path = os.path.join(tmp_dir, "dense")
    sinks.write_csv(emb_rows, path)
    back = read_dense_csv(spark, path)
    got = np.array(list(back.orderBy("row_id").toPandas()["features"]))
    assert np.array_equal(got, emb_matrix)
    assert validate(back) == 64


def test_dense_csv_rules(spark, tmp_dir):
    path = os.path.join(tmp_dir, "rules.csv")
    with open(path, "w") as f:
        f.write(" 1,2,3,, \n4,5,6\n")
    got = [list(r.features) for r in read_dense_csv(spark, path).orderBy("row_id").collect()]
    assert got == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]   # trimmed, trailing commas dropped
    bad = os.path.join(tmp_dir, "bad.csv")
    with open(bad, "w") as f:
        f.write("1,x,3\n")
    with pytest.raises(Exception):
        read_dense_csv(spark, bad).collect()


def test_from_columns_numbers_by_order(spark):
    df = spark.createDataFrame([(30, 1.0, 2), (10, 3.0, 4), (20, 5.0, 6)], "k int, a double, b int")
    got = [(r.row_id, list(r.features)) for r in from_columns(df, ["a", "b"], order_by="k").orderBy("row_id").collect()]
    assert got == [(0, [3.0, 4.0]), (1, [5.0, 6.0]), (2, [1.0, 2.0])]


def test_validate_rejects_ragged(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "row_id long, features array<double>")
    with pytest.raises(ValueError):
        validate(df)


def test_run_output_writers(spark, emb_rows, tmp_dir):
    from matstream.plans.sliding import sliding_pca

    res = sliding_pca(emb_rows, k=3, block=100, stride=50, subsample=4, max_iter=2)
    sinks.write_scores(res.scores, os.path.join(tmp_dir, "scores"), block=100, stride=50, k=3, subsample=4)
    sinks.write_model(res.model, os.path.join(tmp_dir, "model"), block=100, stride=50, k=3, subsample=4)
    sinks.write_stats(res.stats, os.path.join(tmp_dir, "stats"), block=100, stride=50)
    sinks.write_stats(res.stats, os.path.join(tmp_dir, "stats_short"), detail=False, block=100, stride=50)
    sc = spark.read.parquet(os.path.join(tmp_dir, "scores"))
    assert sc.count() == 500 and {"block", "stride", "k", "subsample"} <= set(sc.columns)
    assert spark.read.parquet(os.path.join(tmp_dir, "model")).count() == 9 * 3
    short = spark.read.parquet(os.path.join(tmp_dir, "stats_short"))
    assert {"step", "change_at", "mean_run_s", "mean_spectral_error"} <= set(short.columns)
    # append mode: a second run adds rows
    sinks.write_model(res.model, os.path.join(tmp_dir, "model"), block=100, stride=50, k=3, subsample=4)
    assert spark.read.parquet(os.path.join(tmp_dir, "model")).count() == 2 * 9 * 3


def test_command_line_run(spark, emb_rows, tmp_dir):
    from matstream import cli

    src = os.path.join(tmp_dir, "in")
    sinks.write_csv(emb_rows, src)
    out = os.path.join(tmp_dir, "out")
    rc = cli.main(["--input", src, "--output", out, "--cols", "64", "--pcs", "3", "--subsample", "4",
                   "--block-size", "100", "--stride", "50", "--max-iter", "2", "--seed", "validation"])
    assert rc == 0
    assert spark.read.parquet(os.path.join(out, "scores")).count() == 500
    assert spark.read.parquet(os.path.join(out, "stats")).count() == 9
    assert cli.main(["--input", src, "--output", out, "--cols", "65", "--pcs", "3", "--subsample", "4",
                     "--block-size", "100", "--stride", "50"]) == 2


def test_dense_csv_keeps_file_order_across_splits(spark, tmp_dir):
    rng = np.random.default_rng(11)
    X = rng.standard_normal((6000, 12))
    paths = []
    for f in range(2):
        p = os.path.join(tmp_dir, f"part{f}.csv")
        with open(p, "w") as fh:
            for r in X[f * 3000:(f + 1) * 3000]:
                fh.write(",".join(repr(float(v)) for v in r) + "\n")
        paths.append(p)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))   # many splits per file
    try:
        back = read_dense_csv(spark, tmp_dir)
        got = np.array(list(back.orderBy("row_id").toPandas()["features"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert np.array_equal(got, X)


def test_blank_line_fails_the_job(spark, tmp_dir):
    p = os.path.join(tmp_dir, "blank.csv")
    with open(p, "w") as fh:
        fh.write("1,2\n\n3,4\n")
    with pytest.raises(Exception):
        read_dense_csv(spark, p).collect()


def test_text_writers_keep_row_order(spark, mat, tmp_dir):
    import glob

    for writer, first in ((sinks.write_dense_text, "0.0 1.0 0.0 1.0 0.0 "), (sinks.write_lil, "{1:1.0,3:1.0}")):
        path = os.path.join(tmp_dir, writer.__name__)
        writer(mat.repartition(3), path, digits=1)
        lines = [ln.rstrip("\n") for f in sorted(glob.glob(os.path.join(path, "part-*"))) for ln in open(f)]
        assert len(lines) == 7 and lines[0] == first
    sinks.write_coo(mat, os.path.join(tmp_dir, "coo"), digits=1)
    coo = [ln.strip() for f in glob.glob(os.path.join(tmp_dir, "coo", "part-*")) for ln in open(f)]
    assert sorted(coo)[0] == "0,1,1.0" and len(coo) == 17


def test_malformed_field_fails_without_ansi_mode(spark):
    from matstream.sources.frames import parse_dense_lines

    lines = spark.createDataFrame([("1,x,3",)], "value string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="not a number"):
            parse_dense_lines(lines).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_sparse_sketch_equals_the_dense_one(spark):
    import numpy as np

    from matstream.functions.seeds import seed_validation
    from matstream.operators import moments as mo

    X = np.zeros((6, 5))
    X[0, 1], X[2, 3], X[2, 4], X[5, 1] = 2, -1, 3, 4  # rows 1, 3, 4 have no cell, columns 0 and 2 none
    cells = spark.createDataFrame([(int(i), int(j), float(X[i, j])) for i, j in zip(*np.nonzero(X))],
                                  "row_id long, j int, v double")
    M = seed_validation(5, 3)
    Xc = X - X.mean(0)
    want = {"yz": Xc.T @ (Xc @ M), "zz": (Xc @ M).T @ (Xc @ M)}
    got = mo.sparse_sketch_cells(cells, M, 6).collect()
    assert len(got) == 3 * 3 + 3 * 3
    assert all(abs(r["v"] - want[r["part"]][r["i"], r["j"]]) < 1e-9 for r in got)
