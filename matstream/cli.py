"""Command line: the sliding PCA over a dense comma-separated file, with the reference's settings.

    spark-submit matstream/cli.py --input data.csv --output out/ --cols 617 --pcs 10 \
        --subsample 8 --block-size 1000 --stride 1 [--max-iter 10] [--calculate-error] ...

Reads the file (S1), runs :func:`sliding_pca`, appends scores, model and
statistics as Parquet under ``--output`` (S6-S8, tagged with the settings),
and prints the mean run time and the mean spectral error over all steps.
``--rows`` and ``--singular-value`` are accepted for compatibility and not
used (the reference does not use them either); ``--cols`` is checked against
the width of the data.
"""

from __future__ import annotations

import argparse
import os
import sys


def parse(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="matstream", description=__doc__.split("\n\n")[0])
    p.add_argument("--input", required=True, help="dense comma-separated numeric text (file or folder)")
    p.add_argument("--output", required=True, help="folder for scores/, model/ and stats/ (appended)")
    p.add_argument("--cols", type=int, required=True, help="number of columns (checked against the data)")
    p.add_argument("--pcs", type=int, required=True, help="number of principal components (k)")
    p.add_argument("--subsample", type=int, required=True, help="extra sketch columns (s = k + subsample)")
    p.add_argument("--subsample-norm", type=int, default=1, help="extra columns of the error sketch")
    p.add_argument("--q", type=int, default=10, help="rounds of the residual-norm estimate")
    p.add_argument("--tolerance", type=float, default=0.05, help="relative error that stops the rounds")
    p.add_argument("--max-iter", type=int, default=1, help="sketch rounds per step")
    p.add_argument("--calculate-error", action="store_true", help="estimate the error after every round")
    p.add_argument("--block-size", type=int, required=True, help="window size")
    p.add_argument("--stride", type=int, required=True, help="rows entering per step")
    p.add_argument("--max-slides", type=int, default=0, help="slide cap; 0 for none (the reference stops after 20)")
    p.add_argument("--seed", default="0", help="'validation' or an integer for Gaussian seeds")
    p.add_argument("--rows", type=int, default=None, help="accepted, not used")
    p.add_argument("--singular-value", type=float, default=None, help="accepted, not used")
    return p.parse_args(argv)


def main(argv=None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from matstream.plans.report import run_summary
    from matstream.plans.sliding import sliding_pca
    from matstream.sources import sinks
    from matstream.sources.frames import read_dense_csv, validate

    a = parse(argv)
    spark = SparkSession.builder.appName("matstream").getOrCreate()
    rows = read_dense_csv(spark, a.input)
    width = validate(rows)
    if width != a.cols:
        print(f"--cols {a.cols} does not match the data width {width}", file=sys.stderr)
        return 2
    pcs = a.pcs - 1 if a.pcs == a.cols else a.pcs
    seed = a.seed if a.seed == "validation" else int(a.seed)
    res = sliding_pca(rows, k=pcs, block=a.block_size, stride=a.stride, subsample=a.subsample,
                      max_iter=a.max_iter, max_slides=a.max_slides or None, tolerance=a.tolerance,
                      calc_error=a.calculate_error, q=a.q, subsample_norm=a.subsample_norm, seed=seed,
                      dataset=os.path.basename(a.input.rstrip("/")))
    tags = dict(block=a.block_size, stride=a.stride, k=pcs, subsample=a.subsample)
    sinks.write_scores(res.scores, os.path.join(a.output, "scores"), **tags)
    sinks.write_model(res.model, os.path.join(a.output, "model"), **tags)
    sinks.write_stats(res.stats, os.path.join(a.output, "stats"), **tags)
    summ = run_summary(res.stats).first()
    print(f"Mean runtime: {summ['mean_run_s']}")
    print(f"Mean spectral Error: {summ['mean_spectral_error']}")
    changes = res.stats.select(F.explode("change_at")).count()
    print(f"Steps: {len(res.models)}, component swaps: {changes}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
