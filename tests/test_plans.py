"""The physical plans the design relies on: pushdown, pruning, broadcast of small sides, JVM-side scoring."""

import numpy as np
from pyspark.sql import functions as F

from matstream.operators import moments as mo
from matstream.operators.windows import window_schedule, with_chunk
from matstream.plans.sliding import sliding_pca
from matstream.sources.frames import from_array, from_columns


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_scheduled_range_reaches_the_scan_and_scoring_stays_in_the_jvm(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = from_array(emb, "embedding", row_id="vec_id")
    res = sliding_pca(rows, k=3, block=100, stride=50, subsample=4, max_iter=1, max_slides=20)
    p = plan(res.scores)
    assert "LessThan(vec_id,1100)" in p            # only the rows the 20 slides read are scanned
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p   # the model table, size checked
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p   # dot products are JVM expressions


def test_column_pruning_and_partial_aggregation(spark):
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    stats = mo.column_stats(from_columns(li, ["l_quantity", "l_tax"]), ("mean",))
    scan = [line for line in stats._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert scan and all("l_extendedprice" not in line and "l_shipdate" not in line for line in scan)


def test_chunk_moments_aggregate_partially_before_the_shuffle(spark, emb_rows):
    s = window_schedule(500, 100, 50)
    cells = mo.chunk_moments(with_chunk(emb_rows, s))
    cells.count()
    p = cells._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in p or "PythonMapInArrow" in p
    assert p.count("HashAggregate") >= 2 or "partial_sum" in p
