from pyspark.sql import functions as F

from matstream.operators.rowid import first_block, rows_at, with_row_id


def test_dense_ids_follow_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("v"))
    out = with_row_id(df, "k", num_partitions=7).orderBy("row_id").collect()
    assert [r.row_id for r in out] == list(range(5000))
    keys = [r.k for r in out]
    assert keys == sorted(keys)


def test_ids_within_groups_with_a_hot_group(spark):
    # one group holds a third of all rows: range partitioning spreads it over partitions
    n = 6000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
                               (F.col("id") * 31 % 100003).alias("k"))
    out = with_row_id(df, "k", num_partitions=9, partition_by=["g"]).toPandas()
    for g, grp in out.groupby("g"):
        grp = grp.sort_values("k")
        assert list(grp.row_id) == list(range(len(grp)))


def test_block_and_lookup(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    assert first_block(df, 10).count() == 10
    assert sorted(r.row_id for r in rows_at(df, (20, 25)).collect()) == [20, 21, 22, 23, 24]
    ids = spark.createDataFrame([(3,), (7,), (7,)], "row_id long")
    assert sorted(r.row_id for r in rows_at(df, ids).collect()) == [3, 7]


def test_first_rows_are_exact_ranks(spark):
    from matstream.operators.rowid import first_rows

    df = spark.range(0, 20000).select((F.col("id") * 7919 % 20011).alias("k"), F.col("id").alias("v"))
    got = first_rows(df, "k", 1234).orderBy("row_id").toPandas()
    want = df.orderBy("k").limit(1234).toPandas()
    assert list(got.row_id) == list(range(1234))
    assert list(got.k) == list(want.k)


def test_rows_of_equal_key_follow_their_ties(spark):
    import pytest

    from matstream.operators.rowid import first_rows

    rows = [(i % 7, i // 7) for i in range(700)] + [(3, 5), (3, 5)]   # a hundred rows a key, one row three times
    df = spark.createDataFrame(rows, "k int, v long").repartition(5)
    for got in (with_row_id(df, "k", num_partitions=9, ties=["v"]), first_rows(df, "k", 333, ties=["v"])):
        got = got.orderBy("row_id").collect()
        assert [r.row_id for r in got] == list(range(len(got)))
        assert [(r.k, r.v) for r in got] == sorted(rows)[:len(got)]
    with pytest.raises(Exception, match="equal order key"):   # rows that differ elsewhere have no order
        with_row_id(df.withColumn("w", F.lit(1)), "k", ties=["v"]).count()


def test_event_queries_with_equal_times(spark, tmp_dir):
    import __spark_entry__ as E

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    both = ev.unionByName(ev.withColumn("event_id", F.col("event_id") + ev.count()))
    both.write.parquet(f"{tmp_dir}/events.parquet")
    want = [r.event_id for r in both.orderBy("ts", "event_id").collect()]
    got = E.q_row_id_by_time(spark, tmp_dir).orderBy("row_id").collect()
    assert [r.event_id for r in got] == want and [r.row_id for r in got] == list(range(len(want)))
    assert [r.event_id for r in E.q_first_rows_by_time(spark, tmp_dir).orderBy("row_id").collect()] == want[:2500]
    for q in (E.q_events_sliding_k1, E.q_events_sliding_pca, E.q_events_sliding_head):
        ids = [r.row_id for r in q(spark, tmp_dir).select("row_id").orderBy("row_id").collect()]
        assert ids == list(range(len(want)))
