"""Row numbering and look-up (O1-O3).

``with_row_id`` gives dense 0-based ids in the order of a key without a
global single-partition window: the rows are range-partitioned, sorted and
written, each partition is counted, and the running offsets (one row per
partition, a bounded table) are broadcast back.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matstream.session import drop_path, scratch_path
from matstream.sources.frames import ROW_ID

_POS_BITS = 33  # monotonically_increasing_id: partition id << 33 | record number


def with_row_id(df: DataFrame, order_by: str | Sequence[str], id_col: str = ROW_ID,
                num_partitions: int | None = None, partition_by: Sequence[str] = (),
                ties: Sequence[str] = ()) -> DataFrame:
    """Add a dense 0-based ``id_col`` in the order of ``order_by``.

    The rows are range-partitioned on the key, sorted and written to the shared
    folder with their partition and position; the ids add the counts of the
    partitions before.  Nothing is cached, and a lost executor finds the same rows
    again.  The folder is freed by :func:`release` or, for all of a session, by
    ``matstream.session.clear_scratch``.

    A null in the key fails the job, and so do two rows of an equal key (add
    tie-breaking columns): the rows of a key are in one partition, in order, so
    the count per key costs no further shuffle.

    Rows of an equal key are put in the order of ``ties``, nulls first. Where key and
    ties are all the columns, rows equal in them are the same and may repeat.

    With ``partition_by`` the ids are dense within each group.  The range
    partitioning is on ``(group, order)``, so a group holding a third of all
    rows is still spread over many partitions; the offsets are per (group,
    partition), a table bounded by the partitions times the groups per
    partition.
    """
    groups = list(partition_by)
    keys = groups + ([order_by] if isinstance(order_by, str) else list(order_by))
    for c in keys[len(groups):]:  # a null has no place in the order
        df = df.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"null in the order key {c}"))))
    keys += [c for c in ties if c not in keys]
    whole = bool(ties) and set(df.columns) <= set(keys)
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    if not whole:
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        mid = F.when(same == 1, mid).otherwise(F.raise_error(F.lit(f"rows of equal order key {', '.join(keys)}")).cast("long"))
    sorted_rows = (
        df.repartitionByRange(n_parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", mid)
        .withColumn("_pid", F.shiftright("_mid", _POS_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop("_mid")
    )
    path = scratch_path(spark, "rowid")
    sorted_rows.write.parquet(path)
    tagged = spark.read.schema(sorted_rows.schema).parquet(path)
    if groups:
        # rows of one group inside one partition are contiguous and sorted, so
        # position within the group = position in partition - first position of the group there
        counts = tagged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
        running = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("_pid", *groups, (F.coalesce(F.sum("_n").over(running), F.lit(0))
                                                  - F.col("_p0")).alias("_off"))
        out = tagged.join(offsets, ["_pid", *groups])
    else:
        # one row per partition: a table whose size is bounded by the partition count
        counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        running = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
        out = tagged.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(id_col, (F.col("_off") + F.col("_pos")).cast("long")).drop("_pid", "_pos", "_off")
    out._matstream_scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`with_row_id` wrote for ``df`` (call when its results are written)."""
    path = getattr(df, "_matstream_scratch", None)
    if path is not None:
        drop_path(df.sparkSession, path)


def first_block(df: DataFrame, block: int, id_col: str = ROW_ID) -> DataFrame:
    """Rows ``0..block-1`` (a range predicate, pushed to Parquet when ids are stored)."""
    return df.where(F.col(id_col) < F.lit(block))


def rows_at(df: DataFrame, ids, id_col: str = ROW_ID) -> DataFrame:
    """Rows by id.

    ``ids`` is a ``(lo, hi)`` half-open range (a pushed-down range filter), or
    a DataFrame with an ``id_col`` column (left semi join; Catalyst broadcasts
    it when its size is below the broadcast threshold).
    """
    if isinstance(ids, tuple):
        lo, hi = ids
        return df.where((F.col(id_col) >= F.lit(lo)) & (F.col(id_col) < F.lit(hi)))
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def first_rows(df: DataFrame, order_by: str, n_rows: int, id_col: str = ROW_ID, accuracy: int = 100_000,
               total: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n_rows`` rows in the order of a numeric / date / timestamp key, numbered densely.

    The key is unique or made so by ``ties`` (see :func:`with_row_id`).

    Numbering a whole table is a full sort; when only a prefix is read (a
    capped sliding run) a key threshold is found instead: an approximate
    quantile (one aggregate) gives a value at or above the ``n_rows``-th key,
    a filter on it (pushed to the scan) keeps every row up to it, and only
    those rows are numbered.  All rows below the threshold are kept, so the
    ids are exact ranks; the threshold is raised until at least ``n_rows`` rows
    pass.
    """
    total = df.count() if total is None else total
    if n_rows >= total:
        return with_row_id(df, order_by, id_col, ties=ties)
    key = F.col(order_by)
    if not df.where(key.isNull()).isEmpty():
        raise ValueError(f"null in the order key {order_by}")
    p = min(1.0, n_rows / total + 2.0 / accuracy)
    while p < 1.0:
        thr = df.agg(F.percentile_approx(key, p, accuracy).alias("t")).first()["t"]
        head = df.where(key <= F.lit(thr))
        if head.count() >= n_rows:
            return with_row_id(head, order_by, id_col, ties=ties).where(F.col(id_col) < F.lit(n_rows))
        p = min(1.0, 2 * p)
    return with_row_id(df, order_by, id_col, ties=ties).where(F.col(id_col) < F.lit(n_rows))
