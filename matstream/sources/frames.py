"""Sources: numeric tables and text files as a matrix in rows form.

Rows form is ``row_id BIGINT, features ARRAY<DOUBLE>``; every row has the same
width, no nulls and no NaN (see :func:`validate`).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matstream.session import written

MAX_BROADCAST_SPLITS = 500_000   # a path and two numbers each
ROW_ID = "row_id"
FEATURES = "features"


def from_columns(df: DataFrame, cols: Sequence[str], order_by: str | Sequence[str] | None = None,
                 row_id: str | None = None, keep: Iterable[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Rows form from numeric columns of a table.

    ``row_id`` names a column that already holds dense 0-based ids (used as
    is, so a range predicate on it reaches the Parquet scan); otherwise the
    rows are numbered by ``order_by`` with :func:`with_row_id`, rows of an
    equal key by ``ties``, then by the numbers themselves.  With
    neither, ids are unique but not dense (for order-free aggregates).
    """
    feats = F.array(*[F.col(c).cast("double") for c in cols])
    return _rows(df, feats, order_by, row_id, keep, ties)


def from_array(df: DataFrame, col: str, order_by: str | Sequence[str] | None = None,
               row_id: str | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Rows form from an array column (any numeric element type)."""
    return _rows(df, F.col(col).cast("array<double>"), order_by, row_id, keep)


def _rows(df: DataFrame, feats: Column, order_by, row_id, keep, ties=()) -> DataFrame:
    keep = list(keep)
    if row_id is not None:
        return df.select(F.col(row_id).cast("long").alias(ROW_ID), feats.alias(FEATURES), *keep)
    if order_by is None:
        # order-free use (aggregates): unique but not dense ids, no shuffle
        return df.select(F.monotonically_increasing_id().alias(ROW_ID), feats.alias(FEATURES), *keep)
    from matstream.operators.rowid import with_row_id

    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    more = [c for c in ties if c not in keys]
    base = df.select(*keys, *more, feats.alias(FEATURES), *[k for k in keep if k not in keys + more])
    numbered = with_row_id(base, keys, ties=[*more, FEATURES] if ties else ())
    return numbered.select(ROW_ID, FEATURES, *keep)


def parse_dense_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse comma-separated numeric text lines into an ``ARRAY<DOUBLE>``.

    The line is trimmed, trailing commas are dropped (as a Java ``split``
    does), every field is cast to double.  A blank or malformed field fails
    the job, whatever the session's ANSI mode.
    """
    stripped = F.regexp_replace(F.trim(F.col(value_col)), ",+$", "")
    fields = F.split(stripped, ",")
    parsed = F.transform(fields, lambda x: F.coalesce(
        F.trim(x).try_cast("double"), F.raise_error(F.concat(F.lit("not a number: '"), x, F.lit("'"))).cast("double")))
    return lines.withColumn(FEATURES, parsed)


def read_dense_csv(spark: SparkSession, path: str, min_partitions: int = 4) -> DataFrame:
    """Read a headerless dense comma-separated numeric file as rows form.

    Text carries no order column, so rows are numbered in file order: file
    path, split start offset, then position within the split.  The lines of each
    split are counted first (one row a split); a line's id is its place in
    its split plus the lines of the splits before, so no line is sorted or
    shuffled.  ``min_partitions`` is kept for the reference's signature; Spark plans the
    file splits itself (``spark.sql.files.maxPartitionBytes``).
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),   # grows by one from line to line of a split
        F.col("value"))
    before = Window.orderBy("_file", "_blk").rowsBetween(Window.unboundedPreceding, -1)   # over splits, not lines
    splits = lines.groupBy("_file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    splits = written(splits.select("_file", "_blk", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
                                   .alias("_off")), "splits")
    if splits.count() <= MAX_BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    numbered = lines.join(splits, ["_file", "_blk"]).withColumn(ROW_ID, F.col("_off") + F.col("_mid"))
    return parse_dense_lines(numbered).select(ROW_ID, FEATURES)


def validate(df: DataFrame, col: str = FEATURES) -> int:
    """Check that every row has the same width, no null and no NaN; return the width."""
    stats = df.select(
        F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi"),
        F.sum(F.when(F.col(col).isNull(), 1).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.exists(col, lambda x: x.isNull() | F.isnan(x)), 1).otherwise(0)).alias("bad"),
    ).first()
    if stats is None or stats["hi"] is None:
        raise ValueError("empty matrix")
    if stats["lo"] != stats["hi"]:
        raise ValueError(f"rows have different widths ({stats['lo']}..{stats['hi']})")
    if stats["nulls"] or stats["bad"]:
        raise ValueError("matrix holds null or NaN values")
    return int(stats["hi"])


def width(df: DataFrame, col: str = FEATURES) -> int:
    """Width of the rows (first row), cheap; use :func:`validate` for a full check."""
    row = df.select(F.size(col).alias("w")).first()
    if row is None:
        raise ValueError("empty matrix")
    return int(row["w"])
