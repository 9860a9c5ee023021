"""Table reading and shared-folder materialisation for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matstream.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, tasks: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor cannot make earlier stages run again,
    and non-deterministic inputs are fixed.  ``tasks`` bounds the tasks of the
    last stage, for tables whose size is known to be small; ``codec`` names a
    compression other than the session's.
    """
    df = df.coalesce(tasks) if tasks else df
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path, compression=codec)
    return spark.read.schema(schema).parquet(path)


def training_part(col, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


BROADCAST_ROWS = 1_000_000  # of a few numbers each: under 100 MB


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (materialised) marked for broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df
