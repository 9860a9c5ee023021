"""Sinks (S3-S8): text matrix formats and run outputs.

The text formats are also transforms returning the DataFrame of lines or
cells, so they can be checked and composed before anything is written.
Values are printed with ``digits`` decimals (``None``: Spark's own double
to string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matstream.sources.frames import FEATURES, ROW_ID


def _fmt(x: Column, digits: int | None) -> Column:
    return x.cast("string") if digits is None else F.format_string(f"%.{digits}f", x)


def csv_lines(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """Comma-separated lines at full precision (what :func:`read_dense_csv` reads)."""
    return df.select(ROW_ID, F.array_join(F.transform(col, lambda x: x.cast("string")), ",").alias("value"))


def dense_text_lines(df: DataFrame, digits: int | None = None, col: str = FEATURES) -> DataFrame:
    """S3: one row per line, every value followed by a space."""
    vals = F.transform(col, lambda x: F.concat(_fmt(x, digits), F.lit(" ")))
    return df.select(ROW_ID, F.array_join(vals, "").alias("line"))


def lil_lines(df: DataFrame, digits: int | None = None, col: str = FEATURES) -> DataFrame:
    """``{j:v,j:v}`` per row, zeros skipped, ``{}`` for an empty row."""
    pairs = F.transform(col, lambda x, i: F.struct(i.alias("j"), x.alias("v")))
    nz = F.filter(pairs, lambda p: p["v"] != 0)
    txt = F.transform(nz, lambda p: F.concat(p["j"].cast("string"), F.lit(":"), _fmt(p["v"], digits)))
    return df.select(ROW_ID, F.concat(F.lit("{"), F.array_join(txt, ","), F.lit("}")).alias("line"))


def coo_cells(df: DataFrame, col: str = FEATURES) -> DataFrame:
    """``i, j, v`` per non-zero cell."""
    return (df.select(F.col(ROW_ID).alias("i"), F.posexplode(col).alias("j", "v"))
            .where(F.col("v") != 0))


def coo_lines(df: DataFrame, digits: int | None = None, col: str = FEATURES) -> DataFrame:
    c = coo_cells(df, col)
    return c.select(F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string"),
                                _fmt(F.col("v"), digits)).alias("line"))


def write_dense_text(df: DataFrame, path: str, digits: int | None = None, col: str = FEATURES) -> None:
    """S3 to text files (row order kept by sorting on ``row_id`` within the range partitions)."""
    dense_text_lines(df, digits, col).orderBy(ROW_ID).select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, col: str = FEATURES) -> None:
    """Dense comma-separated text, readable by :func:`read_dense_csv`."""
    csv_lines(df, col).orderBy(ROW_ID).select("value").write.mode("overwrite").text(path)


def write_lil(df: DataFrame, path: str, digits: int | None = None, col: str = FEATURES) -> None:
    """S4 to text files."""
    lil_lines(df, digits, col).orderBy(ROW_ID).select("line").write.mode("overwrite").text(path)


def write_coo(df: DataFrame, path: str, digits: int | None = None, col: str = FEATURES) -> None:
    """S5 to text files."""
    coo_lines(df, digits, col).write.mode("overwrite").text(path)


def _tag(df: DataFrame, settings: dict) -> DataFrame:
    return df.select(*df.columns, *[F.lit(v).alias(k) for k, v in settings.items()])


def write_scores(scores: DataFrame, path: str, **settings) -> None:
    """The score table tagged with the run settings (block, stride, k, ...), appended."""
    _tag(scores, settings).write.mode("append").parquet(path)


def write_model(model: DataFrame, path: str, **settings) -> None:
    """Singular values and vectors per step, tagged, appended."""
    _tag(model, settings).write.mode("append").parquet(path)


def write_stats(stats: DataFrame, path: str, detail: bool = True, **settings) -> None:
    """Run statistics; ``detail=False`` keeps step, change positions and the run means."""
    from matstream.plans.report import run_summary

    if not detail:
        # the run means are one row of two numbers
        means = run_summary(stats).first().asDict()
        stats = stats.select("step", "block_num", "change_at", *[F.lit(v).alias(k) for k, v in means.items()])
    _tag(stats, settings).write.mode("append").parquet(path)
