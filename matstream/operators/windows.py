"""Sliding windows over numbered rows (O4-O6) and the chunks they imply.

Step 0 is the first block ``[0, block)``.  Step ``t >= 1`` enters
``[i, i + st)`` with ``i = block + (t-1) * stride`` and drops the ``st``
oldest rows; ``st = n - i`` when ``i + stride >= n`` (a short last step).
The run stops at the end of the data or after ``max_slides`` slides (20 in
the reference; ``None`` for no cap).  Only the last step can be short, so
every window is the contiguous range ``[drop_hi, enter_hi)``.

A row ``r`` is in the windows of the contiguous steps ``first..last``; rows
with the same pair enter and leave together and form a *chunk*.  Both ends
are plain arithmetic on ``row_id``, so no join is needed to place a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matstream.sources.frames import ROW_ID

SCHEDULE_COLUMNS = ["step", "drop_lo", "drop_hi", "enter_lo", "enter_hi"]


class _Steps(Sequence):
    """The tuples ``(step, drop_lo, drop_hi, enter_lo, enter_hi)``, computed when asked for (nothing is stored)."""

    def __init__(self, sched: "Schedule"):
        self._s = sched

    def __len__(self) -> int:
        return self._s.last + 1

    def __getitem__(self, t: int) -> tuple[int, int, int, int, int]:
        s = self._s
        if not -len(self) <= t < len(self):
            raise IndexError(t)
        t %= len(self)
        if t == 0:
            return 0, 0, 0, 0, s.block
        lo = (t - 1) * s.stride
        i = s.block + lo
        st = min(s.stride, s.n - i)
        return t, lo, lo + st, i, i + st

    def __eq__(self, other) -> bool:
        return list(self) == list(other)


@dataclass(frozen=True)
class Schedule:
    n: int
    block: int
    stride: int
    max_slides: int | None = None

    @property
    def steps(self) -> _Steps:
        return _Steps(self)

    @property
    def last(self) -> int:
        slides = -(-(self.n - self.block) // self.stride)
        return slides if self.max_slides is None else min(slides, self.max_slides)

    @property
    def end(self) -> int:
        """One past the last row that any step reads."""
        return self.steps[-1][4]

    def first_step_of(self, r: int) -> int:
        """The step at which row ``r`` enters."""
        return 0 if r < self.block else (r - self.block) // self.stride + 1

    def window(self, t: int) -> tuple[int, int]:
        s = self.steps[t]
        return s[2], s[4]

    # --- placement of a row, as Spark expressions -------------------------
    def first_step(self, rid: Column) -> Column:
        return F.when(rid < F.lit(self.block), F.lit(0)).otherwise(
            F.floor((rid - F.lit(self.block)) / F.lit(self.stride)).cast("int") + F.lit(1))

    def last_step(self, rid: Column) -> Column:
        # steps 1..T-1 are full, so their drop_hi is t * stride; only step T can be short
        T = self.last
        last_drop_hi = self.steps[T][2]
        full = F.least(F.floor(rid / F.lit(self.stride)).cast("int"), F.lit(max(T - 1, 0)))
        return F.when(rid >= F.lit(last_drop_hi), F.lit(T)).otherwise(full)

    def chunk(self, rid: Column) -> Column:
        """Chunk id ``first * (T + 1) + last`` (BIGINT); increasing along the rows."""
        return self.first_step(rid).cast("long") * F.lit(self.last + 1) + self.last_step(rid)

    def chunk_bounds(self, start: int = 0) -> list[tuple[int, int, int, int, int]]:
        """Driver-side list ``(chunk, lo, hi, first, last)`` of the non-empty chunks from row ``start`` on.

        ``start`` is 0 or the first row of a chunk.  Linear in the steps whose
        rows reach ``start`` or lie behind it.
        """
        t0 = min(self.first_step_of(start), self.last)
        t = np.arange(t0, self.last + 1)
        enter_hi = np.minimum(self.block + t * self.stride, self.n)
        drop_hi = np.where(t > 0, enter_hi - self.block, 0)
        cuts = np.unique(np.concatenate([[start, self.end], enter_hi, drop_hi]))
        cuts = cuts[cuts >= start]
        lo, hi = cuts[:-1], cuts[1:]
        first = t0 + np.searchsorted(enter_hi, lo, side="right")
        last = t0 + np.searchsorted(drop_hi, lo, side="right") - 1
        ids = first * (self.last + 1) + last
        return list(zip(ids.tolist(), lo.tolist(), hi.tolist(), first.tolist(), last.tolist()))


def window_schedule(n: int, block: int, stride: int, max_slides: int | None = None) -> Schedule:
    """The step table as a driver-side object of constant size."""
    if block < 2 or n < block:
        raise ValueError(f"need n >= block >= 2 (n={n}, block={block})")
    if stride < 1 or stride > block:
        raise ValueError(f"need 1 <= stride <= block (stride={stride}, block={block})")
    return Schedule(n, block, stride, max_slides)


def schedule_frame(spark: SparkSession, n: int, block: int, stride: int,
                   max_slides: int | None = None) -> DataFrame:
    """The step table ``step, drop_lo, drop_hi, enter_lo, enter_hi`` from ``spark.range``."""
    sched = window_schedule(n, block, stride, max_slides)
    T = sched.last
    t = F.col("id")
    enter_lo = F.lit(block) + (t - 1) * F.lit(stride)
    enter_hi = F.least(enter_lo + F.lit(stride), F.lit(n))
    slides = spark.range(1, T + 1).select(
        t.cast("int").alias("step"), ((t - 1) * F.lit(stride)).alias("drop_lo"),
        ((t - 1) * F.lit(stride) + enter_hi - enter_lo).alias("drop_hi"),
        enter_lo.alias("enter_lo"), enter_hi.alias("enter_hi"))
    first = spark.range(1).select(F.lit(0).alias("step"), F.lit(0).cast("long").alias("drop_lo"),
                                  F.lit(0).cast("long").alias("drop_hi"), F.lit(0).cast("long").alias("enter_lo"),
                                  F.lit(block).cast("long").alias("enter_hi"))
    return first.unionByName(slides)


def slide(window: DataFrame, incoming: DataFrame, st: int, id_col: str = ROW_ID) -> DataFrame:
    """Drop the ``st`` oldest rows of a window and append ``incoming``."""
    lo = window.agg(F.min(id_col)).first()[0]
    return window.where(F.col(id_col) >= F.lit(lo + st)).unionByName(incoming)


def window_rows(df: DataFrame, sched: Schedule, step: int, id_col: str = ROW_ID) -> DataFrame:
    """Rows of the window at ``step`` (a range predicate)."""
    lo, hi = sched.window(step)
    return df.where((F.col(id_col) >= F.lit(lo)) & (F.col(id_col) < F.lit(hi)))


def expand_windows(df: DataFrame, sched: Schedule, id_col: str = ROW_ID) -> DataFrame:
    """Every (step, row) membership at once.

    Arithmetic, not a join: a row belongs to the steps ``first..last``.
    """
    rid = F.col(id_col)
    rows = df.where(rid < F.lit(sched.end))
    return rows.select(F.explode(F.sequence(sched.first_step(rid), sched.last_step(rid))).alias("step"), "*")


def with_chunk(df: DataFrame, sched: Schedule, id_col: str = ROW_ID, name: str = "chunk") -> DataFrame:
    """Rows read by the schedule, tagged with their chunk id."""
    rid = F.col(id_col)
    return df.where(rid < F.lit(sched.end)).withColumn(name, sched.chunk(rid))
