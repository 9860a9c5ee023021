import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from matstream.operators.windows import expand_windows, schedule_frame, window_schedule, with_chunk


def brute_steps(n, block, stride, max_slides):
    steps = [(0, 0, 0, 0, block)]
    i, lo = block, 0
    while i < n:
        st = stride if i + stride < n else n - i
        steps.append((len(steps), lo, lo + st, i, i + st))
        lo += st
        i += st
        if max_slides is not None and len(steps) - 1 == max_slides:
            break
    return steps


@pytest.mark.parametrize("n,block,stride,cap", [(500, 100, 50, 20), (500, 97, 41, None), (500, 97, 41, 3),
                                                (100, 100, 10, 20), (1000, 100, 1, 20), (523, 60, 60, None)])
def test_schedule_rules(n, block, stride, cap):
    s = window_schedule(n, block, stride, cap)
    assert s.steps == brute_steps(n, block, stride, cap)
    for t in range(1, len(s.steps)):
        lo, hi = s.window(t)
        assert hi - lo == block  # the window size stays block


def test_schedule_frame_matches(spark):
    s = window_schedule(500, 97, 41, None)
    got = [tuple(r) for r in schedule_frame(spark, 500, 97, 41, None).orderBy("step").collect()]
    assert got == s.steps


def test_bad_parameters():
    with pytest.raises(ValueError):
        window_schedule(50, 100, 10)
    with pytest.raises(ValueError):
        window_schedule(500, 10, 20)


@pytest.mark.parametrize("n,block,stride,cap", [(500, 100, 50, 20), (500, 97, 41, None), (500, 97, 41, 4)])
def test_chunks_and_memberships(spark, n, block, stride, cap):
    s = window_schedule(n, block, stride, cap)
    df = spark.range(n).withColumnRenamed("id", "row_id")
    mem = {(r.step, r.row_id) for r in expand_windows(df, s).collect()}
    want = {(t, r) for t in range(len(s.steps)) for r in range(*s.window(t))}
    assert mem == want
    chunks = {r.row_id: r.chunk for r in with_chunk(df, s).collect()}
    bounds = s.chunk_bounds()
    for c, lo, hi, first, last in bounds:
        for r in range(lo, hi):
            assert chunks[r] == c
            steps_of_r = sorted(t for t, rr in mem if rr == r)
            assert steps_of_r == list(range(first, last + 1))
    assert max(chunks) == s.end - 1


def test_long_schedules_stay_linear_and_wide(spark):
    s = window_schedule(100_050, 50, 1)
    t0 = time.perf_counter()
    bounds = s.chunk_bounds()
    assert time.perf_counter() - t0 < 2
    assert s.last == 100_000 and len(bounds) == 100_050
    tail = s.chunk_bounds(99_000)
    assert tail == [b for b in bounds if b[1] >= 99_000]
    df = spark.range(100_000, 100_050).withColumnRenamed("id", "row_id")
    ids = {r.row_id: r.chunk for r in with_chunk(df, s).collect()}   # beyond 2^31
    assert ids == {lo: c for c, lo, _, _, _ in bounds[100_000:]} and max(ids.values()) > 1 << 31
