"""Connected components of a link table, as DataFrame jobs (alternating large and small stars).

Every round hooks each node's larger neighbours to its smallest neighbour, then
its smaller ones; the edge count never grows and a few rounds end in stars.
Minimums are combined before the shuffle and a hot centre's edges meet in joins
that adaptive execution can split, so no task holds a whole component.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.llm.common import materialise


EDGES_PER_TASK = 200_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over edges (u, v) with u > v; returns edges of the same form.

    The minimums are written out first, so both sides of the join are plain
    exchanges and adaptive execution can split a hot node.
    """
    low = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-min", tasks)
    if large:
        # seen from the smaller end w: its larger neighbour u hooks to the least neighbour of w, or to w
        out = edges.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select(
            "u", F.coalesce("m", "v").alias("v"))
    else:
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links(a, b)`` (any direction, repeats and self-links allowed) -> ``id, component``.

    ``component`` is the smallest id reachable; only ids with a link to another id have a row.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = materialise(e, "cc")
    mark = None
    while True:
        # in star form every u has one v and no v is a u; the number of edges never grows
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
        tasks = math.ceil(state[0] / EDGES_PER_TASK)
        e = materialise(_star(_star(e, True, tasks), False, tasks), "cc", tasks)
    roots = e.select(F.col("v").alias("id")).distinct()
    return materialise(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))), "cc-found",
        math.ceil(max(state[0], 1) / EDGES_PER_TASK))
