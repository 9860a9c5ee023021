"""Operator 3: mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share
the total size; a target stops at ``MAX_COPIES`` times its source's size and the
excess is shared again, which is water-filling: ``min(level * weight, cap)``.
The sources' ratios of cap to weight, sorted, give the level by prefix sums.

A source's rate is target / size. Every document first gets ``floor(rate)``
certain whole copies. The rest is a Pareto order sample: each document has an
inclusion probability p with odds proportional to the root of its size, a
uniform number u from a hash of its id and text, and ranks by
(u / (1-u)) / (p / (1-p)); the factor of the odds is the same for all of a
source and doesn't change the ranks. Along the ranks, every document that fits into
the words still missing is taken and larger ones are set aside. At last one document
taken (or none) is exchanged for one left over, if that brings the source nearer to its target.

The cut is found in rounds, without gathering a source: of the documents that fit into the
gap, ranks fall into about sqrt(rows) buckets of each source, bucket sizes are
summed first, and only the bucket where the gap is crossed is ordered exactly. Behind the
crossing document go on those that fit into the smaller gap, until none does; what
was set aside stays so, as the gap only shrinks. Rows equal in
id, text and source are one row with a count in all of this, so a round takes as many of them as fit.

Defined cases: null text has size 0; documents of size 0 are taken 0 times;
a null source is one source; rows equal in id, text and source are
interchangeable and each may be taken or not; very long texts are set aside where they don't fit;
columns beside doc_id, text and source are not read unless kept under a prefix; an empty table gives an empty
mix. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matstream.llm.common import materialise, small

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources(source, source_size)`` (one row each) with ``weight`` and ``target``.

    Windows here run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), at)
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    # ascending by cap / weight: the first sources are full, the others share what is left at one level
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    s = s.withColumn("all_weight", F.sum("weight").over(whole))
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - full) / (F.col("all_weight") - used)  # if this source and later ones are not full
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(final * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "weight", target.alias("target"))


_U_BITS = 52


def _uniform(*cols: str) -> Column:
    """A number in (0, 1) from a hash of the columns, the same in every run."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    h = F.conv(F.substring(F.md5(joined.cast("binary")), 1, _U_BITS // 4), 16, 10).cast("long")
    return (h + F.lit(0.5)) / F.lit(float(1 << _U_BITS))


MAX_BROADCAST_SOURCES = 500_000  # under 100 bytes each


def pareto_mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the columns ``keep`` (as ``k_...``).

    ``copies`` is how often the whole document is taken; ``taken = copies * size``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.md5(text.cast("binary")).alias("text_md5"),
                       *[F.col(c).alias(f"k_{c}") for c in keep or []])
    odds = _uniform("doc_id", "text_md5", "source")
    inclusion = F.sqrt(F.greatest(F.col("size"), F.lit(1)).cast("double"))  # inclusion odds, up to a factor per source
    base = base.withColumn("inclusion", inclusion).withColumn("z", odds / (F.lit(1.0) - odds) / F.col("inclusion"))
    lean = materialise(base.groupBy("source", "doc_id", "text_md5", "size", "z").agg(
        F.count("*").alias("rows"), F.max("inclusion").alias("inclusion")), "mix-rank")
    sums = materialise(lean.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_rows"),
        F.avg("inclusion").alias("scale")), "mix-sum")
    few = sums.count() <= MAX_BROADCAST_SOURCES

    def of_source(df: DataFrame, by_source: DataFrame) -> DataFrame:
        return df.join(F.broadcast(by_source) if few else by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    plan = targets(sums.select("source", "source_size")).join(
        sums.select(F.col("source").alias("_s"), "n_rows", "scale"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("whole", F.floor(rate + F.lit(1e-12))).withColumn(
        "gap", F.col("target") - F.col("whole") * F.col("source_size")).select(
        F.col("source").alias("_s"), "source_size", "target", "whole", "gap", F.ceil(F.sqrt("n_rows")).alias("slots"), "scale")
    plan = materialise(plan.withColumn("rounds", F.lit(None).cast(_ROUNDS)), "mix-plan")
    while True:
        cuts = materialise(_round(lean, plan, of_source), "mix-round")
        if cuts.isEmpty():
            break
        plan = plan.join(cuts, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c")
        plan = plan.withColumn("rounds", F.when(F.col("round").isNull(), F.col("rounds")).otherwise(
            F.concat(F.coalesce("rounds", F.array().cast(_ROUNDS)), F.array("round")))).withColumn(
            "gap", F.coalesce("next_gap", "gap")).drop("round", "next_gap")
        plan = materialise(plan, "mix-plan")

    plan = materialise(plan.join(_exchange(lean, plan, of_source), F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c"),
                       "mix-last")
    gives, adds = (F.coalesce(_key() == F.col(c), F.lit(False)) for c in ("give", "add"))
    counted = F.least(_extra(), F.col("rows")) - gives.cast("long") + adds.cast("long")

    out = of_source(base, plan)
    # of some groups of equal rows only a part is taken: number just their rows, by task and position in it
    split = of_source(lean.where((F.col("rows") > 1) & (F.col("size") > 0)), plan).withColumn("extra", counted).where(
        (F.col("extra") > 0) & (F.col("extra") < F.col("rows"))).select(
        *[F.col(c).alias(f"_{c}") for c in ("source", "doc_id", "text_md5")], "extra")
    split = materialise(split, "mix-split")   # at most a few a source: a crossing group of each round and the exchange
    taken = ((_extra() > 0) & ~gives) | adds
    if not split.isEmpty():
        out = _numbered(out, split)
        taken = F.when(F.col("number").isNull(), taken).otherwise(F.col("number") <= F.col("extra"))
    copies = F.when(F.col("size") > 0, F.col("whole") + taken.cast("int")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken",
                      *[f"k_{c}" for c in keep or []])


_ROUNDS = "array<struct<gap:double,cross:struct<z:double,doc_id:bigint,text_md5:string>,part:bigint>>"


def _key() -> Column:
    """The place in the ranks of a source's documents."""
    return F.struct("z", "doc_id", "text_md5")


def _extra() -> Column:
    """Of a row of ``lean`` (or a document) with its source's plan: how many of its equal rows the rounds take."""
    def take(acc, r):
        fits = F.col("size") <= r["gap"]
        return F.when(fits & (r["cross"].isNull() | (_key() < r["cross"])), F.lit(_ALL)).when(
            fits & (_key() == r["cross"]), F.greatest(acc, r["part"])).otherwise(acc)

    return F.aggregate(F.coalesce("rounds", F.array().cast(_ROUNDS)), F.lit(0).cast("long"), take)


_ALL = 1 << 60


def _round(lean: DataFrame, plan: DataFrame, of_source) -> DataFrame:
    """One round of every source: ``_c, round, next_gap`` where a document fits into the gap."""
    rows = of_source(lean.where(F.col("size") > 0), plan.where(F.col("gap") >= 1))
    prev = F.element_at("rounds", -1)["cross"]   # behind the last crossing document; none crossed: all that fit are taken
    rows = rows.where((F.col("size") <= F.col("gap")) & (F.col("rounds").isNull() | (_key() > prev)))
    # monotone in z at every step, also in rounded arithmetic
    slot = F.floor((F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("z") * F.col("scale"))) * F.col("slots"))
    rows = rows.select("source", "doc_id", "text_md5", "size", "rows", "z", "gap", slot.alias("slot"))
    filled = rows.groupBy("source", "slot").agg(F.sum(F.col("size") * F.col("rows")).alias("slot_size"), F.max("gap").alias("gap"))
    by_slot = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    filled = materialise(filled.withColumn("before", F.coalesce(F.sum("slot_size").over(by_slot), F.lit(0))), "mix-slots")
    cut = filled.where((F.col("before") <= F.col("gap")) & (F.col("gap") < F.col("before") + F.col("slot_size"))).select(
        F.col("source").alias("_s"), F.col("slot").alias("cut_slot"), "before")
    all_fit = filled.groupBy("source").agg(F.sum("slot_size").alias("sum"), F.max("gap").alias("gap")).where(
        F.col("sum") <= F.col("gap")).select(
        F.col("source").alias("_c"), F.struct("gap", F.lit(None).cast("struct<z:double,doc_id:bigint,text_md5:string>").alias("cross"),
                                             F.lit(0).cast("long").alias("part")).alias("round"),
        (F.col("gap") - F.col("sum")).alias("next_gap"))
    by_rank = Window.partitionBy("source").orderBy("z", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    here = of_source(rows, cut).where(F.col("slot") == F.col("cut_slot")).withColumn(
        "start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(by_rank), F.lit(0)))
    here = here.where((F.col("start") <= F.col("gap")) & (F.col("gap") < F.col("start") + F.col("size") * F.col("rows")))
    part = F.floor((F.col("gap") - F.col("start")) / F.col("size"))
    crossed = here.select(
        F.col("source").alias("_c"), F.struct("gap", _key().alias("cross"), part.alias("part")).alias("round"),
        (F.col("gap") - F.col("start") - part * F.col("size")).alias("next_gap"))
    return crossed.unionByName(all_fit)


def _exchange(lean: DataFrame, plan: DataFrame, of_source) -> DataFrame:
    """``_c, give, add``: the exchange of one taken document (or none) for one left over that brings the source nearest.

    Works on a source's distinct sizes (as many as a text has lengths): every taken size and 0, moved by the gap,
    looks for the next free size below and above it.
    """
    rows = of_source(lean.where(F.col("size") > 0), plan).withColumn("used", F.least(_extra(), F.col("rows")))
    free = rows.where(F.col("used") < F.col("rows")).groupBy("source", "size").agg(F.min(_key()).alias("key"))
    used = rows.where(F.col("used") > 0).groupBy("source", "size").agg(F.max(_key()).alias("key"), F.max("gap").alias("gap"))
    none = plan.where(F.col("gap") > 0).select(F.col("_s").alias("source"), F.lit(0).cast("long").alias("size"),
                                               F.lit(None).cast(used.schema["key"].dataType).alias("key"), "gap")
    asks = used.unionByName(none).select("source", (F.col("size") + F.col("gap")).alias("at"), "gap",
                                         F.struct("size", "key").alias("ask"), F.lit(None).cast(
                                             f"struct<size:bigint,key:{used.schema['key'].dataType.simpleString()}>").alias("free"))
    offers = free.select("source", F.col("size").cast("double").alias("at"), F.lit(None).cast("double").alias("gap"),
                         F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"), F.struct("size", "key").alias("free"))
    by_size = Window.partitionBy("source").orderBy("at")
    below = F.last("free", ignorenulls=True).over(by_size.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("free", ignorenulls=True).over(by_size.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    met = asks.unionByName(offers).select("source", "gap", "ask", "at", F.array(below, above).alias("near")).where(
        F.col("ask").isNotNull()).select("source", "gap", "ask", "at", F.explode("near").alias("near"))
    met = met.withColumn("miss", F.abs(F.col("near.size") - F.col("at"))).where(F.col("miss") < F.col("gap"))
    best = met.groupBy("source").agg(F.min(F.struct("miss", F.col("ask.size").alias("a"), F.col("near.size").alias("b"),
                                                    F.col("ask.key").alias("give"), F.col("near.key").alias("add"))).alias("p"))
    return best.select(F.col("source").alias("_c"), "p.give", "p.add")


def _numbered(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with ``extra`` of the given groups and ``number`` (from 1) among their equal rows, null elsewhere."""
    key = ["source", "doc_id", "text_md5"]
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    groups = small(groups)
    rest = docs.join(groups, same, "left_anti").withColumn("extra", F.lit(0).cast("long")).withColumn(
        "number", F.lit(None).cast("long"))
    rows = docs.join(groups, same).drop(*[f"_{c}" for c in key]).withColumn(
        "_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33))
    rows = materialise(rows, "mix-equal")
    counts = rows.groupBy(*key, "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        *[F.col(c).alias(f"_{c}") for c in key], F.col("_task").alias("_t"), "_off")
    local = F.row_number().over(Window.partitionBy(*key, "_task").orderBy("_id"))
    rows = rows.withColumn("_local", local).join(counts, [*same, F.col("_task") == F.col("_t")])
    rows = rows.withColumn("number", (F.col("_off") + F.col("_local")).cast("long"))
    return rest.unionByName(rows.select(rest.columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document's columns, once per copy taken, with the copy's number."""
    cols = docs.columns
    mix = pareto_mix(docs, cols).where(F.col("copies") > 0)
    number = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mix.select(*[F.col(f"k_{c}").alias(c) for c in cols], number.alias("copy"))
