"""Operator 6: benchmark decontamination with a broadcast set of test n-grams (DataFrame functions only).

Benchmark items become windows of ``N`` consecutive normalised words (an item
of fewer is one window). Their distinct windows, hashed, form a table that is
broadcast after its rows were counted (``MAX_BROADCAST_WINDOWS``; a larger
table meets the documents' hashes and positions by shuffle instead, with the same result). Every document
window is probed by hash inside one generate-and-join stage; a hit is verified
against the window's words. Window hashes are built by doubling (pairs, fours,
eights), so a word is hashed once and each window costs a few combinations.

Defined cases: null or empty text has no words and no hit; an item without
words has no window; a null item_id marks spans but is not listed; repeated
documents each get their row; repeated items count once; an empty benchmark
leaves every document clean; extra columns are ignored or kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matstream.llm.common import materialise, small

N = 10
MAX_BROADCAST_WINDOWS = 1_000_000  # about 100 bytes each

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # on lower-cased text
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # separators, then a word
SALTS = 8
_END = -1  # hash of the mark behind a document's windows


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _spans_of(length: int) -> list[int]:
    """Powers of two whose sum is ``length``, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _salted(length: int):
    return lambda x: F.xxhash64(x, F.lit(length))


def _window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``w_L``, the hashes of all windows of L words, per length; needs ``tokens``."""
    cols = df.columns
    df = df.select(*cols, F.transform("tokens", lambda x: F.xxhash64(x)).alias("p_1"))
    top, width = max(lengths), 1
    powers = [1]
    while width * 2 <= top:
        p = f"p_{width}"
        nxt = F.zip_with(F.col(p), F.slice(F.col(p), F.lit(width + 1), F.size(p)), lambda x, y: F.xxhash64(x, y))
        df = df.select(*cols, *[f"p_{q}" for q in powers], nxt.alias(f"p_{2 * width}"))
        width *= 2
        powers.append(width)
    for length in lengths:
        parts = _spans_of(length)
        h, at = F.col(f"p_{parts[0]}"), parts[0]
        for part in parts[1:]:
            h = F.zip_with(h, F.slice(F.col(f"p_{part}"), F.lit(at + 1), F.size(f"p_{part}")),
                           lambda x, y: F.xxhash64(x, y))
            at += part
        full = F.slice(h, F.lit(1), F.greatest(F.size("tokens") - F.lit(length - 1), F.lit(0)))
        df = df.withColumn(f"w_{length}", F.transform(full, _salted(length)))
    return df.select(*cols, *[f"w_{x}" for x in lengths])


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """Distinct windows ``(hash, length, words, items)`` and the lengths that occur (1..N)."""
    b = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    b = b.withColumn("length", F.least(F.size("tokens"), F.lit(N)))
    at = F.explode_outer(F.sequence(F.lit(1), F.size("tokens") - F.col("length") + 1))
    w = b.select("item_id", "tokens", "length", at.alias("at")).select(
        "item_id", "length", F.slice("tokens", F.col("at"), F.col("length")).alias("tokens"))
    w = w.groupBy("length", "tokens").agg(F.collect_set("item_id").alias("items"))
    w = materialise(w, "dc-window")
    lengths = sorted(r[0] for r in w.select("length").distinct().collect())  # at most N values
    if not lengths:
        return w.select(F.lit(0).cast("long").alias("hash"), "length", F.lit("").alias("words"), "items"), []
    hashed = _window_hashes(w, lengths)
    pick = F.coalesce(*[F.when(F.col("length") == x, F.get(f"w_{x}", F.lit(0))) for x in lengths])
    return hashed.select(pick.alias("hash"), "length", F.array_join("tokens", " ").alias("words"), "items"), lengths


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: ``doc_id, text_key, n_words, covered`` (sorted hit word positions) and ``items``."""
    windows, lengths = benchmark_windows(benchmark)
    windows = materialise(windows.select("hash", F.col("length").cast("int").alias("length"), "words", "items"), "dc-known")
    t = docs.select("doc_id", F.xxhash64("text").alias("text_key"), tokens(F.col("text")).alias("tokens"))
    if lengths:
        t = _window_hashes(t, lengths)
    if lengths and windows.count() > MAX_BROADCAST_WINDOWS:
        return _hits_by_shuffle(t, windows, lengths)
    probes = F.concat(*[F.col(f"w_{x}") for x in lengths], F.array(F.lit(_END).cast("long")))
    t = t.select("doc_id", "text_key", "tokens", probes.alias("probes"))
    # outer: ``probes`` is never empty, and no filter on its size is inferred and pushed below the hashing
    t = t.select("doc_id", "text_key", "tokens", F.size("probes").alias("n_probes"),
                 F.posexplode_outer("probes").alias("at", "hash"))
    end = docs.sparkSession.range(1).select(F.lit(_END).cast("long").alias("hash"), F.lit(0).alias("length"), F.lit("").alias("words"),
                                            F.array().cast(windows.schema["items"].dataType).alias("items"))
    known = F.broadcast(materialise(windows.unionByName(end), "dc-probe"))
    n_words = F.size("tokens")
    # windows of the shorter lengths come first in ``probes``
    before, shift = F.lit(0), F.lit(0)
    for x in lengths:
        shift = F.when(F.col("length") == x, before).otherwise(shift)
        before = before + F.greatest(n_words - F.lit(x - 1), F.lit(0))
    found = t.join(known, "hash").withColumn("first", F.col("at") - shift)
    is_end = (F.col("length") == 0) & (F.col("at") == F.col("n_probes") - 1)
    same = (F.col("length") > 0) & (F.col("first") >= 0) & (
        F.array_join(F.slice("tokens", F.greatest(F.col("first"), F.lit(0)) + 1, F.col("length")), " ") == F.col("words"))
    found = found.where(is_end | same).select(
        "doc_id", "text_key", n_words.alias("n_words"), F.when(~is_end, F.struct("first", "length")).alias("hit"),
        F.when(~is_end, F.col("items")).alias("items"), F.when(is_end, 1).alias("row"))
    grouped = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.collect_set("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.count("row").alias("rows"))
    out = grouped.select("doc_id", "text_key", "n_words", _covered("hits").alias("covered"), "items", "rows")
    # equal rows were probed as one group: give each its row back
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")).drop("copy", "rows")


def _covered(hits: str) -> Column:
    """Sorted word positions inside the hits ``(first, length, ...)``."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.sequence(h["first"], h["first"] + h["length"] - 1)))))


def _hits_by_shuffle(t: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The result of :func:`hits` for window tables too large to broadcast.

    Only hashes and positions meet the windows, in ``SALTS`` parts so that a passage most documents hold
    is spread; what is found goes back to its document, once, and is verified there against its words.
    """
    rows = t.select("doc_id", "text_key", "tokens")
    before, shift = F.lit(0), F.lit(0)
    for x in lengths:
        shift = F.when(F.col("length") == x, before).otherwise(shift)
        before = before + F.greatest(F.col("n_words") - F.lit(x - 1), F.lit(0))
    lean = t.select("doc_id", "text_key", F.size("tokens").alias("n_words"), F.concat(*[F.col(f"w_{x}") for x in lengths]).alias("probes"))
    lean = lean.select("doc_id", "text_key", "n_words", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).alias("salt"),
                       F.posexplode("probes").alias("at", "hash"))
    known = windows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    found = lean.join(known.hint("shuffle_hash"), ["hash", "salt"]).withColumn("first", F.col("at") - shift).where(F.col("first") >= 0)
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_set(F.struct("first", "length", "words", "items")).alias("found"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    real = F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda h: F.array_join(
        F.slice("tokens", h["first"] + 1, h["length"]), " ") == h["words"])
    out = rows.join(found, same, "left").withColumn("real", real)
    items = F.array_distinct(F.flatten(F.transform("real", lambda h: h["items"])))
    return out.select("doc_id", "text_key", F.size("tokens").alias("n_words"), _covered("real").alias("covered"), items.alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, benchmark items found."""
    h = hits(docs, benchmark)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return h.select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                    F.size("covered").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                    (F.size("covered") > 0).alias("contaminated"))


def _without(text: Column, covered: Column) -> Column:
    """The text less its covered words (with the separators before them), in order."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    n = F.size(pieces)
    # gaps between covered words: from one covered position to the next
    left = F.concat(F.array(F.lit(-1)), covered)
    right = F.concat(covered, F.array(n))
    gaps = F.filter(F.arrays_zip(left.alias("l"), right.alias("r")), lambda g: g["r"] - g["l"] > 1)
    kept = F.transform(gaps, lambda g: F.array_join(F.slice(pieces, g["l"] + 2, g["r"] - g["l"] - 1), ""))
    return F.concat(F.array_join(kept, ""), tail)


DROP_SHARE = 0.5


def clean(docs: DataFrame, benchmark: DataFrame, drop_share: float = DROP_SHARE) -> DataFrame:
    """``docs`` less the hit spans; a document with more than ``drop_share`` of its words hit goes."""
    cols = docs.columns
    h = hits(docs, benchmark).where(F.size("covered") > 0).select(
        F.col("doc_id").alias("_dc_id"), F.col("text_key").alias("_dc_key"), F.col("covered").alias("_dc_covered"),
        F.col("n_words").alias("_dc_words")).dropDuplicates(["_dc_id", "_dc_key"])
    h = materialise(h, "dc-hit")
    words = h.agg(F.coalesce(F.sum(F.size("_dc_covered")), F.lit(0))).first()[0]
    h = small(h) if words <= MAX_BROADCAST_WINDOWS else h
    keyed = docs.withColumn("_dc_text_key", F.xxhash64("text"))
    j = keyed.join(h, F.col("doc_id").eqNullSafe(F.col("_dc_id")) & (F.col("_dc_text_key") == F.col("_dc_key")), "left")
    hit = F.col("_dc_covered").isNotNull()
    j = j.where(~hit | (F.size("_dc_covered") <= F.col("_dc_words") * F.lit(drop_share)))
    text = F.when(hit, _without(F.col("text"), F.col("_dc_covered"))).otherwise(F.col("text"))
    j = j.withColumn("text", text)
    if "n_chars" in cols:
        j = j.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return j.select(*cols)
