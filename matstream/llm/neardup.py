"""Operator 10: near-duplicate documents by fast similarity sketching.

A document's set holds the distinct five-word shingles of its whole text. The
sketch has ``T`` coordinates. In round ``i < T`` every element is hashed to a
random coordinate, in round ``T + j`` to coordinate ``j``; a coordinate keeps
its smallest (round, hash) and a document stops once all are filled. So every
coordinate fills after at most ``2 T`` rounds, two sets agree in a coordinate
with probability equal to their Jaccard similarity, and agreement
concentrates as for independent hashes.  ``BANDS`` bands of ``T / BANDS``
coordinates give buckets: a pair at similarity 0.75 shares none with
probability 5e-6.

Exact copies are one class from the start. Buckets are compared by pivots:
all members with the bucket's smallest and largest id (unless set sizes rule a
pair out, or signatures of four bits a coordinate agree in far fewer than any
similar pair's would). Where a bucket then still holds several components, every
member outside its largest component is compared with all members, in tiles of
bounded size: first by wider signatures of ``WIDE`` coordinates, then whole texts of those alone that have
a possible partner in their tile. So a bucket of copies costs linear work, nothing emits all pairs
of a group, documents that only share a template move no text, and no candidate is dropped.
Every candidate is confirmed on the full shingle sets.

Defined cases: null or empty text gives an empty set and no link; rows without
a doc_id link with nothing, keep ``component_id`` null and are kept; repeated
rows share their result; rows sharing a doc_id but not the text count as one
document whose links are those of any of its texts; an empty table gives an empty
result; very long texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.llm import textvec as tv
from matstream.llm.common import materialise, small
from matstream.llm.components import connected_components

T = 128
BANDS = 32
SHINGLE = 5
NUM, DEN = 75, 100  # link when DEN * intersection >= NUM * union

WIDE = 512  # coordinates of the wider signatures
WIDE_DOCS = 2048  # sketched together

SKETCH_BYTES = 1 << 19  # of text hashed together; bounds a worker's arrays

_SEEDS = tv.mix(np.arange(1, 2 * WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SKETCH = "doc_id long, text_key long, n_shingles long, d1 long, d2 long, bands array<long>, sig array<long>"

#: four bits of every coordinate; a chance agreement has probability 1/16
SIG_WORDS = T // 16


def least_agreement(t: int) -> int:
    """Five standard deviations below what a pair at the threshold agrees in (a miss has probability 3e-7)."""
    mean = t * (NUM / DEN + (1 - NUM / DEN) / 16)
    return math.floor(mean - 5 * math.sqrt(mean * (1 - mean / t)))


MIN_AGREE, MIN_WIDE = least_agreement(T), least_agreement(WIDE)
_SIG = [f"s{i}" for i in range(SIG_WORDS)]


def fast_similarity_sketch(h: np.ndarray, doc: np.ndarray, n_docs: int, t: int = T) -> np.ndarray:
    """Sketches (n_docs x t, uint64) of the sets given as distinct hashes grouped by document."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(n_docs * t, empty, np.uint64)
    round_bits = (2 * t - 1).bit_length()
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(h):
                break
            x = tv.mix(h ^ _SEEDS[i])
            bins = (x & np.uint64(t - 1)).astype(np.int64) if i < t else np.full(len(h), i - t)
            value = (np.uint64(i) << np.uint64(64 - round_bits)) | (x >> np.uint64(round_bits))
            np.minimum.at(sketch, doc * t + bins, value)
            open_docs = (sketch.reshape(n_docs, t) == empty).any(axis=1)
            more = open_docs[doc]
            h, doc = h[more], doc[more]
    return sketch.reshape(n_docs, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, t = sketch.shape
    part = sketch.reshape(n, bands, t // bands)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (n, bands)).copy()
        for j in range(t // bands):
            acc = tv.mix(acc ^ part[:, :, j])
    return acc.view(np.int64)


def signatures(sketch: np.ndarray) -> np.ndarray:
    """The low bits of the hash part of 16 coordinates in each long (n_docs x SIG_WORDS)."""
    n, t = sketch.shape
    nibbles = tv.mix(sketch) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(nibbles.reshape(n, t // 16, 16) << shifts, axis=2).view(np.int64)


def _lists(rows: np.ndarray, some: np.ndarray) -> pa.ListArray:
    """A list per document: the next row of ``rows`` where ``some``, else empty."""
    ends = np.cumsum(np.where(some, rows.shape[1], 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rows.reshape(-1)))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = tv.text_buffer(batch.column("text"))
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for lo, hi in tv.chunks(off, SKETCH_BYTES):
            n = hi - lo
            w = tv.words(raw, off, lo, hi)
            h, doc = tv.distinct_per_doc(*tv.shingles(w, SHINGLE), n)
            count = np.bincount(doc, minlength=n).astype(np.int64)
            d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                np.add.at(d1, doc, tv.mix(h ^ np.uint64(0x243F6A8885A308D3)))
                np.add.at(d2, doc, tv.mix(h ^ np.uint64(0x13198A2E03707344)))
            some = count > 0
            place = np.cumsum(some) - 1
            sketch = fast_similarity_sketch(h, place[doc], int(some.sum()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, n), keys.slice(lo, n), pa.array(count), pa.array(d1.view(np.int64)),
                 pa.array(d2.view(np.int64)), _lists(band_keys(sketch), some), _lists(signatures(sketch), some)],
                names=["doc_id", "text_key", "n_shingles", "d1", "d2", "bands", "sig"])


def _sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a column, with the text index."""
    raw, off = tv.text_buffer(col)
    hs, ds = [], []
    for lo, hi in tv.chunks(off):
        h, d = tv.distinct_per_doc(*tv.shingles(tv.words(raw, off, lo, hi), SHINGLE), hi - lo)
        hs.append(h)
        ds.append(d + lo)
    return (np.concatenate(hs), np.concatenate(ds)) if hs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


VERIFY_ROWS = 256  # pairs confirmed together


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, VERIFY_ROWS):
            batch = whole.slice(at, VERIFY_ROWS)
            n = batch.num_rows
            ha, da = _sets(batch.column("text_a"))
            hb, db = _sets(batch.column("text_b"))
            d = np.concatenate([da, db])
            order = np.argsort(d, kind="stable")
            h, d = np.concatenate([ha, hb])[order], d[order]
            for lo, hi in itertools.pairwise(np.searchsorted(d, np.arange(n + 1))):
                h[lo:hi].sort()
            same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
            inter = np.bincount(d[1:][same], minlength=n)
            union = np.bincount(da, minlength=n) + np.bincount(db, minlength=n) - inter
            ok = (DEN * inter >= NUM * union) & (union > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: set size, 128-bit set digest, band keys (none for an empty set)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_sketch_batches, _SKETCH)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc ids whose full sets are similar enough."""
    t = _texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), docs)
    with_a = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(t.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a long, b long")


def _agreement():
    """In how many coordinates the signatures s0.. and p0.. agree."""
    total = F.lit(T)
    for i in range(SIG_WORDS):
        d = F.col(f"s{i}").bitwiseXOR(F.col(f"p{i}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        total = total - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def candidate_pairs(left: DataFrame, pivots: DataFrame) -> DataFrame:
    """Members against the pivots of their bucket: pairs of different components that can be similar.

    The larger set must not exceed the smaller one by more than the threshold allows.
    """
    fits = (DEN * F.least("size", "pivot_size") >= NUM * F.greatest("size", "pivot_size"))
    j = left.join(pivots, "bucket").where((F.col("component") != F.col("pivot_component")) & fits
                                          & (_agreement() >= MIN_AGREE))
    return j.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


TILE = 256  # members and pivots of a tile, about


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, text`` of the documents with these ids; no other text moves."""
    ids = small(materialise(ids.distinct(), "nd-end"))
    t = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text").join(ids, "id")
    return materialise(t, "nd-text")


def _tile_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the pivots and members of a tile, one for each pair of components that they join."""
    ids = rows.column("id").to_pylist()
    comps = rows.column("component").to_pylist()
    pivot = np.array(rows.column("is_pivot").to_pylist(), dtype=bool)
    h, doc = _sets(rows.column("text").combine_chunks())
    size = np.bincount(doc, minlength=len(ids))
    _, code = np.unique(h, return_inverse=True)
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    members = np.flatnonzero(~pivot & (size > 0))
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    a, b = [], []
    marked = np.zeros(len(code) + 1, dtype=np.int64)
    for p in np.flatnonzero(pivot & (size > 0)):
        own = code[bounds[p]:bounds[p + 1]]
        marked[own] = 1
        total = np.concatenate([[0], np.cumsum(marked[code])])
        inter = total[bounds[members + 1]] - total[bounds[members]]
        marked[own] = 0
        for m in members[DEN * inter >= NUM * (size[members] + size[p] - inter)]:
            x, y = root(comps[p]), root(comps[m])
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(ids[p])
                b.append(ids[m])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _wide_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, size`` and the wide signature of every text with a shingle."""
    for batch in batches:
        raw, off = tv.text_buffer(batch.column("text"))
        for lo, hi in tv.chunks(off):
            h, doc = tv.distinct_per_doc(*tv.shingles(tv.words(raw, off, lo, hi), SHINGLE), hi - lo)
            for a in range(0, hi - lo, WIDE_DOCS):
                n = min(WIDE_DOCS, hi - lo - a)
                first, last = np.searchsorted(doc, [a, a + n])
                own = doc[first:last] - a
                size = np.bincount(own, minlength=n).astype(np.int64)
                some = np.flatnonzero(size)
                place = np.cumsum(size > 0) - 1
                sig = signatures(fast_similarity_sketch(h[first:last], place[own], len(some), WIDE))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo + a, n).take(pa.array(some)), pa.array(size[some]),
                     pa.array([row.tobytes() for row in sig], pa.binary())], names=["id", "size", "wide"])


def _agreements(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of ``sig`` agrees with ``one``."""
    d = sig ^ one
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return sig.shape[1] * 16 - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


_DEALT = "bucket long, x long, y long, id long, component long, is_pivot boolean"


def _tile_possible(rows: pa.Table) -> pa.Table:
    """The rows of a tile with a partner of another component in it that size and wide signature allow."""
    sig = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(len(rows), WIDE // 16)
    size, comp = rows.column("size").to_numpy(), rows.column("component").to_numpy()
    pivot = np.array(rows.column("is_pivot").to_pylist(), dtype=bool)
    members = np.flatnonzero(~pivot)
    keep = np.zeros(len(rows), dtype=bool)
    for p in np.flatnonzero(pivot):
        fits = DEN * np.minimum(size[members], size[p]) >= NUM * np.maximum(size[members], size[p])
        near = members[fits & (comp[members] != comp[p])]
        near = near[_agreements(sig[near], sig[p]) >= MIN_WIDE]
        keep[near] = True
        keep[p] = len(near) > 0
    return rows.select(["bucket", "x", "y", "id", "component", "is_pivot"]).filter(pa.array(keep))


def possible_rows(dealt: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of the tiles ``dealt(bucket, x, y, id, component, is_pivot)`` whose texts have to be compared.

    Only wide signatures (WIDE / 2 bytes) move; a tile sends on rows, never pairs.
    """
    ids = small(materialise(dealt.select("id").distinct(), "nd-dealt"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text").join(ids, "id")
    wide = materialise(texts.mapInArrow(_wide_batches, "id long, size long, wide binary"), "nd-wide")
    return dealt.join(wide, "id").groupBy("bucket", "x", "y").applyInArrow(_tile_possible, _DEALT).distinct()


def _compare_rest(left: DataFrame, docs: DataFrame, tasks: int) -> DataFrame:
    """Links among ``left(bucket, id, component)`` between different components of a bucket.

    Every such pair has a member outside its bucket's largest component: those are the pivots. Members
    and pivots of a bucket are dealt into tiles of bounded size; a tile compares the whole sets of its
    possible rows.
    """
    parts = left.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"),
        (F.sum("n") - F.max("n")).alias("others")).where(F.col("others") > 0)
    mixed = materialise(mixed, "nd-mixed", tasks)
    rows = left.join(mixed, "bucket").withColumn("x_blocks", F.ceil(F.col("n") / TILE)).withColumn(
        "y_blocks", F.ceil(F.col("others") / TILE))
    deal = F.xxhash64("id", F.lit("tile"))
    as_member = rows.select("bucket", "id", "component", F.lit(False).alias("is_pivot"),
                            F.pmod(deal, "x_blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)).alias("y"))
    as_pivot = rows.where(F.col("component") != F.col("main")).select(
        "bucket", "id", "component", F.lit(True).alias("is_pivot"),
        F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)).alias("x"), F.pmod(deal, "y_blocks").alias("y"))
    dealt = materialise(as_member.unionByName(as_pivot), "nd-tile", tasks)
    if dealt.isEmpty():
        return dealt.select(F.col("id").alias("a"), F.col("id").alias("b"))
    dealt = materialise(possible_rows(dealt, docs), "nd-possible")
    with_text = dealt.join(_texts_of(dealt.select("id"), docs), "id")
    return with_text.groupBy("bucket", "x", "y").applyInArrow(_tile_links, "a long, b long")


MEMBERS_PER_TASK = 100_000


def similar_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketch rows, classes): classes hold ``d1, d2, component`` of every non-empty set with an id."""
    sk = materialise(sketches(docs), "nd-sketch")
    usable = sk.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "nd-class")
    reps = usable.select("doc_id", "d1", "d2", "bands").join(classes, ["d1", "d2"]).where(F.col("doc_id") == F.col("rep"))
    members = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    shared = materialise(
        members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        .where(F.col("lo") < F.col("hi")), "nd-bucket")
    members = materialise(members.join(shared, "bucket"), "nd-member")
    tasks = math.ceil(max(members.count(), 1) / MEMBERS_PER_TASK)
    sig = usable.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"),
                        *[F.get("sig", F.lit(i)).alias(c) for i, c in enumerate(_SIG)])
    members = materialise(members.distinct().join(sig, "id").withColumn("component", F.col("id")), "nd-signed", tasks)
    columns = ["bucket", F.col("id").alias("pivot"), F.col("component").alias("pivot_component"),
               F.col("size").alias("pivot_size"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(_SIG)]]
    pivots = members.where((F.col("id") == F.col("lo")) | (F.col("id") == F.col("hi"))).select(*columns)
    pairs = materialise(candidate_pairs(members, pivots), "nd-pair", tasks)
    comp = None
    if not pairs.isEmpty():
        comp = connected_components(materialise(confirm(pairs, docs), "nd-link", tasks))
    # three members have all their pairs among these; only larger buckets can hold uncompared ones
    left = members.where((F.col("n") > 3) & (F.col("id") != F.col("lo")) & (F.col("id") != F.col("hi")))
    if comp is not None:
        left = left.drop("component").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    left = materialise(left.select("bucket", "id", "component"), "nd-known", tasks)
    links = materialise(_compare_rest(left, docs, tasks), "nd-rest", tasks)
    if not links.isEmpty():
        # what is known already is a star for each component
        known = [] if comp is None else [comp.select(F.col("id").alias("a"), F.col("component").alias("b"))]
        comp = connected_components(functools.reduce(DataFrame.unionByName, known, links))
    if comp is None:
        found = classes.select("d1", "d2", F.col("rep").alias("component"))
    else:
        found = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
            "d1", "d2", F.coalesce("component", "rep").alias("component"))
    return sk.drop("bands", "sig"), materialise(found, "nd-found")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept, text_key``."""
    sk, found = similar_components(docs.select("doc_id", "text"))
    out = sk.select("doc_id", "text_key", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one of smallest doc_id; repeated rows go too."""
    keep_cols = docs.columns
    rows = materialise(near_duplicates(docs), "nd-rows")
    gone = rows.where(~F.col("kept")).select(F.col("doc_id").alias("_nd_id"), F.col("text_key").alias("_nd_key"))
    gone = small(materialise(gone.distinct(), "nd-gone"))
    keyed = docs.withColumn("_nd_text_key", F.xxhash64("text"))
    cond = (F.col("doc_id") == F.col("_nd_id")) & (F.col("_nd_text_key") == F.col("_nd_key"))
    kept = keyed.join(gone, cond, "left_anti")
    repeated = rows.where(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy(
        "doc_id", "text_key").count().where("count > 1")
    if not repeated.isEmpty():
        own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id all stay
        kept = kept.withColumn("_nd_row", own).dropDuplicates(["doc_id", "_nd_text_key", "_nd_row"])
    return kept.select(*keep_cols)
