"""Operator 5: language identification by nearest clustered centroids.

Texts become hashed byte-trigram counts over letters (A-Z lower-cased, other
ASCII as word gaps), weighted by TF-IDF and normalised. Document frequencies,
centroids and the rejection bound come from every training text. Per language,
spherical k-means gives up to ``CENTROIDS`` centroids; a text gets the language
of the centroid of highest cosine. A text farther from every centroid than
``reject_below`` is rejected: that bound is half the lowest ``REJECT_QUANTILE``
cosine of the training texts to their own language, so only text unlike all training text goes.
A text of fewer than ``ENOUGH`` trigrams says too little to be rejected by its distance.

Training counts each text once and stores the counts; every step of k-means is one
pass over them, whose tasks return a sum for each centroid or one text for each language.
Sums are of whole numbers, so neither the order of rows nor the tasks change the model.

Defined cases: null text or text without a letter is ``und`` with score 0 and
counts as rejected; ties go to the language first by name; with no training
rows every text is ``und``; repeated rows each get their row; very long texts are read
whole, in blocks of bounded size; an empty table gives an empty one; columns are kept
under a prefix inside, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matstream.llm import textvec as tv
from matstream.llm.common import materialise, training_part

DIM = 4096
CENTROIDS = 4
KMEANS_ROUNDS = 8
MAX_LANGS = 500  # bounds the centroid table (32 MB) that goes to every task
REJECT_QUANTILE = 0.001
ENOUGH = 24
POSITIONS_AT_ONCE = 1 << 19  # bounds the arrays of a very long text
DOCS_AT_ONCE = 256  # rows of the dense count matrix
MANY = 255  # counts from here on are stored apart
FIXED = float(1 << 30)  # weights are summed as whole numbers of this part
BINS = 4096  # of cosines, to find the one that holds a quantile

_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Hashed trigram counts (texts x DIM, float32) of the texts lo..hi-1."""
    n = hi - lo
    size = np.diff(offsets[lo:hi + 1]) + 2   # a gap before and behind every text
    start = np.concatenate([[0], np.cumsum(size)])
    b = np.full(start[-1], 0x20, np.uint8)
    for i in range(n):
        b[start[i] + 1:start[i + 1] - 1] = _LETTER[raw[offsets[lo + i]:offsets[lo + i + 1]]]
    doc = np.repeat(np.arange(n, dtype=np.uint16), size)
    counts = np.zeros(n * DIM, np.float32)
    for at in range(0, len(b) - 2, POSITIONS_AT_ONCE):
        c = b[at:at + POSITIONS_AT_ONCE + 2].astype(np.uint32)
        own = doc[at:at + POSITIONS_AT_ONCE + 2]
        code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        inside = (own[:-2] == own[2:]) & (c[1:-1] != 0x20)  # centred on a letter, within one text
        dim = ((code[inside] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        counts += np.bincount(own[:-2][inside].astype(np.int64) * DIM + dim, minlength=n * DIM)
    return counts.reshape(n, DIM)


def _blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    raw, off = tv.text_buffer(col)
    for lo, hi in tv.chunks(off):
        for a in range(lo, hi, DOCS_AT_ONCE):
            z = min(a + DOCS_AT_ONCE, hi)
            yield a, z, trigram_counts(raw, off, a, z)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as one binary value a row; row i holds those from ``ends[i]`` to ``ends[i + 1]``."""
    off = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(values.tobytes())])


def _numbers(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of :func:`_binary` and where each row's begin and end."""
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    ends = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]].view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


_COUNTS = "place int, dims binary, counts binary, many binary"


def _count_batches(places: dict[str, int]):
    """The counts that are not 0 of every text, with the place of its language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.array([places[x] for x in batch.column("lang").to_pylist()], np.int32)
            for a, z, x in _blocks(batch.column("text")):
                at = np.flatnonzero(x)
                count = x.reshape(-1)[at]
                ends = np.searchsorted(at, np.arange(z - a + 1) * DIM)
                many = np.flatnonzero(count >= MANY)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[a:z]), _binary((at % DIM).astype(np.uint16), ends),
                     _binary(np.minimum(count, MANY).astype(np.uint8), ends),
                     _binary(count[many], np.searchsorted(many, ends))],
                    names=["place", "dims", "counts", "many"])

    return run


def _df_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIM, np.int64)
    seen = 0
    for batch in batches:
        df += np.bincount(_numbers(batch.column("dims"), np.uint16)[0], minlength=DIM)
        seen += batch.num_rows
    dim = np.append(np.arange(DIM), -1)  # -1: number of texts
    yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(np.append(df, seen))], names=["dim", "df"])


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


@dataclass
class _Texts:
    """Weighted texts of unit length: the language's place and first number of each; dimensions and weights."""

    place: np.ndarray
    start: np.ndarray
    size: np.ndarray
    dim: np.ndarray
    weight: np.ndarray

    def cosines(self, centroids: np.ndarray) -> np.ndarray:
        """Of every text to the centroids (languages x centroids x DIM) of its own language."""
        k, flat = centroids.shape[1], centroids.reshape(-1)
        at = np.repeat(self.place.astype(np.int64) * (k * DIM), self.size) + self.dim
        weight = self.weight.astype(np.float64)
        return np.stack([np.add.reduceat(weight * flat[at + j * DIM], self.start) for j in range(k)], axis=1)


def _texts(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[_Texts]:
    """Stored counts as weighted texts, in blocks; those without a trigram have no direction and are left out."""
    for batch in batches:
        place = batch.column("place").to_numpy()
        dims, ends = _numbers(batch.column("dims"), np.uint16)
        counts, _ = _numbers(batch.column("counts"), np.uint8)
        many, many_ends = _numbers(batch.column("many"), np.float32)
        for a in range(0, len(place), DOCS_AT_ONCE):
            z = min(a + DOCS_AT_ONCE, len(place))
            lo, hi = ends[a], ends[z]
            size = np.diff(ends[a:z + 1])
            some = size > 0
            if not some.any():
                continue
            dim = dims[lo:hi].astype(np.int64)
            x = counts[lo:hi].astype(np.float32)
            x[x == MANY] = many[many_ends[a]:many_ends[z]]
            x = np.log1p(x) * idf[dim]
            start, size = (ends[a:z] - lo)[some], size[some]
            norm = np.sqrt(np.add.reduceat(np.square(x, dtype=np.float64), start))
            yield _Texts(place[a:z][some], start, size, dim, (x / np.repeat(norm, size)).astype(np.float32))


def _sum_batches(shared: Broadcast):
    """For each centroid the sum of the texts that are nearest to it among their language's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = shared.value
        k = centroids.shape[1]
        sums: dict[int, np.ndarray] = {}
        for t in _texts(batches, idf):
            nearest = np.argmax(t.cosines(centroids), axis=1)
            group, own = np.unique(t.place.astype(np.int64) * k + nearest, return_inverse=True)
            whole = np.rint(t.weight * FIXED)
            got = np.bincount(np.repeat(own, t.size) * DIM + t.dim, whole, len(group) * DIM).astype(np.int64)
            for g, s in zip(group.tolist(), got.reshape(-1, DIM)):
                sums[g] = sums[g] + s if g in sums else s.copy()
        for g, s in sums.items():
            yield pa.RecordBatch.from_pylist([{"place": g // k, "cluster": g % k, "sums": s.tobytes()}], _SUMS)

    return run


_SUMS = pa.schema([("place", pa.int32()), ("cluster", pa.int32()), ("sums", pa.binary())])


def _centroid(table: pa.Table) -> pa.Table:
    """One centroid from its sums by task."""
    total = np.zeros(DIM, np.int64)
    for s in table.column("sums"):
        total += np.frombuffer(s.as_buffer(), np.int64)
    c = total / FIXED
    c = (c / max(float(np.sqrt((c * c).sum())), 1e-12)).astype(np.float32)
    return table.slice(0, 1).select(["place", "cluster"]).append_column("centroid", pa.array([c.tobytes()], pa.binary()))


def _least_batches(shared: Broadcast, sign: int):
    """For each language the text of least ``sign`` x its highest cosine; equal ones in the order of their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = shared.value
        least: dict[int, tuple[float, bytes, bytes]] = {}
        for t in _texts(batches, idf):
            key = sign * t.cosines(centroids).max(axis=1)
            for p in np.unique(t.place).tolist():
                rows = np.flatnonzero(t.place == p)
                low = float(key[rows].min())
                if p in least and low > least[p][0]:
                    continue
                for i in rows[key[rows] == low].tolist():
                    at = slice(t.start[i], t.start[i] + t.size[i])
                    found = (low, t.dim[at].astype(np.uint16).tobytes(), t.weight[at].tobytes())
                    least[p] = min(least.get(p, found), found)
        for p, (low, dims, weights) in least.items():
            yield pa.RecordBatch.from_pylist([{"place": p, "key": low, "dims": dims, "weights": weights}], _LEAST)

    return run


_LEAST = pa.schema([("place", pa.int32()), ("key", pa.float64()), ("dims", pa.binary()), ("weights", pa.binary())])


def _cosine_batches(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = shared.value
        for t in _texts(batches, idf):
            yield pa.RecordBatch.from_arrays([pa.array(t.place), pa.array(t.cosines(centroids).max(axis=1))],
                                             names=["place", "cos"])

    return run


def _with_shared(counts: DataFrame, value: tuple, use: Callable):
    """``use`` of a broadcast of ``value``, which is given up afterwards."""
    shared = counts.sparkSession.sparkContext.broadcast(value)
    try:
        return use(shared)
    finally:
        shared.destroy()


def _moved(counts: DataFrame, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Means of the texts nearest to each centroid, of unit length; those without a text are dropped, 0 behind the rest."""
    sums = lambda shared: counts.mapInArrow(
        _sum_batches(shared), "place int, cluster int, sums binary").groupBy("place", "cluster").applyInArrow(
        _centroid, "place int, cluster int, centroid binary").collect()  # languages x centroids rows
    out = np.zeros_like(centroids)
    used = np.zeros(len(out), np.int64)
    for r in sorted(_with_shared(counts, (idf, centroids), sums), key=lambda r: (r["place"], r["cluster"])):
        out[r["place"], used[r["place"]]] = np.frombuffer(r["centroid"], np.float32)
        used[r["place"]] += 1
    return out


def _least(counts: DataFrame, idf: np.ndarray, centroids: np.ndarray, sign: int) -> dict[int, tuple[float, np.ndarray]]:
    """By language: key and vector of the text that :func:`_least_batches` describes."""
    least = lambda shared: counts.mapInArrow(
        _least_batches(shared, sign), "place int, key double, dims binary, weights binary").groupBy("place").agg(
        F.min(F.struct("key", "dims", "weights")).alias("least")).collect()  # a row a language
    out = {}
    for place, (key, dims, weights) in _with_shared(counts, (idf, centroids), least):
        v = np.zeros(DIM, np.float32)
        v[np.frombuffer(dims, np.uint16)] = np.frombuffer(weights, np.float32)
        out[place] = key, v
    return out


def spherical_kmeans(counts: DataFrame, idf: np.ndarray, langs: int, k: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Up to ``k`` unit centroids of every language; farthest-first start, empty clusters dropped (0 behind the rest)."""
    mean = _moved(counts, idf, np.zeros((langs, 1, DIM), np.float32))
    c = np.zeros((langs, k, DIM), np.float32)
    for place, (_, v) in _least(counts, idf, mean, -1).items():
        c[place, 0] = v
    for j in range(1, k):
        far = {p: v for p, (key, v) in _least(counts, idf, c, 1).items() if key <= 1 - 1e-6 and c[p, j - 1].any()}
        if not far:
            break
        for place, v in far.items():
            c[place, j] = v
    for _ in range(rounds):
        was, c = c, _moved(counts, idf, c)
        if np.array_equal(was, c):  # more rounds change nothing
            break
    return c


def _floors(cosines: DataFrame, quantile: float) -> list[float]:
    """The quantile of each language's ``cosines(place, cos)``, between the two neighbours of its rank."""
    binned = cosines.withColumn("bin", F.floor(F.col("cos") * BINS))
    bins = binned.groupBy("place", "bin").agg(F.count("*").alias("n")).toArrow()  # languages x BINS rows, three numbers each
    place, bin_, n = (c.to_numpy() for c in bins.sort_by([("place", "ascending"), ("bin", "ascending")]).columns)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    held = []
    for p, b, c in zip(place[first].tolist(), np.split(bin_, first[1:]), np.split(n, first[1:])):
        upto = np.cumsum(c)
        low = int(quantile * (upto[-1] - 1))
        lo, hi = np.searchsorted(upto, [low, min(low + 1, upto[-1] - 1)], side="right").tolist()
        held.append((p, int(b[lo]), int(b[hi]), int(upto[lo] - c[lo]), low, quantile * float(upto[-1] - 1) - low))
    if not held:
        return []
    ranks = cosines.sparkSession.createDataFrame(held, "place int, first long, last long, before long, low long, share double")
    near = binned.join(F.broadcast(ranks), "place").where(F.col("bin").between(F.col("first"), F.col("last")))
    near = near.groupBy("place", "cos", "before", "low", "share").agg(F.count("*").alias("n"))
    near = near.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("place").orderBy("cos")))
    two: dict[int, list[float]] = {}
    share = {}
    for r in near.where((F.col("upto") > F.col("low")) & (F.col("upto") - F.col("n") <= F.col("low") + 1)).collect():
        two.setdefault(r["place"], []).append(r["cos"])  # at most two a language
        share[r["place"]] = r["share"]
    return [min(v) + (max(v) - min(v)) * share[p] for p, v in two.items()]


class LanguageModel:
    """Centroids (unit rows), their languages, IDF weights and the rejection bound."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, reject_below: float):
        self.langs, self.centroids, self.idf, self.reject_below = langs, centroids, idf, reject_below

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language and the cosine of every row of counts; -1 where nothing is learned."""
        if not self.langs:
            return np.full(len(x), -1), np.zeros(len(x))
        cos = _weighted(x, self.idf) @ self.centroids.T
        best = np.argmax(cos, axis=1)
        return best, np.clip(cos[np.arange(len(x)), best].astype(np.float64), 0.0, 1.0)


def train(docs: DataFrame, centroids: int = CENTROIDS, quantile: float = REJECT_QUANTILE) -> LanguageModel:
    """Fit on all rows of ``docs(text, lang)`` that have both."""
    rows = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = materialise(rows.mapInArrow(_count_batches({x: i for i, x in enumerate(langs)}), _COUNTS),
                         "lang-counts", codec="zstd")
    df = counts.select("dims").mapInArrow(_df_batches, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df"))
    found = dict(df.collect())  # DIM + 1 rows
    n = found.pop(-1, 0)
    freq = np.array([found.get(i, 0) for i in range(DIM)], dtype=np.float64)
    idf = (np.log((1 + n) / (1 + freq)) + 1).astype(np.float32)
    c = spherical_kmeans(counts, idf, len(langs), centroids)
    cosines = _with_shared(counts, (idf, c), lambda shared: materialise(
        counts.mapInArrow(_cosine_batches(shared), "place int, cos double"), "lang-cosines"))
    got = sorted((langs[p], v.tobytes()) for p in range(len(langs)) for v in c[p] if v.any())
    c = np.array([np.frombuffer(b, np.float32) for _, b in got]).reshape(len(got), DIM)
    reject_below = 0.5 * min(_floors(cosines, quantile), default=0.0)
    return LanguageModel([x for x, _ in got], c, idf, reject_below)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (default doc_id) with ``lang_pred, score, rejected``."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = "k_text" if "text" in keep else "text"
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], *([] if "text" in keep else ["text"]),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    fields = ", ".join(f"`k_{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            n = batch.num_rows
            best, score, far = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            for a, z, x in _blocks(batch.column(text)):
                best[a:z], score[a:z] = m.predict(x)
                far[a:z] = (score[a:z] < m.reject_below) & (x.sum(axis=1) >= ENOUGH)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            best[~letters], score[~letters] = -1, 0.0
            cols = [batch.column(f"k_{c}") for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(names[best], pa.string()), pa.array(score),
                 pa.array((best < 0) | far)],
                names=[*[f"k_{c}" for c in keep], "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "lang_pred", "score", "rejected")


HELD_OUT_OF = 3


def language_id(docs: DataFrame) -> DataFrame:
    """Train on documents whose id's crc32 mod 3 is not 1, predict all."""
    part = training_part("doc_id", HELD_OUT_OF)
    model = train(docs.where(part != 1))
    keyed = docs.select("doc_id", "text", (part == 1).alias("held_out"))
    return identify(keyed, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` less those that identification rejects."""
    part = training_part("doc_id", HELD_OUT_OF)
    model = train(docs.where(part != 1))
    cols = docs.columns
    return identify(docs, model, cols).where(~F.col("rejected")).select(*cols)
