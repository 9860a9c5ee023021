"""Operator 8: language-model scores from a log-frequency Bloom filter.

Words (A-Z lower-cased) and an end token are 64-bit hashes. Every n-gram of
training count ``c`` is inserted once for each level ``1 .. 1 + floor(log2 c)``;
an entry sets ``BITS_PER_ENTRY`` bits of one 64-bit word. A count is read back by
probing level after level until one is missing. Bigram probabilities are
smoothed towards the unigram's: ``(c(hw) + MU p(w)) / (c(h) + MU)``.

The texts are coded once, as chunks of token indexes with the chunk's distinct
words. Each chunk deals its distinct words and bigrams, with their training
counts, to groups by the top bits of the hash (of a bigram the next 32 bits go along). A
group adds the counts up and becomes one shard of the model, a row stored in the shared
folder: a filter of ``FILTER_BITS`` bits for every entry, the exact counts of
words, which the base score needs, and the hashes that chunks ask for. Bigram counts
live in the filters alone.

Texts are scored by probing the stored shards. If their counted bytes are within
``broadcast_bytes`` they are broadcast whole and each chunk probes them in place;
a larger model stays in its shards, which answer the hashes stored with them, and the
levels go back to their chunks by shuffle. Both ways probe the same bits, so the scores are the same.

Groups are as many as it takes for ``GROUP_KEYS`` hashes each, so a shard's memory is
bounded, the filter grows with the n-grams and none is left out.

Defined cases: null or empty text has the end token alone; a null doc_id counts
as training; without training rows N = V = 0 and a token's base probability is
1 (0.5 / 0.5); repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.llm import textvec as tv
from matstream.llm.common import materialise, training_part

HELD_OUT_OF = 5
MU = 8.0
BLOCKS = 1024  # groups at least, and the default blocks of a filter
BITS_PER_ENTRY = 4
FILTER_BITS = 24  # of the filter for each entry
GROUP_KEYS = 2_000_000  # hashes of all chunks in a group, on average at most
CODED_BYTES = 4 << 20  # of text in a chunk
BROADCAST_BYTES = 32 << 20  # of shards that are broadcast by the query

END = np.uint64(0x5DEECE66D1F3A5C7)
START = np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0x8CB92BA72F3D8DD7)  # apart from the words in a filter
_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def token_stream(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end token behind each text, first token of each text and the total)."""
    n = w.hi - w.lo
    first = w.first + np.arange(n + 1)
    tok = np.full(first[-1], END, np.uint64)
    at = np.arange(len(w.hashes)) + w.doc
    tok[at] = w.hashes
    return tok, first


def pair_hash(prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tv.mix(prev * _K1 + tok * _K2)


def _levels(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


class LogFrequencyFilter:
    """Quantised n-gram counts in blocked Bloom words."""

    def __init__(self, words: np.ndarray, blocks: int = BLOCKS, starts: np.ndarray | None = None):
        self.words = words  # uint64, in equal blocks or those that begin at ``starts``
        self.starts = np.arange(blocks + 1) * (len(words) // blocks) if starts is None else starts

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray) -> LogFrequencyFilter:
        """A filter of one block with every key, sized by its entries."""
        level = _levels(count)
        words = np.zeros(max(1, math.ceil(int(level.sum()) * FILTER_BITS / 64)), np.uint64)
        step = 1
        while len(key):
            at, mask = cls.place(key, step, len(words))
            np.bitwise_or.at(words, at, mask)
            step += 1
            more = level >= step
            key, level = key[more], level[more]
        return cls(words, 1)

    @staticmethod
    def place(key: np.ndarray, level: int | np.ndarray, part: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word within the block, mask) of the entries (key, level)."""
        with np.errstate(over="ignore"):
            x = tv.mix(key ^ (np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        mask = np.zeros(len(x), np.uint64)
        for i in range(BITS_PER_ENTRY):
            mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
        return ((x >> np.uint64(24)) % np.asarray(part).astype(np.uint64)).astype(np.int64), mask

    def levels(self, key: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
        """Levels (0: not there) of the n-gram hashes, by default in the blocks of their top bits."""
        if block is None:
            block = block_of(key) if len(self.starts) > 2 else np.zeros(len(key), np.int64)
        base, part = self.starts[block], np.diff(self.starts)[block]
        level = np.zeros(len(key), np.uint8)
        active = np.arange(len(key))
        step = 1
        while len(active) and step < 64:
            at, mask = self.place(key[active], step, part[active])
            there = (self.words[base[active] + at] & mask) == mask
            active = active[there]
            level[active] = step
            step += 1
        return level

    def counts(self, key: np.ndarray) -> np.ndarray:
        """Quantised counts (0: not there) of the n-gram hashes."""
        return quantised(self.levels(key))


def quantised(level: np.ndarray) -> np.ndarray:
    level = level.astype(np.float64)
    return np.where(level > 1, 1.25 * 2.0 ** (level - 1), level)


def block_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(54)).astype(np.int64) % BLOCKS


def _packed(parts: list[np.ndarray]) -> pa.Array:
    """Numbers as bytes: all first bytes, then all second ones and so on, which compresses."""
    return pa.array([np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1).T.tobytes() if len(p) else b""
                     for p in parts], pa.binary())


def _unpacked(col: pa.Array | pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    width = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(width, -1).T).view(kind).ravel() for x in col]


_CODED = ("chunk long, doc_id array<long>, held_out array<boolean>, size binary, words binary, at binary, "
          "n_train long, n_keys long")


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of texts as distinct words and each token's index into them."""
    chunk = TaskContext.get().partitionId() << 33
    for batch in batches:
        raw, off = tv.text_buffer(batch.column("text"))
        for lo, hi in tv.chunks(off, CODED_BYTES):
            tok, first = token_stream(tv.words(raw, off, lo, hi))
            word, at = np.unique(tok, return_inverse=True)
            size = np.diff(first)
            held = batch.column("held_out").slice(lo, hi - lo)
            n = int(size[~held.to_numpy(zero_copy_only=False).astype(bool)].sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([batch.column("doc_id").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                 pa.array([held.to_pylist()], pa.list_(pa.bool_())), _packed([size.astype(np.int64)]), _packed([word]),
                 _packed([at.astype(np.int32)]), pa.array([n], pa.int64()), pa.array([len(word) + len(tok)], pa.int64())],
                names=["chunk", "doc_id", "held_out", "size", "words", "at", "n_train", "n_keys"])
            chunk += 1


def _pairs(word: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct bigram hashes, each token's index into them)."""
    tok = word[at]
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[first[:-1]] = START
    return np.unique(pair_hash(prev, tok), return_inverse=True)


def _first(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)])


def _dealt(key: np.ndarray, groups: int) -> np.ndarray:
    """Offsets of each group's part of the sorted hashes."""
    low = np.arange(groups, dtype=np.uint64) << np.uint64(64 - groups.bit_length() + 1)
    return np.append(np.searchsorted(key, low), len(key))


def _within(pair: np.ndarray, groups: int) -> np.ndarray:
    """The 32 bits of a bigram's hash behind those of its group: two of a group's meet less often than a filter errs."""
    return ((pair << np.uint64(groups.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)


def _chunk(row: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """(tokens of each text, distinct words, each token's word, distinct bigrams, each token's bigram)."""
    size, = _unpacked(row.column("size"), np.int64)
    word, = _unpacked(row.column("words"), np.uint64)
    at, = _unpacked(row.column("at"), np.int32)
    return size, word, at, *_pairs(word, at, _first(size))


_REQUEST = "block int, chunk long, words binary, pairs binary, word_n binary, pair_n binary"


def _deal(groups: int):
    """Arrow function: the distinct words and bigrams of each chunk with their training counts, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                size, word, at, pair, pair_at = _chunk(row)
                cuts = _dealt(word, groups), _dealt(pair, groups)
                some = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0))
                train = np.repeat(~np.array(row.column("held_out")[0].as_py(), bool), size)
                sent = [(word, cuts[0]), (_within(pair, groups), cuts[1]),
                        *[(np.bincount(where[train], minlength=len(key)).astype(np.int32), cut)
                          for key, where, cut in ((word, at, cuts[0]), (pair, pair_at, cuts[1]))]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), row.column("chunk")[0].as_py(), np.int64)),
                     *[_packed([x[cut[g]:cut[g + 1]] for g in some]) for x, cut in sent]],
                    names=["block", "chunk", "words", "pairs", "word_n", "pair_n"])

    return run


_SHARD = ("block int, bits binary, words binary, word_n binary, v long, "
          "chunk array<long>, ask_words array<binary>, ask_pairs array<binary>")


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes with a training count, sorted, and their counts of all chunks."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
    return key[n > 0], n[n > 0]


def _shard(t: pa.Table) -> pa.Table:
    """A group's shard of the model: the filter of its words and bigrams, the words' exact counts, and who asks for what."""
    word, n = _added(_unpacked(t.column("words"), np.uint64), _unpacked(t.column("word_n"), np.int32))
    pair, m = _added(_unpacked(t.column("pairs"), np.uint32), _unpacked(t.column("pair_n"), np.int32))
    lm = LogFrequencyFilter.of(np.concatenate([word, _pair_key(pair)]), np.concatenate([n, m]))
    return pa.table([t.column("block").slice(0, 1), pa.array([lm.words.tobytes()], pa.binary()), _packed([word]), _packed([n]),
                     pa.array([len(n)], pa.int64()), *[pa.array([t.column(x).to_pylist()], pa.list_(kind)) for x, kind in (
                         ("chunk", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()))]],
                    names=["block", "bits", "words", "word_n", "v", "chunk", "ask_words", "ask_pairs"])


def _pair_key(pair: np.ndarray) -> np.ndarray:
    return pair.astype(np.uint64) ^ _PAIR


class Shards:
    """Stored shards as they are probed: word counts, and levels by the filters."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("block")
        self.block = rows.column("block").to_numpy()
        bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("bits")]
        none = [np.zeros(0, np.uint64)]
        self.filter = LogFrequencyFilter(np.concatenate(bits + none), starts=_first(np.array([len(b) for b in bits], np.int64)))
        self.word = np.concatenate(_unpacked(rows.column("words"), np.uint64) + none)  # sorted, as groups are ranges
        self.n = np.concatenate([*_unpacked(rows.column("word_n"), np.int64), np.zeros(1, np.int64)])

    def probe(self, word: np.ndarray, word_block: np.ndarray, pair: np.ndarray,
              pair_block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exact counts of words, levels of words, levels of bigrams) of hashes in the given groups."""
        at = np.searchsorted(self.word, word)
        there = at < len(self.word)
        there[there] = self.word[at[there]] == word[there]
        return (np.where(there, self.n[at], 0), self.filter.levels(word, np.searchsorted(self.block, word_block)),
                self.filter.levels(_pair_key(pair), np.searchsorted(self.block, pair_block)))


_ANSWER = "block int, chunk long, word_n binary, word_level binary, pair_level binary"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each stored shard says of the hashes of every chunk that asked."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(i, 1)])
            words = _unpacked(row.column("ask_words").chunk(0).flatten(), np.uint64)
            pairs = _unpacked(row.column("ask_pairs").chunk(0).flatten(), np.uint32)
            word, pair = np.concatenate(words), np.concatenate(pairs)
            block = row.column("block")[0].as_py()
            n, one, two = Shards(row).probe(word, np.full(len(word), block), pair, np.full(len(pair), block))
            parts = [_packed(np.split(x, np.cumsum([len(k) for k in of])[:-1])) for x, of in ((n, words), (one, words), (two, pairs))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(words), block, np.int32)), row.column("chunk").chunk(0).flatten(), *parts],
                names=["block", "chunk", "word_n", "word_level", "pair_level"])


_SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)


def _scores(coded: pa.Table, chunk: tuple[np.ndarray, ...], c: np.ndarray, one: np.ndarray, two: np.ndarray,
            n: int, v: int) -> pa.Table:
    """Exact base sums and the model's scores of a chunk, given its words' counts and the levels."""
    size, word, at, _, pair_at = chunk
    first = _first(size)
    floor = 0.5 * (v + 1)
    c1, c2 = quantised(one), quantised(two)
    base = np.log10((c + 0.5) / (n + floor))
    p1 = np.minimum((c1 + 0.5) / (n + floor), 1.0)
    before = np.empty(len(at))
    before[1:] = c1[at[:-1]]
    before[first[:-1]] = c1[np.searchsorted(word, END)]  # a text begins as often as one ends
    total = _sums(np.log10((np.minimum(c2[pair_at], before) + MU * p1[at]) / (before + MU)), first)
    return pa.table(
        [coded.column("doc_id").chunk(0).flatten(), coded.column("held_out").chunk(0).flatten(), pa.array(size),
         pa.array(_sums((c > 0)[at].astype(np.int64), first).astype(np.int64)),
         pa.array(np.full(len(size), n, np.int64)), pa.array(_sums(base[at], first)), pa.array(total)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _by_answers(n: int, v: int):
    """Arrow function of a coded chunk and what the shards answered it."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("block")  # groups are ranges of the hashes
        c, one, two = (np.concatenate(_unpacked(answers.column(x), kind))
                       for x, kind in (("word_n", np.int64), ("word_level", np.uint8), ("pair_level", np.uint8)))
        return _scores(coded, _chunk(coded), c, one, two, n, v)

    return run


def _by_broadcast(shards: Broadcast[Shards], groups: int, n: int, v: int):
    """Arrow function: coded chunks scored against the whole model."""
    shift = np.uint64(64 - groups.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                coded = pa.Table.from_batches([batch.slice(i, 1)])
                chunk = _chunk(coded)
                word, pair = chunk[1], chunk[3]
                found = shards.value.probe(word, (word >> shift).astype(np.int64), _within(pair, groups),
                                           (pair >> shift).astype(np.int64))
                yield from _scores(coded, chunk, *found, n, v).to_batches()

    return run


def score(docs: DataFrame, group_keys: int = GROUP_KEYS, broadcast_bytes: int = 0) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A model of at most ``broadcast_bytes`` is broadcast (over the driver); none by default.
    """
    part = training_part("doc_id", HELD_OUT_OF)
    rows = docs.select("doc_id", "text", (part == 1).alias("held_out"))
    coded = materialise(rows.mapInArrow(_code, _CODED), "lm-coded", codec="zstd")
    n, keys = coded.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    groups = max(BLOCKS, 1 << math.ceil(math.log2(max(1, keys / group_keys))))
    own = coded.select("chunk", "doc_id", "held_out", "size", "words", "at")
    dealt = own.select("chunk", "held_out", "size", "words", "at").mapInArrow(_deal(groups), _REQUEST)
    shards = materialise(dealt.groupBy("block").applyInArrow(_shard, _SHARD), "lm-shards", codec="zstd")
    width = F.octet_length("bits") + F.octet_length("words") + F.octet_length("word_n")
    v, size = shards.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum(width), F.lit(0))).first()
    if size <= broadcast_bytes:
        model = docs.sparkSession.sparkContext.broadcast(Shards(shards.select("block", "bits", "words", "word_n").toArrow()))
        return own.mapInArrow(_by_broadcast(model, groups, n, v), _SCORED)
    answers = shards.drop("v").mapInArrow(_answer, _ANSWER)
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_by_answers(n, v), _SCORED)
