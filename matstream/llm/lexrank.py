"""Operator 12: ranked lexical search by an Aho-Corasick scan of the documents.

All terms of the items form one automaton, every term guarded by a separator on
both sides, and a document is scanned once with its separators and A-Z made
uniform: each output is one occurrence of a term, so term frequencies come
straight from the text and no index of documents is made. The automaton's outputs map
to items through postings (term -> items and how often they hold it).

Two scans of the documents: the first counts N, L and every term's df; the
second scores all items for a chunk of documents at a time and keeps each item's
best ``k`` of the task. A task's best are merged in two levels (item and salt,
then item), so no group grows with the tasks beyond ``SALTS * k`` rows.

The items are read to the driver and broadcast in blocks of at most about
``BLOCK_BYTES`` of text (one more item at the most), counted before; every block
scans the documents, so any number of items has whole results.

Defined cases: a null or term-less text has no terms, is no part of N and is never
ranked; repeated document rows are documents of their own; a null doc_id is
ranked behind all ids of its score; items equal in id and text are one item, other texts
under the same id are items of their own, and items without terms or without scoring
documents have no rows; empty tables give an empty result; only id and text columns are
read, so other columns can't clash. Ids of documents are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP = 20
BLOCK_BYTES = 1 << 20     # of item texts in one automaton (tens of bytes a character)
SALTS = 256
CHUNK_DOCS = 2_000
CHUNK_CELLS = 4_000_000   # documents x items scored at once
CHUNK_OUTPUTS = 2_000_000

_SEPARATE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
                  for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms in order: maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def automaton_of(terms: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of the guarded terms; outputs are positions in ``terms``. One character a byte of UTF-8."""
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        a.add_word(f" {t.decode('latin-1')} ", i)
    a.make_automaton()
    return a


def occurrences(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, list[int]]:
    """How many terms a text has, and the automaton's outputs over it."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE)
    return len(data.split()), [t for _, t in automaton.iter(f" {data.decode('latin-1')} ")]


def _chunks(batches, automaton, n_items: int, with_ids: bool):
    """Per chunk of documents: lengths, ids, and the (document, term, tf) triples of the automaton's outputs."""
    limit = max(1, min(CHUNK_DOCS, CHUNK_CELLS // max(n_items, 1)))
    n_terms = len(automaton)
    for b in batches:
        ids = b.column(1) if with_ids else None
        lengths, docs, outs, first, held = [], [], [], 0, 0
        for i, v in enumerate(b.column(0)):
            n, found = occurrences(automaton, v.as_py())
            docs.extend(repeat(len(lengths), len(found)))
            outs.extend(found)
            lengths.append(n)
            held += len(found)
            if len(lengths) >= limit or held >= CHUNK_OUTPUTS or i + 1 == b.num_rows:
                key = np.asarray(docs, np.int64) * n_terms + np.asarray(outs, np.int64)
                key, tf = np.unique(key, return_counts=True)
                yield (np.asarray(lengths, np.int64), ids.slice(first, len(lengths)) if with_ids else None,
                       key // n_terms, key % n_terms, tf.astype(np.int64))
                lengths, docs, outs, first, held = [], [], [], i + 1, 0


def corpus_counts(docs: DataFrame, automaton: ahocorasick.Automaton, text_col: str = "text") -> tuple[int, int, np.ndarray]:
    """N, L and the df of every term of the automaton; one row per term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def kernel(batches):
        a = shared.value
        df = np.zeros(len(a) + 2, np.int64)
        for lengths, _, _, term, _ in _chunks(batches, a, 1, False):
            df[:-2] += np.bincount(term, minlength=len(a))
            df[-2] += np.count_nonzero(lengths)
            df[-1] += lengths.sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    rows = docs.select(text_col).mapInArrow(kernel, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(automaton) + 2, np.int64)
    for r in rows:
        df[r["term"]] = r["n"]
    return int(df[-2]), int(df[-1]), df[:-2]


def _weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _best(items, scores, ids, nulls, k: int):
    """The ``k`` first of each item by falling score, then id, nulls last."""
    order = np.lexsort((ids, nulls, -scores, items))
    items = items[order]
    starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else np.zeros(0, np.int64)
    at = np.arange(len(items)) - np.repeat(starts, np.diff(np.r_[starts, len(items)]))
    order = order[at < k]
    return order


def _rank_block(docs: DataFrame, texts: list[str], k: int, id_col: str, text_col: str) -> DataFrame:
    """``_item`` (position in ``texts``), ``doc_id, score, _salt``: every task's best of each item."""
    counted = [Counter(terms_of(t)) for t in texts]
    terms = sorted(set().union(*counted))
    position = {t: i for i, t in enumerate(terms)}
    automaton = automaton_of(terms)
    n_docs, n_words, df = corpus_counts(docs, automaton, text_col)
    postings = sorted((position[t], i, c) for i, cs in enumerate(counted) for t, c in cs.items())
    p_term, p_item, p_count = (np.array(x, np.int64) for x in zip(*postings))
    p_first = np.searchsorted(p_term, np.arange(len(terms) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(
        (automaton, _weights(n_docs, df), p_first, p_item, p_count, n_docs, n_words, len(texts)))

    def kernel(batches):
        a, w, first, item_of, count_of, big_n, big_l, n_items = shared.value
        salt = TaskContext.get().partitionId() % SALTS
        best = [np.zeros(0, np.int64) for _ in range(4)]   # item, score, id, null id
        for lengths, ids, doc, term, tf in _chunks(batches, a, n_items, True):
            m = 75 + (25 * lengths * big_n) // big_l if big_l else lengths
            part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            n_post = first[term + 1] - first[term]
            at = np.repeat(first[term] - np.cumsum(n_post) + n_post, n_post) + np.arange(n_post.sum())
            scores = np.zeros((len(lengths), n_items), np.int64)
            np.add.at(scores.reshape(-1), np.repeat(doc, n_post) * n_items + item_of[at],
                      np.repeat(part, n_post) * count_of[at])
            least = np.ones(n_items, np.int64)
            if len(lengths) > k:   # no document below an item's k-th best of this chunk
                least = np.maximum(least, np.partition(scores, len(lengths) - k, axis=0)[len(lengths) - k])
            d, i = np.nonzero(scores >= least)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.cast(pa.int64()).fill_null(0).to_numpy()
            best = [np.concatenate(p) for p in zip(best, (i, scores[d, i], number[d], null[d].astype(np.int64)))]
            keep = _best(*best, k)
            best = [p[keep] for p in best]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(best[0]), pa.array(best[2], mask=best[3] > 0), pa.array(best[1]),
                 pa.array(np.full(len(best[0]), salt, np.int64))], names=["_item", "doc_id", "score", "_salt"])

    return docs.select(text_col, id_col).mapInArrow(kernel, "_item long, doc_id long, score long, _salt long")


def rank_items(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    schema = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for b in range(blocks):
        of_block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        of_block = [r for r in of_block if terms_of(r["text"])]
        if not of_block:
            continue
        rows = _rank_block(docs, [r["text"] for r in of_block], k, "doc_id", "text")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(of_block)],
                                      T.StructType([T.StructField("_item", T.LongType()), items.schema["item_id"]]))
        rows = _top(rows, ["_item", "_salt"], k)
        rows = _top(rows, ["_item"], k).join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema) if found is None else found


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
