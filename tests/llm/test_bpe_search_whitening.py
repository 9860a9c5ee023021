"""Operators 11 to 13: byte-level BPE, lexical search, whitening."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as E
from matstream.llm import bytebpe, lexrank, whitening
from matstream.llm.queries import QUERIES
from oracle_check import compare, duck
from tests.llm.conftest import SF

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- byte-level BPE -----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(RANKS),
                             special_tokens={})


@pytest.fixture(scope="module")
def codecs():
    ranks = bytebpe.load_ranks(RANKS)
    return [bytebpe.Codec(ranks, public_tokenizers.PATTERN),
            bytebpe.Codec(ranks, public_tokenizers.PATTERN, leaf=2, token_leaf=2)]   # every seam is joined


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


ALPHABETS = ["ab '\n", "a", " \n\t　x1!", "'lrevedsmt ", "é日本Ña1 .́\U0001f600", "the and ing", "\x00\x1c\x85﻿ a"]


def test_tree_equals_the_library(codecs, library):
    rng = random.Random(5)
    texts = ["", "a", "it's   we'll\n\n  x", "x" * 300, "é" * 257, " " * 500, "ab" * 400, "12345" * 99 + "  \t\n"]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(80))) for a in ALPHABETS for _ in range(150)]
    for t in texts:
        want = packed(library.encode_ordinary(t))
        for c in codecs:
            assert c.encode(t) == want, t
            assert c.decode(want) == t.encode()


def test_very_long_matches_and_texts(codecs, library):
    rng = random.Random(6)
    for t in ("a" * 40_000, " " * 40_000, "".join(rng.choice("etaoin") for _ in range(40_000)),
              "".join(rng.choice("ab cd'll\n 12") for _ in range(60_000))):
        assert codecs[0].encode(t) == packed(library.encode_ordinary(t))


def test_joined_tokens_equal_direct_merging(codecs):
    rng = random.Random(7)
    c = codecs[1]
    for _ in range(300):
        data = bytes(rng.choice(b"abe th\xc3\xa9in") for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(data))
        assert c.join_tokens(c.merged(data[:cut]), c.merged(data[cut:])) == c.merged(data)
        assert c._merged_by_heap(data) == c.merged(data)


def test_bpe_query_on_all_documents(spark, library):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(),
                  hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want


def test_bpe_defined_cases(odd, no_docs, library):
    rows = bytebpe.decode(bytebpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    text = [r["text"] or "" for r in odd.collect()]
    assert sorted(bytes(r["data"]) for r in rows) == sorted(t.encode() for t in text)
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(packed(library.encode_ordinary(t)) for t in text)
    assert bytebpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_rank_file_is_checked(tmp_path):
    bad = tmp_path / "few.tiktoken"
    bad.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bytebpe.load_ranks(str(bad))


# --- lexical search -----------------------------------------------------------------------------------------

def ranked(docs, items, k=20):
    """The contract, read out plainly: every item against every document."""
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(
            chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, terms(t)) for i, t in docs]
    n = sum(1 for _, t in texts if t)
    total = sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        rows = []
        for i, t in texts:
            tf, score = Counter(t), 0
            for w in terms(text):
                if tf[w]:
                    m = 100 - 25 + (25 * len(t) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (
                        (1_000_000_000 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_search_sql(spark):
    got = QUERIES["op12_lexical_search"](spark, SF)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = duck(SF).sql(E.oracle_sql()["op12_lexical_search"]).df()
    assert len(want) > 100 and compare(got.toPandas(), want) is None


def test_search_defined_cases_in_one_and_many_blocks(spark, odd, no_docs):
    more = spark.createDataFrame([(i, "one " * (i % 3) + f"word{i % 7} ÉA é zero", "en", "s", 0, "x") for i in range(100, 160)],
                                 odd.schema)
    docs = odd.unionByName(more).repartition(5)
    items = spark.createDataFrame([(1, "One two one"), (1, "One two one"), (1, "zero é"), (2, None), (3, "?!"), (None, "THREE w"),
                                   (4, "nowhere"), (5, "word1 word2 Zero ÉA one")], "item_id long, text string")
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()], 7)
    for block_bytes in (1 << 20, 8):
        got = lexrank.rank_items(docs, items.withColumn("score", F.lit(1)), 7, block_bytes).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert lexrank.rank_items(no_docs, items).count() == 0
    empty = lexrank.rank_items(docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_of_a_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text")).repartition(16)
    items = spark.createDataFrame([(9, "words"), (8, "here same")], "item_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(-5, "other"), (7000, "here")], "doc_id long, text string"))
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [(9, "words"), (8, "here same")])
    assert sorted(map(tuple, lexrank.rank_items(docs, items).collect()), key=repr) == want


# --- whitening ----------------------------------------------------------------------------------------------

def test_charpoly_roots_and_vectors_are_exact(spark):
    rng = np.random.default_rng(1)
    for d, rank in ((2, 2), (5, 3), (9, 9)):
        b = rng.integers(-30, 30, (rank, d)).astype(object)
        a = (b.T @ b).tolist()
        p = whitening.characteristic_polynomial(spark, a)
        from fractions import Fraction   # Faddeev and LeVerrier, over the rationals
        m, want = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
        for k in range(1, d + 1):
            m = [[sum(a[i][r] * m[r][j] for r in range(d)) + (want[-1] if i == j else 0) for j in range(d)] for i in range(d)]
            want.append(-sum(a[i][r] * m[r][i] for i in range(d) for r in range(d)) / k)
        assert p == [int(c) for c in reversed(want)]
        roots, s = whitening.largest_roots(p, d)
        assert sum(c for _, c in roots) == rank
        top = np.sort(np.linalg.eigvalsh(np.array(a, float)))[::-1][:rank]
        assert np.allclose([r / 2 ** s for r, _ in roots], top, rtol=1e-9)


def test_multiple_roots_share_their_space(spark):
    a = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 9, 0], [0, 0, 0, 0]]
    p = whitening.characteristic_polynomial(spark, a)
    roots, s = whitening.largest_roots(p, 16)
    assert [(r >> s, c) for r, c in roots] == [(9, 1), (4, 2)]
    assert whitening.largest_roots(p, 2)[0][1][1] == 1
    vs = np.array(whitening.null_space(a, *(roots[1][0], s), 2))
    assert np.allclose(vs @ vs.T, np.eye(2), atol=1e-14) and np.allclose(vs[:, 2:], 0, atol=1e-14)


def test_roots_closer_than_doubles_are_parted(spark):
    big = 10 ** 17
    a = [[big, 0, 0], [0, big + 1, 0], [0, 0, 5]]
    roots, s = whitening.largest_roots(whitening.characteristic_polynomial(spark, a), 3)
    assert [r >> s for r, _ in roots] == [big + 1, big, 5]
    assert np.allclose(whitening.null_space(a, roots[0][0], s, 1)[0], [0, 1, 0])


def test_whitening_query(spark):
    got = QUERIES["op13_embedding_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([np.floor(64 * np.array(r["embedding"], float)) + 1_000_000 for r in rows])
    u = np.unique(x, axis=0)
    c = (u - u.mean(axis=0)).T @ (u - u.mean(axis=0)) / len(u)
    w, v = np.linalg.eigh(c)
    w, v = w[::-1][:16], v[:, ::-1][:, :16]
    pdf = got.toPandas().sort_values(["vec_id", "component"])
    assert len(pdf) == 16 * len(rows) and (pdf.n == len(u)).all()
    g = pdf.whitened.to_numpy().reshape(-1, 16)
    ref = (x - u.mean(axis=0)) @ v / np.sqrt(w)
    assert np.allclose(g, ref * np.sign((g * ref).sum(axis=0)), atol=1e-8)
    assert np.allclose(pdf.explained.to_numpy()[:16], w / np.trace(c), rtol=1e-10)
    xi, ui = x.astype(np.int64).astype(object), u.astype(np.int64).astype(object)
    dev = ((len(u) * xi - ui.sum(axis=0)) ** 2).sum(axis=1)
    assert pdf.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == dev.tolist()
    assert 0 <= pdf.identity_error.max() < 1e-9 and pdf.identity_error.nunique() == 1


def test_whitening_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -0.25, 3.0], [1.0, 0.0, -2.0], [0.1, 0.7, 0.3], [9.0, 9.0, 1.5], [1.0, 0.0, -2.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(10, None, "x"), (11, [1.0, None, 2.0], "x"), (12, [nan, 1.0, 1.0], "x"),
                                                        (13, [inf, 1.0, 1.0], "x"), (14, [1.0], "x"), (15, [], "x"),
                                                        (None, [0.5, -0.25, 3.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    pdf = whitening.whiten(df).toPandas()
    assert sorted(pdf.vec_id.dropna().unique()) == [0, 1, 2, 3, 4] and pdf.vec_id.isna().sum() == 3
    assert (pdf.n == 4).all() and sorted(pdf.component.unique()) == [1, 2, 3]
    once = pdf[pdf.vec_id.isin([0, 1, 2, 3])].sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(4, 3)
    assert np.allclose(once.T @ once / 4, np.eye(3), atol=1e-12)
    assert np.isclose(pdf[pdf.component == 1].explained.iloc[0] + pdf[pdf.component == 2].explained.iloc[0]
                      + pdf[pdf.component == 3].explained.iloc[0], 1)
    schema = whitening.whiten(df).columns
    for none in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id in (1, 4)"), df.where("vec_id = 10")):
        empty = whitening.whiten(none)
        assert empty.count() == 0 and empty.columns == schema
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["component"] for r in whitening.whiten(flat).collect()] == [1, 1]   # rank 1
    big = spark.createDataFrame([(1, [1e300, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(big).collect()
