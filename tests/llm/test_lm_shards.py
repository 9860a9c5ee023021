"""Operator 8 scores from its stored shards: broadcast or asked, the same rows, and nothing but the shards is read."""

import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.llm import ngramlm
from tests.llm.test_page_vector_lm import naive_score

KEYS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def scored(docs, **kw):
    return sorted((tuple(r[k] for k in KEYS) for r in ngramlm.score(docs, **kw).collect()), key=str)


def corpus(spark, n=120):
    rng = np.random.default_rng(6)
    data = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 150) % 4000)) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("group_keys", [ngramlm.GROUP_KEYS, 500])
def test_broadcast_and_asked_shards_give_the_same_rows(spark, docs, odd, no_docs, group_keys):
    for df in (docs.limit(60), odd, no_docs, odd.where("doc_id = 2")):
        df = spark.createDataFrame(df.select("doc_id", "text").collect(), "doc_id long, text string")
        assert scored(df, group_keys=group_keys, broadcast_bytes=1 << 30) == scored(df, group_keys=group_keys)


def test_broadcast_scores_against_brute_force(spark):
    data, df = corpus(spark)
    got = {r[0]: r[-1] / r[2] for r in scored(df, broadcast_bytes=1 << 30)}
    assert np.abs([got[i] - s for (i, _), s in zip(data, naive_score(data), strict=True)]).mean() < 0.002


def test_broadcast_stops_at_its_bytes(spark, monkeypatch):
    _, df = corpus(spark, 40)
    sent = []
    real = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or real(self, x))
    want = scored(df, broadcast_bytes=0)
    assert not any(isinstance(x, ngramlm.Shards) for x in sent)
    assert scored(df, broadcast_bytes=ngramlm.BROADCAST_BYTES) == want
    assert sum(isinstance(x, ngramlm.Shards) for x in sent) == 1


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 30])
def test_scoring_reads_shards_only(spark, monkeypatch, broadcast_bytes):
    """With the filters of the stored shards emptied, no bigram or word is known to the model; the base stays."""
    _, df = corpus(spark, 30)
    want = scored(df, broadcast_bytes=broadcast_bytes)
    real = ngramlm.materialise

    def emptied(frame: DataFrame, name, **kw):
        if name == "lm-shards":
            frame = frame.withColumn("bits", F.unhex(F.lit("0" * 16)))
        return real(frame, name, **kw)

    monkeypatch.setattr(ngramlm, "materialise", emptied)
    got = scored(df, broadcast_bytes=broadcast_bytes)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    n = got[0][4]
    v = len({w for r in df.collect() if trains(r.doc_id) for w in r.text.split()}) + 1
    assert np.allclose([r[6] / r[2] for r in got], np.log10(0.5 / (n + 0.5 * (v + 1))))


def trains(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 1
