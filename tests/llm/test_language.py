"""Language identification against a plain reading of its rule; short clean texts stay."""

import math
import random
import zlib

import numpy as np
import pytest

from matstream.llm import langid
from matstream.llm.common import training_part
from tests.llm.conftest import SF


def trigrams(text):
    """Counts of hashed trigrams centred on a letter, with a gap at both ends."""
    out = {}
    data = b" " + bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
                        for c in (text or "").encode()) + b" "
    for i in range(len(data) - 2):
        if data[i + 1] != 32:
            code = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
            dim = (code * 2654435761 % 2 ** 32) >> 20
            out[dim] = out.get(dim, 0) + 1
    return out


def test_predictions_follow_idf_centroids_and_cosines(spark, docs):
    rows = docs.collect()
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None]
    df = {}
    for r in learn:
        for d in trigrams(r["text"]):
            df[d] = df.get(d, 0) + 1
    model = langid.train(docs.where(training_part("doc_id", 3) != 1))
    idf = [math.log((1 + len(learn)) / (1 + df.get(d, 0))) + 1 for d in range(langid.DIM)]
    assert np.allclose(model.idf, idf, rtol=1e-6)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    got = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    for r in rows[:120]:
        v = {d: math.log1p(n) * idf[d] for d, n in trigrams(r["text"]).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cos = [sum(x / norm * float(c[d]) for d, x in v.items()) for c in model.centroids]
        assert got[r["doc_id"]]["lang_pred"] == model.langs[int(np.argmax(cos))]
        assert got[r["doc_id"]]["score"] == pytest.approx(max(cos), abs=1e-4)


def test_held_out_accuracy_and_short_texts(spark, docs):
    got = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    held = [r for r in docs.collect() if got[r["doc_id"]]["held_out"] and r["lang"] and len(r["text"] or "") > 40]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    short = spark.createDataFrame([(100_000, "A.", "en"), (100_001, "Éaux.", "fr"), (100_002, "?!", "en"), (100_003, "", "en"),
                                   (100_004, "日本語の文章はこの文書の中にはありませんので離れています。", "ja")], "doc_id long, text string, lang string")
    more = docs.select("doc_id", "text", "lang").unionByName(short)
    model = langid.train(docs.where(training_part("doc_id", 3) != 1))
    kept = {r["doc_id"] for r in langid.identify(more, model, ["doc_id"]).where("not rejected").collect()}
    assert {100_000, 100_001} <= kept and not {100_002, 100_003, 100_004} & kept
    assert len(kept) == docs.count() + 2


def plain_model(learn, k=langid.CENTROIDS, quantile=langid.REJECT_QUANTILE):
    """IDF, centroids by language and the rejection bound of all given (lang, text), one matrix a language."""
    df = np.zeros(langid.DIM)
    counts = {}
    for lang, text in learn:
        x = np.zeros(langid.DIM)
        for d, n in trigrams(text).items():
            x[d] = n
        df += x > 0
        counts.setdefault(lang, []).append(x)
    idf = np.log((1 + len(learn)) / (1 + df)) + 1
    centroids, floors = {}, []
    for lang in sorted(counts):
        x = np.log1p(np.array(counts[lang])) * idf
        x = x[x.any(axis=1)]
        if not len(x):
            continue
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = x[[np.argmax(x @ x.mean(axis=0))]]
        while len(c) < k and (x @ c.T).max(axis=1).min() <= 1 - 1e-6:
            c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
        for _ in range(langid.KMEANS_ROUNDS):
            own = np.argmax(x @ c.T, axis=1)
            c = np.array([x[own == j].mean(axis=0) for j in range(len(c)) if (own == j).any()])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
        centroids[lang] = c
        floors.append(np.quantile((x @ c.T).max(axis=1), quantile))
    return idf, centroids, 0.5 * min(floors)


def assert_like_plain(model, learn, **how):
    idf, centroids, bound = plain_model(learn, **how)
    assert np.allclose(model.idf, idf, rtol=1e-6)
    assert model.langs == [lang for lang, c in centroids.items() for _ in c]
    for lang, c in centroids.items():
        got = model.centroids[[i for i, x in enumerate(model.langs) if x == lang]]
        assert np.allclose(sorted(got.tolist()), sorted(c.tolist()), atol=1e-5)
    assert model.reject_below == pytest.approx(bound, abs=1e-6)


def test_centroids_and_bound_come_from_every_training_text(spark):
    """2,600 texts of one language, more than any sample took; forty of them are unlike the rest."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(400)]
    other = ["".join(rng.choices("qrstuvwxyzéü", k=rng.randint(3, 9))) for _ in range(60)]
    learn = [("aa", " ".join(rng.choices(words, k=rng.randint(6, 14)) + words[:2])) for _ in range(2560)]
    learn += [("aa", " ".join(rng.choices(other, k=rng.randint(6, 14)) + words[:2])) for _ in range(40)]  # no cosine is 0
    learn += [("bb", " ".join(rng.choices(other + words[:20], k=12) + words[:2])) for _ in range(90)]
    learn += [("bb", " ".join(["the same text", *words[:2]]))] * 30 + [("bb", "lang " * 400 + words[0])]
    learn += [("cc", "alone"), ("cc", "?!"), ("cc", "")]
    rng.shuffle(learn)
    docs = spark.createDataFrame([(i if i % 9 else None, lang, text) for i, (lang, text) in enumerate(learn)] + [
        (-1, None, "no language"), (-2, "aa", None)], "doc_id long, lang string, text string")
    model = langid.train(docs.repartition(3))
    assert_like_plain(model, learn)
    again = langid.train(docs.orderBy("text").repartition(7))
    assert again.langs == model.langs and again.reject_below == model.reject_below
    assert np.array_equal(again.centroids, model.centroids)  # whatever the order and the tasks


@pytest.mark.parametrize("quantile", [0.0, 0.3, 0.5, 1.0])
def test_quantiles_of_few_and_equal_cosines(spark, quantile):
    rng = random.Random(6)
    learn = [("aa", "".join(rng.choices("abcd ", k=90))) for _ in range(25)] + [("aa", "a bad cab bad dad")] * 8
    learn += [("bb", "".join(rng.choices("ijkl ", k=90))) for _ in range(3)]
    docs = spark.createDataFrame(learn, "lang string, text string")
    assert_like_plain(langid.train(docs, centroids=2, quantile=quantile), learn, k=2, quantile=quantile)


def test_a_language_without_a_trigram(spark):
    learn = [("aa", "some words"), ("aa", "more words of it"), ("dd", "?!"), ("dd", "")]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(learn)], "doc_id long, lang string, text string")
    assert_like_plain(langid.train(docs), learn)


def test_nothing_to_learn_from(spark, no_docs):
    model = langid.train(no_docs)
    assert model.langs == [] and model.centroids.shape == (0, langid.DIM) and model.reject_below == 0
    model = langid.train(spark.createDataFrame([("aa", "?!"), ("bb", "")], "lang string, text string"))
    assert model.langs == [] and model.reject_below == 0
