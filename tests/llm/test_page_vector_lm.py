"""HTML text, vectors, language-model scores, revisits, components and the pipeline."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matstream.llm import components, htmlcut, ngramlm, vecdup, warc
from matstream.llm.queries import QUERIES
from tests.llm.conftest import SF


# --- html ---------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; shoulders</h1><p><b>First  paragraph
goes here.<br><p>Second &lt;one&gt; with <a href="y">a link</a>.</p><div class="ad">Buy now.</div><form><p>Mail</p><input></form>
<ul><li>item one<li>item two</ul></article><aside><p>More stories here, many words, long enough to look like text.</p></aside>
<section id="comments"><p>I disagree with this article entirely, and here is why.</p></section><footer>&copy; 2020</footer>"""


def test_main_text():
    assert htmlcut.main_text(PAGE) == (
        "Head & shoulders\nFirst paragraph goes here.\nSecond <one> with a link.\nitem one\nitem two")


TEXT = ["The river rose in the night and the lower fields were under water by dawn.",
        "Nobody in the village had seen a flood like it since the bridge was built.",
        "By noon the boats had come, and the children were carried to the school."]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
SIDE = '<div class="sidebar"><p>More stories you may like to read.</p></div>'


@pytest.mark.parametrize("page", [
    f'<div class="layout with-sidebar"><article>{BODY}</article>{SIDE}</div>',
    f'<div class="sidebar-layout"><article>{BODY}</article>{SIDE}</div>',
    f'<div class="content has-comments">{BODY}</div><div class="comments"><p>I disagree.</p></div>',
    f'<div class="page-with-social">{BODY}</div>',
    f'<form id="aspnetForm"><div class="post">{BODY}</div>{SIDE}<form><p>Mail</p></form></form>',
    f'<form><nav>Home</nav><main>{BODY}</main><footer>2020</footer></form>',
    f'<div class="widget"><div class="sidebar">Tags and dates.</div><article>{BODY}<div class="ad">Buy now.</div></article></div>',
    f'<main>{BODY}</main><section class="related"><article><p>Ten things.</p></article></section>',
    f'<div class="post">{BODY}</div><section id="comments"><article class="comment"><p>I disagree.</p></article></section>',
])
def test_wrappers_named_like_boilerplate_keep_their_text(page):
    assert htmlcut.main_text(f"<html><body>{page}</body></html>") == "\n".join(TEXT)


def test_marks_cost_is_linear():
    import time
    page = '<div class="ad">x y z' * 20_000
    t = time.perf_counter()
    htmlcut.main_text(page)
    assert time.perf_counter() - t < 20


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></div>", "<script>never closed <p>x", "<!-- open <p>x"])
def test_pages_without_text(page):
    assert htmlcut.main_text(page) in ("", "<", "<p")


def test_minimum_cut_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        unary = rng.normal(0, 2, n).tolist()
        edges = {(i, j): float(rng.random() * 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(lab, unary=unary, edges=edges):
            return (sum(max(u, 0) for u, x in zip(unary, lab, strict=True) if not x)
                    + sum(max(-u, 0) for u, x in zip(unary, lab, strict=True) if x)
                    + sum(w for (i, j), w in edges.items() if lab[i] != lab[j]))

        best = min(cost(lab) for lab in itertools.product((False, True), repeat=n))
        assert cost(htmlcut.label(unary, edges)) == pytest.approx(best)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "plain &amp; text", "y")],
                               "page_id long, url string, html string, text string")
    got = htmlcut.extract(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert htmlcut.extract(df.limit(0)).count() == 0


# --- vectors --------------------------------------------------------------------------------------------------

def naive_vectors(data, threshold=0.98):
    n = len(data)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def ok(i):
        v = data[i][1]
        return (data[i][0] is not None and data[i][2] is not None and v and None not in v
                and np.isfinite(v).all() and any(v))

    for i, j in itertools.combinations(range(n), 2):
        if ok(i) and ok(j) and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]):
            x, y = np.array(data[i][1], float), np.array(data[j][1], float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(n):
        if ok(i):
            least[root(i)] = min(least.get(root(i), data[i][0]), data[i][0])
    return sorted(((data[i][0], links[i], least[root(i)] if ok(i) else data[i][0]) for i in range(n)), key=str)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vecdup, "BLOCK", 40)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(12, 16))
    data = []
    for i in range(260):
        v = centre[rng.integers(0, 12)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2])
        data.append((i, [float(x) for x in np.float32(v * rng.choice([1.0, 3.0]))], int(rng.integers(0, 2))))
    data += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, [1.0, 2.0], 0),
             (305, [2.0, 4.0], 0), (306, [1.0] * 16, None), (None, [1.0] * 16, 0), (0, data[0][1], data[0][2]), (307, [], 0)]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<float>, label int, vec string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vecdup.similar_vectors(df).collect()), key=str)
    assert got == naive_vectors(data)
    assert vecdup.similar_vectors(df.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = vecdup.quantise(x)
    gap = np.abs(x @ x.T - (s[:, None] * q) @ (s[:, None] * q).T)
    assert (gap <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(900 + i, 901 + i) for i in range(60)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


# --- language model ---------------------------------------------------------------------------------------------

def naive_lm(data):
    toks = [[*((t or "").encode().lower().split()), None] for _, t in data]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in data]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(t), sum(c[w] > 0 for w in t), n,
                    round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))
                   for (i, _), t, h in zip(data, toks, held, strict=True)), key=str)


@pytest.mark.parametrize("shard", [10**6, 40])
def test_lm_base_score(spark, docs, odd, shard):
    for df in (docs.limit(60), odd):
        data = [(r.doc_id, r.text) for r in df.collect()]
        df = spark.createDataFrame(data, "doc_id long, text string")
        got = ngramlm.score(df, shard).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == naive_lm(data)
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_lm_prefers_likely_text(spark, docs):
    got = ngramlm.score(docs).where("held_out and n_tokens > 50").collect()
    assert np.mean([r.score / r.n_tokens for r in got]) > np.mean([r.base_score / r.n_tokens for r in got])
    assert ngramlm.score(docs.limit(0)).count() == 0


def naive_score(data):
    toks = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() + [None]
            for _, t in data]
    train = [w for (i, _), w in zip(data, toks, strict=True) if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    one, two = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([0, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    q = lambda c: c if c < 2 else 1.25 * 2.0 ** math.floor(math.log2(c))
    out = []
    for w in toks:
        before = [q(one[x]) for x in [None, *w[:-1]]]
        out.append(sum(math.log10((min(q(two[p]), b) + 8 * min((q(one[p[1]]) + 0.5) / (n + 0.5 * (v + 1)), 1)) / (b + 8))
                       for p, b in zip(zip([0, *w], w, strict=False), before, strict=True)) / len(w))
    return out


@pytest.mark.parametrize("size", [10**6, 7])
def test_lm_keeps_every_ngram(spark, monkeypatch, size):
    """The model's score is that of all n-grams, however little room a filter of fixed size would have."""
    monkeypatch.setattr(ngramlm, "MAX_FILTER_BYTES", 1 << 14, raising=False)
    monkeypatch.setattr(ngramlm, "CODED_BYTES", 5000, raising=False)
    rng = np.random.default_rng(4)
    data = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 150) % 4000)) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in ngramlm.score(df, size).collect()}
    assert np.abs([got[i] - s for (i, _), s in zip(data, naive_score(data), strict=True)]).mean() < 0.002


def test_lm_sends_no_table_through_the_driver(spark, docs, monkeypatch):
    def refuse(*args, **kw):
        raise AssertionError("vocabulary or filter through the driver")

    few = docs.limit(20)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(few), name, refuse)
    ngramlm.score(few)


def test_filter_counts():
    rng = np.random.default_rng(9)
    key = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    count = rng.integers(1, 200, 3000)
    words = np.zeros(1 << 14, np.uint64)
    part = len(words) // ngramlm.BLOCKS
    for k, c in zip(key, count, strict=True):
        for lev in range(1, 2 + int(math.log2(c))):
            at, mask = ngramlm.LogFrequencyFilter.place(np.array([k]), lev, part)
            words[int(ngramlm.block_of(np.array([k]))[0]) * part + int(at[0])] |= mask[0]
    f = ngramlm.LogFrequencyFilter(words)
    assert (f.counts(key) >= np.minimum(count / 2, 1)).all()  # never lost
    assert (f.counts(rng.integers(0, 1 << 63, 3000).astype(np.uint64)) > 0).mean() < 0.1


# --- revisits -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("url, want", [
    ("HTTPS://WWW.A.com:443/x/?b=2&utm_source=f&a=1#top", "a.com/x?a=1&b=2"), ("http://m.a.com", "a.com"), (None, None),
    ("https://a.com/?ref=x", "a.com"), ("", ""),
])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(warc.canonical_url(F.col("url"))).first()[0] == want


def test_revisits_against_brute_force(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(400):
        u = f"https://a.com/{'hot' if rng.random() < 0.5 else rng.integers(0, 20)}"
        kind = "response" if rng.random() < 0.3 else "revisit"
        h = {k: v for k, v in (("ETag", f'"{rng.integers(0, 2)}"'), ("Content-Type", kind)) if k != "ETag" or rng.random() < 0.8}
        data.append((i, u, int(rng.integers(0, 200)), kind, h, f"p{i}" if kind == "response" else None))
    data += [(500, None, 1, "revisit", {}, None), (501, "https://a.com/hot", None, "revisit", None, None), (502, "https://a.com/1", 5, None, None, None)]
    df = spark.createDataFrame([(*d, 1) for d in data],
                               "record_id long, url string, time long, kind string, headers map<string,string>, payload string, part int")
    got = {r.record_id: r for r in warc.resolve_revisits(df, 13).collect()}
    assert len(got) == len(data)
    for i, u, t, kind, h, p in data:
        r = got[i]
        if kind != "revisit":
            assert r.status == "full" and r.payload == p
            continue
        prior = [d for d in data if u and t is not None and d[1] == u and d[3] != "revisit" and d[2] is not None and d[2] <= t]
        if not prior:
            assert r.status == "orphan"
            continue
        best = max(prior, key=lambda d: (d[2], d[0]))
        old, own = (best[4] or {}).get("ETag"), h.get("ETag")
        status = "no_validator" if old is None or own is None else "resolved" if old == own else "mismatch"
        assert r.status == status
        if status == "resolved":
            assert r.refers_to == best[0] and r.payload == best[5] and r.headers["Content-Type"] == "response"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


# --- queries and pipeline ---------------------------------------------------------------------------------------------

def test_pipeline(spark, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert out.columns == [*docs.columns, "copy"] and got
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}


def test_queries_read_whole_tables(spark, docs):
    for name in ("op1_secrets", "op4_html_text", "op9_warc_revisits"):
        assert QUERIES[name](spark, SF).count() >= 20
