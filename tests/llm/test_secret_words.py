"""Operator 1's added spans: short tokens, learned words, and the whole query against brute force."""

import math
import random
import re
import string
from collections import Counter

import pytest

from matstream.llm import secrets

ALPHABETS = {"lower": string.ascii_lowercase, "base32": string.ascii_uppercase + "234567", "letters": string.ascii_letters,
             "lower and digits": string.ascii_lowercase + string.digits, "base64": string.ascii_letters + string.digits + "+/"}


def found(text, weights=secrets.PRIOR_WEIGHTS):
    base = secrets.base_spans(text)
    return base + secrets.added_spans(text, base, weights)


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("size", [16, 17, 18, 19])
def test_tokens_from_sixteen_characters_are_found(name, size):
    rnd = random.Random(size)
    texts = ["key " + "".join(rnd.choice(ALPHABETS[name]) for _ in range(size)) + " end" for _ in range(600)]
    assert sum(not found(t) for t in texts) <= 12


@pytest.mark.parametrize("text", [
    "/usr/local/lib/python3.13/site-packages", "node_modules/webpack-dev-server/client", "usr/share/doc/gcc-12-base",
    "qwertyuiopasdfghjkl", "zxcvbnmasdfghjkl", "MAXIMUM_CONNECTION_TIMEOUT", "straightforwardness", "muvaffakiyetsizlestirme",
    "gerceklestirilmesi", "kolmivaihekilowattitunti", "yhteiskunnallinen", "felelossegteljesen", "verantwoordelijkheid",
    "arbetsmarknadsdepartementet", "precipitevolissimevolmente", "desproporcionadamente", "pertanggungjawaban",
    "uniwersytet-jagiellonski", "prestolonaslednikovica", "cyfrifiadureiddio", "internationalisierung"])
def test_words_paths_and_keyboard_rows_are_none(text):
    assert not found(text)


def naive_pairs(texts):
    n = Counter()
    for t in texts:
        for run in re.findall(r"[A-Za-z0-9+/_=-]+", t or ""):
            if len(run) < 16:
                for x, y in zip(run, run[1:]):
                    if re.fullmatch("[A-Za-z]{2}", x + y) and not (x.islower() and y.isupper()):
                        n[(x + y).lower()] += 1
    return n


def test_letter_pairs_are_those_of_all_words(spark, docs):
    got = Counter()
    for r in docs.select("text").mapInArrow(secrets.letter_pairs, "pair int, n long").collect():
        got[chr(97 + r.pair // 26) + chr(97 + r.pair % 26)] += r.n
    assert +got == naive_pairs([r.text for r in docs.collect()])


def naive_added(text, weights):
    """Windows one by one, each with its entropy from its own counts."""
    hot = {}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        run = m.group()
        if secrets._regular(run):
            continue
        for kind, (chars, width, least) in secrets.CLASSES.items():
            if len(run) < 20:
                width, least = 16, secrets.SHORT_LEAST[kind]
            limit = 0.0 if kind == "entropy_upper" else secrets.WORDLIKE[width]
            for i in range(len(run) - width + 1):
                w = run[i:i + width]
                entropy = -sum(c / width * math.log2(c / width) for c in Counter(w).values())
                words = sum(weights[w[j:j + 2]] for j in range(width - 1))
                if set(w) <= chars and entropy >= least - 1e-9 and (kind == "entropy_hex" or words <= limit + 1e-9):
                    hot.setdefault((m.start(), kind), []).append((m.start() + i, m.start() + i + width))
    merged = []
    for (_, kind), spans in hot.items():
        a, z = spans[0]
        for x, y in spans[1:]:
            if x > z:
                merged.append((a, z, kind))
                a = x
            z = y
        merged.append((a, z, kind))
    merged = [(a, z, k) for a, z, k in merged if not secrets._allowed(text, a, z, text[a:z])]
    mixed = [s for s in merged if s[2] == "entropy_mixed"]
    inside = lambda s, t: t[0] <= s[0] and s[1] <= t[1]
    base = secrets.base_spans(text)
    kept = []
    for s in merged:
        later = [t for t in mixed if s[2] in ("entropy_upper", "entropy_lower") and inside(s, t)
                 and not any(inside(t, b) for b in base)]
        earlier = [t for t in merged[:merged.index(s)] if inside(s, t)
                   and not (s[2] == "entropy_mixed" and t[2] in ("entropy_upper", "entropy_lower") and inside(t, s))]
        if not later and not earlier and not any(inside(s, b) for b in base):
            kept.append(s)
    return base + kept


def test_query_against_brute_force(spark, docs):
    rnd = random.Random(8)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    texts += [(10**6 + i, f"Das token {''.join(rnd.choice(a) for _ in range(n))} steht, mot internationalisation/{i}")
              for i, (a, n) in enumerate((a, n) for a in ALPHABETS.values() for n in (15, 16, 19, 20, 33, 64) for _ in range(4))]
    pairs = naive_pairs([t for _, t in texts])
    weights = secrets.pair_weights([pairs[x + y] for x in string.ascii_lowercase for y in string.ascii_lowercase])
    want = {i: secrets._joined(naive_added(t or "", weights)) for i, t in texts}
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.spans for r in secrets.secret_spans(frame).collect()}
    assert got == want
    assert sum(i >= 10**6 and "entropy" in s for i, s in got.items()) > 80


def test_empty_texts_leave_the_prior(no_docs):
    assert secrets.learned_weights(no_docs) == secrets.PRIOR_WEIGHTS
