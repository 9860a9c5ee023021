"""Operator 1: secret scan by sliding-window entropy over candidate strings.

Base spans come from three fixed patterns. Beside them, every run of 16 or more
token characters is a candidate: for each character class a window slides over
the run (20 characters, 16 in shorter runs), its Shannon entropy kept up to date
from the counts of the character that enters and the one that leaves. Windows
that reach the entropy which all but about 0.2 % of random windows of that class
and length reach are merged to spans.

An allow-list suppresses what only looks random: windows that read like words,
paths and identifiers of regular parts, keyboard and alphabet rows, UUIDs,
numbers, placeholders, and digests named as such. What reads like words is learned:
letter pairs of all words of the corpus shorter than a candidate are counted (676
numbers, whatever the corpus), on top of a prior for words of Latin script, and a
window's pairs weigh as log odds of words against chance. Base spans are never
suppressed, and an added span inside a base span says nothing new.

Defined cases: null or empty text has no span; offsets are code points, end
exclusive; repeated rows each get their row; extra columns are ignored; without
documents the prior stands alone; work is linear in the text, however long a run is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.llm import textvec as tv

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_upper", "entropy_lower", "entropy_mixed")

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs, as a run is leftmost and greedy

SHORTEST = 16  # characters of a candidate
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)

#: class -> (characters, window, least entropy in bits: what 99.8 % of random windows of the class reach)
CLASSES = {
    "entropy_hex": (frozenset("0123456789abcdefABCDEF"), 20, 2.75),
    "entropy_upper": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 3.08),  # and base32
    "entropy_lower": (frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.1),
    "entropy_mixed": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.45),
}
#: the least entropy of the shortest window, which runs under 20 characters take
SHORT_LEAST = {"entropy_hex": 2.52, "entropy_upper": 2.83, "entropy_lower": 2.83, "entropy_mixed": 3.16}

# letter pairs common in words of Latin script (fixed values)
_COMMON = frozenset((
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ro "
    "ri io ic ne me li co ce ll ma om el la ch di ec us ho ta tr ee un ut be ca em ns no ge ss wh ow il ie so pe po pr ct ai "
    "rs ac ad ul lo ol mo ke ni pl am ir id ag ab ap av ep im op os ot ov sh tu ci fi fo fr gr ga ig iv ki lu mi mp nc nn na "
    "nu oc od oo pa pi qu rd rm rn rt ru sc sp su sm sk tt ty ts tw ue ui um up va vi wa we wi wo ye bl bo br bu by cl cr cu "
    "da do dr du ef ei eu ev ew ex ey fe fa fl ff go gl gu gh ht ia if ja je ju ka kt lt ly ls mb mm nk nf ny ob pp ph ps rc "
    "rg rk rl rr ry au ah ak ay ck eh ft fs hl hr ks kr ok pf sg tz ud ug ze zu").split())
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VOWELS = frozenset("aeiouy")
# prior log odds of a pair for words: common, vowel beside consonant, two vowels, two consonants
_COMMON_PAIR, _MIXED_PAIR, _VOWEL_PAIR, _CONSONANT_PAIR = 1.0, -0.5, -1.0, -4.0
_CAPITAL, _DIGIT, _SEPARATOR = -1.0, -1.5, 0.5  # a capital or digit behind a letter, a separator
_MOST, _LEAST = 1.5, -4.0  # weights of a learned pair
PRIOR_PAIRS = 100_000  # letter pairs that the prior counts for
#: a window reads like words over this weight, by its length (capitals and digits alone: over 0)
WORDLIKE = {16: -1.0, 20: -2.5}


def _prior(x: str, y: str) -> float:
    if x + y in _COMMON:
        return _COMMON_PAIR
    vowels = (x in _VOWELS) + (y in _VOWELS)
    return (_CONSONANT_PAIR, _MIXED_PAIR, _VOWEL_PAIR)[vowels]


_PRIOR = np.array([_prior(x, y) for x in _LETTERS for y in _LETTERS])


def pair_weights(seen: np.ndarray | None = None) -> dict[str, float]:
    """Weight of each pair of token characters for words, given counts of the 676 letter pairs in words."""
    share = np.exp2(_PRIOR)
    n = share / share.sum() * PRIOR_PAIRS
    if seen is not None:
        n = n + seen
    learned = np.log2(n / n.sum() * len(n))
    prior = _PRIOR - np.log2(share.mean())
    # a pair of words in a language that the corpus lacks weighs no less than before
    weight = np.clip(np.where(learned < prior, _PRIOR, _PRIOR + learned - prior), _LEAST, _MOST)
    out = {}
    for x in _TOKEN:
        for y in _TOKEN:
            if x.isalpha() and y.isalpha():
                w = (_CAPITAL if x.islower() and y.isupper() else
                     float(weight[_LETTERS.index(x.lower()) * 26 + _LETTERS.index(y.lower())]))
            elif x in "-_/" or y in "-_/":
                w = _SEPARATOR
            else:
                w = _DIGIT if x.isalpha() != y.isalpha() and x.isalnum() and y.isalnum() else 0.0
            out[x + y] = w
    return out


_TOKEN = "".join(sorted(CLASSES["entropy_mixed"][0]))
PRIOR_WEIGHTS = pair_weights()

_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[list(_TOKEN.encode())] = True
_LETTER = np.full(256, -1, np.int64)
_LETTER[list(_LETTERS.encode())] = _LETTER[list(_LETTERS.upper().encode())] = np.arange(26)


def letter_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of the letter pairs inside runs of token characters too short to be candidates."""
    seen = np.zeros(676, np.int64)
    for batch in batches:
        raw, off = tv.text_buffer(batch.column("text"))
        for lo, hi in tv.chunks(off):
            part = raw[off[lo]:off[hi]]
            if len(part) < 2:
                continue
            token = _IS_TOKEN[part]
            same = token[1:] & token[:-1]  # the characters on both sides are of one run
            cut = off[lo + 1:hi] - off[lo]
            same[cut[(cut > 0) & (cut < len(part))] - 1] = False
            edge = np.flatnonzero(~same)
            size = np.diff(np.concatenate([[-1], edge, [len(part) - 1]]))
            short = np.repeat(size < SHORTEST, size)[:-1]
            x, y = _LETTER[part[:-1]], _LETTER[part[1:]]
            camel = (part[:-1] >= 97) & (part[1:] < 97)
            seen += np.bincount((x * 26 + y)[same & short & (x >= 0) & (y >= 0) & ~camel], minlength=676)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(676, dtype=np.int32)), pa.array(seen)], names=["pair", "n"])


def learned_weights(docs: DataFrame) -> dict[str, float]:
    """``pair_weights`` of all words of the documents; 676 counts come to the driver, whatever the corpus."""
    counts = docs.select("text").mapInArrow(letter_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    seen = np.zeros(676, np.int64)
    for pair, n in counts.collect():
        seen[pair] = n
    return pair_weights(seen)


def word_weights(run: str, weights: dict[str, float] = PRIOR_WEIGHTS) -> list[float]:
    """Sums of the pair weights before each character of the run."""
    out = [0.0]
    for i in range(len(run) - 1):
        out.append(out[-1] + weights[run[i:i + 2]])
    return out


# allow-list (fixed values)
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_PLACEHOLDER = re.compile(r"(?i)example|sample|placeholder|changeme|your[_-]|dummy|xxxx|abcdefgh|12345678|01234567"
                          r"|qwertyuiop|qwertzuiop|azertyuiop|asdfghjkl|qsdfghjklm|zxcvbnm|yxcvbnm")
_REGULAR = re.compile(r"(?:[A-Z]{1,15}|[A-Z]?[a-z]{1,15})?[0-9]{0,4}")  # a part of a path or an identifier
_DIGEST_NAME = re.compile(r"(?i)(?:sha-?(?:1|224|256|384|512)|md5|checksum|digest|integrity|commit|etag)\W{0,4}$")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def high_entropy(run: str, chars: frozenset, width: int, least: float,
                 words: list[float] | None = None, wordlike: float = 0.0) -> Iterator[tuple[int, int]]:
    """Merged spans of ``run`` whose windows of ``width`` characters of the class reach ``least`` bits.

    With ``words`` (the run's ``word_weights``) windows over the weight ``wordlike`` read like words
    and don't count. Holds counts and the sum of c * log2(c); a step changes two counts.
    """
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    bits = math.log2(width)
    counts: dict[str, int] = {}
    total, size = 0.0, 0  # sum of c log2 c, characters in the window
    span: tuple[int, int] | None = None
    for i, ch in enumerate(run):
        if ch not in chars:
            counts, total, size = {}, 0.0, 0
            continue
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += weight[c + 1] - weight[c]
        size += 1
        if size > width:
            old = run[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c]
            size = width
        if size == width and bits - total / width >= least and (words is None or words[i] - words[i - width + 1] <= wordlike):
            at = i - width + 1
            if span and at <= span[1]:
                span = (span[0], i + 1)
            else:
                if span:
                    yield span
                span = (at, i + 1)
    if span:
        yield span


def _allowed(text: str, start: int, end: int, span: str) -> bool:
    """Whether a high-entropy span is known to be harmless."""
    if not any(c.isalpha() for c in span):
        return True  # numbers alone
    around = text[max(0, start - 36):end + 36]
    if any(m.start() + max(0, start - 36) <= start and end <= m.end() + max(0, start - 36) for m in _UUID.finditer(around)):
        return True
    return bool(_PLACEHOLDER.search(span) or _DIGEST_NAME.search(text[max(0, start - 24):start]))


def _regular(run: str) -> bool:
    """Whether a run is a path or name of three or more parts, each of one case, that hold vowels for the most part."""
    parts = [x for x in re.split(r"[/_=+-]", run) if x]
    long = [x for x in parts if len(x) > 2 and not x.isdigit()]
    return (len(parts) > 2 and len(long) > 1 and all(_REGULAR.fullmatch(x) for x in parts)
            and 3 * sum(bool(_VOWELS.intersection(x.lower())) for x in long) >= 2 * len(long))


def added_spans(text: str, base: list[tuple[int, int, str]],
                weights: dict[str, float] = PRIOR_WEIGHTS) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    for m in _CANDIDATE.finditer(text):
        run = m.group()
        if _regular(run):
            continue
        words = word_weights(run, weights)
        for kind, (chars, width, least) in CLASSES.items():
            if len(run) < width:
                width, least = SHORTEST, SHORT_LEAST[kind]
            wordlike = 0.0 if kind == "entropy_upper" else WORDLIKE[width]
            for a, z in high_entropy(run, chars, width, least, None if kind == "entropy_hex" else words, wordlike):
                a, z = a + m.start(), z + m.start()
                if _allowed(text, a, z, text[a:z]):
                    continue
                if kind == "entropy_mixed":  # one span for a token, the widest
                    found = [f for f in found if not (f[2] in ("entropy_upper", "entropy_lower") and a <= f[0] and f[1] <= z)]
                if not any(s <= a and z <= e for s, e, _ in base) and not any(s <= a and z <= e for s, e, _ in found):
                    found.append((a, z, kind))
    return found


_RANK = {k: i for i, k in enumerate(KINDS)}


def _joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1]))
    return ",".join(f"{k}:{a}:{z}" for a, z, k in ordered)


def _scan(weights: dict[str, float]):
    """Arrow function: the spans of each text, by the weights of letter pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[str, list[int]] = {k: [] for k in KINDS}
            digest, spans = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                every = base + added_spans(text, base, weights)
                for k in KINDS:
                    n[k].append(sum(s[2] == k for s in every))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            added = [sum(x) for x in zip(*[n[k] for k in CLASSES], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(n[k], pa.int64()) for k in ("assign", "access", "hex")],
                 pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return run


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, all spans as ``kind:start:end``."""
    return docs.select("doc_id", "text").mapInArrow(
        _scan(learned_weights(docs)),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
