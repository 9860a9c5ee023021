"""Operator 2: personal data by weak supervision.

One scan proposes candidate spans: those of the fixed base patterns and looser
ones (numbers written without a country code, digit groups inside a longer
chain, spelled-out addresses). Labelers vote on each: strict pattern, gazetteer,
context words, shape, neighbourhood. Equal vote vectors are counted over all
documents (at most ``3**5`` per kind) and expectation-maximisation estimates how
reliable each labeler is; a logistic classifier over shape features is then
fitted to the posteriors, weighted by the counts of equal feature vectors. A
second pass over the candidates (no texts) keeps base spans and every candidate
that the classifier accepts.

Defined cases: null or empty text has no span; repeated rows each get theirs;
spans are code point offsets, end exclusive, and may overlap between kinds;
with no candidate at all nothing is fitted; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matstream.llm.common import materialise, small

KINDS = ("email", "ip", "card", "phone")

# --- base patterns -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CHAIN = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# --- looser candidates ---------------------------------------------------------------------------

_LOOSE_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(r"[A-Za-z0-9._+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}"
                      r"(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{1,63}){1,4}")

# --- gazetteers and context words (fixed values) -------------------------------------------------

_ENDINGS = frozenset("com org net edu gov mil int info biz de fr es it uk us eu ch at nl be pt pl se no dk fi ie ca au "
                     "nz jp cn in br mx ar cl co io me".split())
_CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46",
                  "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81",
                  "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
_CARD_PREFIX = re.compile(r"4|5[1-5]|2[2-7]|3[47]|36|38|6011|65|35")
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|addr|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|cell|telefon|t[ée]l[ée]phone|tel[ée]fono)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:version|release|isbn|issn|order|invoice|ticket|section|chapter|build|sha|md5|hash)\b")
_CONTEXT = 40  # code points before a span


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long words cost no retries."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                    yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *s) for s in _ips(text)]
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            d = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Further candidates: dotted quads out of range, digit groups, national numbers, spelled-out addresses."""
    out = []
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            for g in _GROUP.finditer(text, *m.span()):
                if 13 <= g.end() - g.start() <= 19:
                    out.append(("card", *g.span()))
    out += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    if "(" in text or "[" in text:
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    return out


# --- labelers ------------------------------------------------------------------------------------

LABELERS = ("pattern", "gazetteer", "context", "shape", "neighbours")


def _gazetteer(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[.\x20\[\]()]+", span.rstrip(")] "))[-1].lower() in _ENDINGS else -1
    if kind == "ip":
        return -1 if digits[:1] == "0" or span.startswith("255.") else 0
    if kind == "card":
        return 1 if _CARD_PREFIX.match(digits) else -1
    if span.startswith("+"):
        return 1 if digits.startswith(_CALLING_CODES) else -1
    return 0


def _shape(kind: str, span: str, digits: str) -> int:
    if kind == "card":
        return 1 if luhn(digits) and len(set(digits)) > 2 else -1
    if kind == "ip":
        return 1 if all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in span.split(".")) else -1
    if kind == "phone":
        return 1 if len(digits) >= 10 and len(set(digits)) > 2 else -1
    name = span.split("@")[0]
    return 1 if 1 < len(name) <= 64 and not name.startswith(".") and ".." not in span else -1


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote (-1, 0, 1) per labeler."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    before = text[max(0, start - _CONTEXT):start]
    context = 1 if _CUES[kind].search(before) else -1 if _AGAINST.search(before) else 0
    left, right = text[start - 1:start], text[end:end + 1]
    inside = left.isalnum() or right.isalnum() or (left in "-._/" and left != "")
    return (1 if base else -1, _gazetteer(kind, span, digits), context, _shape(kind, span, digits), -1 if inside else 1)


def features(text: str, kind: str, start: int, end: int, vote: tuple[int, ...]) -> tuple[int, ...]:
    """Small integers: the votes other than pattern, and buckets of size, digits and separators."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    marks = sum(not c.isalnum() for c in span)
    return (*vote[1:], min(len(span) // 4, 8), min(4 * digits // max(len(span), 1), 4), min(marks, 5))


# --- expectation-maximisation and the classifier ----------------------------------------------------

def em(vote_rows: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each distinct vote vector, and P(vote | class) of each labeler (classes x labelers x 3).

    Two classes, labelers independent given the class; starts from the mean vote.
    """
    n, m = vote_rows.shape
    post = np.clip(0.5 + vote_rows.mean(axis=1) / 2, 0.05, 0.95)
    table = np.zeros((2, m, 3))
    for _ in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            w = weight * p
            for v in range(3):
                # one pseudo-count per vote, three for the vote that agrees with the class
                prior = 3.0 if v == 2 * c else 1.0
                table[c, :, v] = ((vote_rows == v - 1) * w[:, None]).sum(axis=0) + prior
        table /= table.sum(axis=2, keepdims=True)
        share = (weight * post).sum() + 1.0
        prior1 = share / (weight.sum() + 2.0)
        score = np.zeros((2, n))
        for c, p in ((0, 1 - prior1), (1, prior1)):
            score[c] = np.log(p) + sum(np.log(table[c, j, vote_rows[:, j] + 1]) for j in range(m))
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return post, table


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; soft targets."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


_LEVELS = (3, 3, 3, 3, 9, 5, 6)  # votes shifted by one, then the buckets


def _design(f: np.ndarray) -> np.ndarray:
    """One-hot columns of the feature levels and a constant."""
    f = f.copy()
    f[:, :4] += 1
    cols = [np.ones((len(f), 1))]
    cols += [np.eye(n)[f[:, j]] for j, n in enumerate(_LEVELS)]
    return np.concatenate(cols, axis=1)


def classify(counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> dict[tuple, float]:
    """(kind, votes, features, count) rows -> probability of each (kind, features)."""
    out: dict[tuple, float] = {}
    for kind in KINDS:
        rows = [r for r in counts if r[0] == kind]
        if not rows:
            continue
        v, f = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        w = np.array([r[3] for r in rows], dtype=float)
        post, _ = em(v, w)
        x = _design(f)
        b = fit_logistic(x, post, w)
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        out.update({(kind, tuple(map(int, r[2]))): float(q) for r, q in zip(rows, p, strict=True)})
    return out


# --- jobs ------------------------------------------------------------------------------------------

_CAND = "struct<kind:string,start:int,stop:int,base:boolean,votes:array<int>,features:array<int>>"
_CAND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                                  ("base", pa.bool_()), ("votes", pa.list_(pa.int32())),
                                  ("features", pa.list_(pa.int32()))]))
ACCEPT = 0.5
MAX_BROADCAST_SPANS = 500_000  # under 100 bytes each


def candidates_of(text: str | None) -> list[dict]:
    if not text:
        return []
    base = base_spans(text)
    seen = set(base)
    found = [(b, True) for b in base]
    for s in loose_spans(text):
        if s not in seen:
            seen.add(s)
            found.append((s, False))
    out = []
    for (kind, a, z), is_base in found:
        v = votes(text, kind, a, z, is_base)
        out.append({"kind": kind, "start": a, "stop": z, "base": is_base, "votes": list(v),
                    "features": list(features(text, kind, a, z, v))})
    return out


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = [candidates_of(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"),
                                              pa.array(found, _CAND_ARROW)], names=["doc_id", "text_key", "found"])


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, found``: every candidate span of every text, with votes and features."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_candidate_batches, f"doc_id long, text_key long, found array<{_CAND}>")


def train(found: DataFrame) -> dict[tuple, float]:
    """Acceptance of each (kind, features) from the counts of equal candidates (a bounded table)."""
    c = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    return classify([(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in c.collect()])


def _digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def accepted(found: DataFrame, model: dict[tuple, float]) -> DataFrame:
    """Spans kept per row: counts and digest of the base, all spans as text and as structs."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            n, digest, text, kept_all = {k: [] for k in KINDS}, [], [], []
            for row in batch.column("found").to_pylist():
                row = sorted(row or [], key=lambda c: (rank[c["kind"]], c["start"], c["stop"]))
                base = [c for c in row if c["base"]]
                kept = [c for c in row if c["base"] or p.get((c["kind"], tuple(c["features"])), 0.0) >= ACCEPT]
                # an accepted candidate inside a base span of its kind says nothing new
                kept = [c for c in kept if c["base"] or not any(
                    b["kind"] == c["kind"] and b["start"] <= c["start"] and c["stop"] <= b["stop"] for b in base)]
                for k in KINDS:
                    n[k].append(sum(c["kind"] == k for c in base))
                digest.append(_digest([f"{c['kind']}:{c['start']}:{c['stop']}" for c in base]))
                text.append(",".join(f"{c['kind']}:{c['start']}:{c['stop']}" for c in kept))
                kept_all.append([{"kind": c["kind"], "start": c["start"], "stop": c["stop"]} for c in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *[pa.array(n[k], pa.int64()) for k in KINDS],
                 pa.array(digest, pa.string()), pa.array(text, pa.string()),
                 pa.array(kept_all, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                                        ("stop", pa.int32())])))],
                names=["doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "found"])

    return found.mapInArrow(run, "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, "
                                 "base_sha256 string, spans string, found array<struct<kind:string,start:int,stop:int>>")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every document."""
    found = materialise(candidates(docs), "pii")
    return accepted(found, train(found))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are one."""
    cols = docs.columns
    spans = personal_data(docs).where(F.size("found") > 0).select(
        F.col("doc_id").alias("_pii_id"), F.col("text_key").alias("_pii_key"), F.col("found").alias("_pii_found"))
    spans = materialise(spans.dropDuplicates(["_pii_id", "_pii_key"]), "pii-span")
    n = spans.agg(F.coalesce(F.sum(F.size("_pii_found")), F.lit(0))).first()[0]
    spans = small(spans) if n <= MAX_BROADCAST_SPANS else spans
    keyed = docs.withColumn("_pii_text_key", F.xxhash64("text"))
    j = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_pii_id")) & (F.col("_pii_text_key") == F.col("_pii_key")),
                   "left")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, new, size = batch.column("text").to_pylist(), [], []
            for text, found in zip(texts, batch.column("_pii_found").to_pylist(), strict=True):
                text = _masked(text, found) if found else text
                new.append(text)
                size.append(None if text is None else len(text))
            changed = batch.column("_pii_found").is_valid()
            out = []
            for c in cols:
                if c == "text":
                    out.append(pa.array(new, batch.column("text").type))
                elif c == "n_chars":
                    out.append(pa.compute.if_else(changed, pa.array(size, pa.int64()), batch.column("n_chars").cast(pa.int64())))
                else:
                    out.append(batch.column(c))
            yield pa.RecordBatch.from_arrays(out, names=cols)

    return j.select(*cols, "_pii_found").mapInArrow(run, schema)


def _masked(text: str, found: list[dict]) -> str:
    merged: list[list] = []
    for c in sorted(found, key=lambda c: (c["start"], -c["stop"])):
        if merged and c["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], c["stop"])
        else:
            merged.append([c["start"], c["stop"], c["kind"]])
    cuts = [0, *itertools.chain.from_iterable((a, z) for a, z, _ in merged), len(text)]
    parts = [text[cuts[0]:cuts[1]]]
    for i, (_, _, kind) in enumerate(merged):
        parts += [f"[{kind.upper()}]", text[cuts[2 * i + 2]:cuts[2 * i + 3]]]
    return "".join(parts)
