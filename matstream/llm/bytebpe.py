"""Operator 11: byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded as a tree: its halves recursively, down to leaves of ``LEAF``
characters, and neighbours are joined at their seam. The value of a node is the
list of the codes (packed token ids) of the pattern's matches in the node's
text, taken as a whole text, so joining is associative. Two seams are repaired:

* **Matches.** A match depends on the text from its start on, to at most
  ``REACH`` characters behind its end. So the left half's matches that end that
  far before the seam stand. From the first that doesn't, a window over the seam
  is matched again; as soon as one of its matches starts where a match of the
  right half starts, all that follow are the right half's. The window grows until
  that happens.
* **Tokens** of a match that crosses the seam, and of any long match. A sequence
  of tokens that each encode to themselves is the encoding of its bytes if every
  two neighbours are: the merges inside two neighbours' bytes are those of the
  two alone until one crosses into another region, and the first that did would
  cross in the pair alone as well. So a window of tokens around the seam is encoded again,
  and the join is proved when both pairs at the window's ends encode to
  themselves; else the window doubles on the side that failed.

Decoding maps ids to bytes in leaves and concatenates up the tree.

The ranks are a bounded table (``MAX_RANK_BYTES``, checked) read by the driver
and broadcast. There is no shuffle: a text is one row and its tree lives in one task, with
time and memory linear in the text, and a lost executor's batches are encoded again.

Defined cases: a null text is empty and has no ids; repeated rows give repeated
rows; other columns are not read, so their names can't clash; an empty table gives an
empty one; very long texts and very long matches take the tree. Ids that are
not in the ranks make decoding fail.
"""

from __future__ import annotations

import base64
import heapq
import struct
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 4096            # characters of a leaf of the text's tree
TOKEN_LEAF = 48        # bytes of a match that are merged directly
REACH = 3              # characters behind a match's end that it may depend on (2 for public_tokenizers.PATTERN)
HEAP_FROM = 96         # bytes from which pairs are kept in a heap
NO_RANK = 1 << 60
SEAM = 64              # first characters of the right half that are matched again
CACHED_MATCHES = 300_000
CACHED_LENGTH = 200    # characters of a match that is worth remembering
MAX_RANK_BYTES = 64 << 20
OUT_BYTES = 16 << 20
IDS_A_LEAF = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (``base64 rank`` lines)."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no token for bytes {missing[:5]}")
    return ranks


class _Remembered(dict):
    """A function's results; when there are many, those not asked for since the last time are forgotten."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.older = fn, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary and pattern; texts are ``str``, codes packed ids (uint32, little-endian)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, token_leaf: int = TOKEN_LEAF,
                 reach: int = REACH):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.leaf, self.token_leaf, self.reach = max(leaf, 2), max(token_leaf, 2), reach
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.code = _Remembered(self._match_code, CACHED_MATCHES)
        self.stands = _Remembered(self._pair_stands, CACHED_MATCHES)

    # --- tokens of bytes --------------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """Merge neighbours of the lowest rank, leftmost first, until none is left."""
        if len(data) > HEAP_FROM:
            return self._merged_by_heap(data)
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [rank(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs:
            lowest = min(pairs)
            if lowest == NO_RANK:
                break
            i = pairs.index(lowest)
            del pairs[i]
            parts[i] += parts.pop(i + 1)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NO_RANK)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))        # end[i]: end of the part that starts at i
        start_of = list(range(-1, n))      # start_of[i]: start of the part before the one at i
        heap = []
        for i in range(n - 1):
            r = ranks.get(data[i:i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            r, i, j = heapq.heappop(heap)
            if dead[i] or end[i] >= n or end[end[i]] != j:
                continue                   # one of the two parts has been merged since
            mid = end[i]
            dead[mid] = 1
            end[i] = j
            if j < n:
                start_of[j] = i
                r = ranks.get(data[i:end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            p = start_of[i]
            if p >= 0:
                r = ranks.get(data[p:j])
                if r is not None:
                    heapq.heappush(heap, (r, p, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def _pair_stands(self, pair: tuple[int, int]) -> bool:
        return self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair]

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes."""
        if not a or not b:
            return a + b
        left = right = 1
        while True:
            window = a[-left:] + b[:right]
            tokens = self.merged(b"".join(map(self.bytes_of.__getitem__, window)))
            left_ok = left == len(a) or self.stands[a[-left - 1], tokens[0]]
            right_ok = right == len(b) or self.stands[tokens[-1], b[right]]
            if left_ok and right_ok:
                return a[:len(a) - left] + tokens + b[right:]
            if not left_ok:
                left = min(2 * left, len(a))
            if not right_ok:
                right = min(2 * right, len(b))

    def tokens(self, data: bytes) -> list[int]:
        """Halves recursively, joined at the seam."""
        if len(data) <= self.token_leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.join_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    # --- matches of a text ------------------------------------------------------------------

    def _match_code(self, match: str) -> bytes:
        data = match.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)   # a match that is a token is that token
        ids = [rank] if rank is not None else self.tokens(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _tokens_again(self, code: bytes) -> list[int]:
        ids = list(struct.unpack(f"<{len(code) // 4}I", code))
        return self.tokens(self.bytes_of[ids[0]]) if len(ids) == 1 else ids

    def _length(self, code: bytes) -> int:
        return len(self.decode(code).decode("utf-8", "surrogatepass"))

    def _crossing_code(self, match: str, start: int, seam: int, tail: list[tuple[int, bytes]], head: bytes | None,
                       head_end: int) -> bytes:
        """The code of a match over the seam, from the halves' own codes if it is just their two matches."""
        if len(match) > CACHED_LENGTH and start < seam and head is not None and start + len(match) == head_end:
            if tail and tail[-1][0] == start:
                ids = self._tokens_again(tail[-1][1])
                for _, code in reversed(tail[:-1]):
                    ids = self.join_tokens(ids, self._tokens_again(code))
                ids = self.join_tokens(ids, self._tokens_again(head))
                return struct.pack(f"<{len(ids)}I", *ids)
        return self.code[match]

    def _join(self, text: str, start: int, seam: int, end: int, left: list[bytes], right: list[bytes]) -> list[bytes]:
        cut, tail = seam, []              # matches of the left half from `cut` on may change
        while left and seam - cut < self.reach:
            code = left.pop()
            cut -= self._length(code)
            tail.append((cut, code))
        head = right[0] if right else None
        head_end = seam + self._length(head) if right else seam
        width = SEAM
        while True:
            stop = min(end, seam + width)
            at, same, j, again = cut, seam, 0, []
            met = False
            for match in self.find(text[cut:stop]):
                while same < at and j < len(right):
                    same += self._length(right[j])
                    j += 1
                if at >= seam and same == at:
                    met = True
                    break
                if stop < end and at + len(match) + self.reach > stop:
                    break
                again.append((at, match))
                at += len(match)
            if not met and stop == end:
                j, met = len(right), True
            if met:
                left += [self._crossing_code(m, s, seam, tail, head, head_end) for s, m in again]
                left += right[j:] if j else right
                return left
            width *= 4

    def _codes(self, text: str, start: int, end: int) -> list[bytes]:
        if end - start <= self.leaf:
            return list(map(self.code.__getitem__, self.find(text[start:end])))
        seam = (start + end) // 2
        return self._join(text, start, seam, end, self._codes(text, start, seam), self._codes(text, seam, end))

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        return b"".join(self._codes(text, 0, len(text)))

    def decode(self, code: bytes) -> bytes:
        """The bytes of packed ids."""
        ids = np.frombuffer(code, "<u4")
        if len(ids) <= IDS_A_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2 * 4
        return self.decode(code[:half]) + self.decode(code[half:])


_CODECS: dict[str, Codec] = {}   # of this worker process, by the call that made the broadcast


def _codec(call: str, pattern: str, table) -> Codec:
    """The call's codec, kept with what it remembers for the worker's later tasks."""
    if call not in _CODECS:
        if len(_CODECS) >= 4:
            _CODECS.clear()
        _CODECS[call] = Codec(table.value, pattern)
    return _CODECS[call]


def _mapped(df: DataFrame, cols: list[str], name: str, ranks_path: str, pattern: str, kind: str) -> DataFrame:
    """``cols`` and a binary column ``name`` made from the last of them by the codec's ``kind``."""
    table = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    call = uuid.uuid4().hex
    schema = T.StructType([df.schema[c] for c in cols] + [T.StructField(name, T.BinaryType())])
    source, kept = cols[-1], cols

    def run(batches):
        codec = _codec(call, pattern, table)
        for b in batches:
            values = b.column(b.schema.get_field_index(source))
            first, size, out = 0, 0, []
            for i, v in enumerate(values):
                v = v.as_py()
                if kind == "encode":
                    out.append(codec.encode(v) if v else b"")
                else:
                    out.append(codec.decode(v) if v else b"")
                size += len(out[-1])
                if size >= OUT_BYTES or i + 1 == b.num_rows:
                    part = b.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(kept))]
                                                     + [pa.array(out, pa.binary())], names=[*kept, name])
                    first, size, out = i + 1, 0, []

    return df.select(*cols).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the ids of every text as little-endian unsigned 32-bit integers; empty for a null text."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias(text_col)
    return _mapped(docs.select(id_col, text), [id_col, text_col], "ids", ranks_path, pattern, "encode").select(id_col, "ids")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids, data``: the bytes that the ids stand for."""
    return _mapped(encoded.select(id_col, ids_col), [id_col, ids_col], "data", ranks_path, r"(?s:.)", "decode")
