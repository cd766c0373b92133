"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text's spaces become U+2581 with one more in front, and it is cut before each run of them: no piece of such a vocabulary goes from
another character to U+2581, so no merge crosses there. A unit's adjacent pairs that join to a piece are on an agenda by score, leftmost
first of equal ones; the best is merged, its new pairs with both neighbours go on the agenda, and entries whose symbols have changed
since are passed over. What is no piece in the end is spelt in bytes. So n characters take about n log n steps, however long a unit is.

Units recur: each worker keeps those that it knows, with ids and decoded text, in two generations of up to `_KNOWN_BYTES`: when the younger
is full, the older goes, and what was used since is in the younger. All new units of an Arrow batch are
checked against the sentencepiece library in one call, ids and decoded text; a difference is an error. Long units are not kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import column, on_executors, to_batch

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_KNOWN_BYTES = 128 << 20
_LONG = 256
#: An agenda's entry is one number: a rank, and in so many low bits a place.
_PLACE = 32
_PLACES = (1 << _PLACE) - 1
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_codecs: dict[str, Codec] = {}


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for n, v in model if n == 1]
        trainer, normalizer = (dict(_fields(next(v for n, v in model if n == k))) for k in (2, 3))
        if trainer.get(3, 1) != 2 or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not trainer.get(35, 0):
            raise ValueError(f"{path}: only merge-type vocabularies with byte fallback, a space in front and no other normalisation are supported")
        self.text = [p[1].decode() for p in pieces]
        self.kind = [p.get(3, _NORMAL) for p in pieces]
        score = [struct.unpack("<f", p.get(2, b"\0" * 4))[0] for p in pieces]
        if any(k in (_USER, _UNUSED) for k in self.kind) or any(SPACE in t.lstrip(SPACE) for t, k in zip(self.text, self.kind, strict=True) if k == _NORMAL):
            raise ValueError(f"{path}: its pieces go across spaces, or are user-defined or unused")
        self.unk, self.bos, self.eos = trainer.get(40, 0), trainer.get(41, 1), trainer.get(42, 2)
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == _NORMAL}
        self.byte = [0] * 256
        self.value = {}
        for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)):
            if k == _BYTE:
                self.byte[int(t[1:-1], 16)] = i
                self.value[i] = int(t[1:-1], 16)
        # Symbols are numbered: the pieces, and single characters that are no pieces but start or end one.
        n = len(self.text)
        self.symbol = dict(self.ids)
        for t in self.ids:
            for c in t:
                self.symbol.setdefault(c, n + len(self.symbol) - len(self.ids))
        #: The joined piece by both symbols, in keys whose low bits are of both, as a dictionary goes by these. `none` is in no pair.
        self.none = n + len(self.symbol) - len(self.ids)
        self.width = self.none + 1 | 1
        self.pairs = {self.symbol[t[:k]] * self.width + self.symbol[t[k:]]: i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.symbol and t[k:] in self.symbol}
        #: By piece; equal scores have equal ranks, so that the leftmost of them goes first.
        rank = {v: k for k, v in enumerate(sorted(set(score), reverse=True), 1)}
        self.rank = [rank[v] << _PLACE for v in score]
        self.rank[0] = 0  # stands for no pair
        if 0 in self.ids.values():
            raise ValueError(f"{path}: its first piece is a normal one")
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.kept = 0

    def merge(self, unit: str) -> list[int]:
        """The ids of a unit, by the agenda."""
        get, rank, width, none = self.pairs.get, self.rank, self.width, self.none
        s = [self.symbol.get(c, none) for c in unit]
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(a * width + b, 0) for a, b in zip(s, s[1:])]  # what the pair that starts at each place joins to
        agenda = [rank[i] + k for k, i in enumerate(now) if i]
        now.append(0)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            k = entry & _PLACES
            joined = now[k]
            if rank[joined] + k != entry:
                continue
            m = after[k]
            s[k], now[m] = joined, 0
            m = after[k] = after[m]
            if m < n:
                before[m] = k
                now[k] = i = get(joined * width + s[m], 0)
                if i:
                    heappush(agenda, rank[i] + k)
            else:
                now[k] = 0
            m = before[k]
            if m >= 0:
                now[m] = i = get(s[m] * width + joined, 0)
                if i:
                    heappush(agenda, rank[i] + m)
        pieces, out, k = len(self.text), [], 0
        while k < n:
            if s[k] < pieces:
                out.append(s[k])
            else:
                out += [self.byte[b] for b in unit[k].encode()]
            k = after[k]
        return out

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, str]]:
        """(ids, decoded) of units, checked against the library. U+2581 stays in decoded."""
        coded = [self.merge(u) for u in units]
        decoded = [self.joined(ids) for ids in coded]
        at = [k for k, u in enumerate(units) if u[0] == SPACE and len(u) > 1]  # a text of nothing gets no space in front
        theirs = self.library.encode([units[k][1:].replace(SPACE, " ") for k in at], num_threads=1)
        for k, ids, text in zip(at, theirs, self.library.decode(theirs), strict=True):
            if ids != coded[k] or text != decoded[k][1:].replace(SPACE, " "):
                raise ValueError(f"unit {units[k]!r}: {coded[k]}, {decoded[k]!r}; the library has {ids}, {text!r}")
        return {u: (np.array(ids, "<u4").tobytes(), t) for u, ids, t in zip(units, coded, decoded, strict=True)}

    def encode_batch(self, texts: list[str], begin: bool = True, end: bool = True) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of whole texts."""
        cut = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if self.kept > _KNOWN_BYTES:
            self.older, self.known, self.kept = self.known, {}, 0
        new = {u for units in cut for u in units} - self.known.keys()
        again = {u: self.older[u] for u in new if u in self.older}
        new -= again.keys()
        new = (self.learn(sorted(new)) if new else {}) | again
        known = self.known
        known.update(new)
        first, last = (struct.pack("<I", i) if on else b"" for i, on in ((self.bos, begin), (self.eos, end)))
        out = []
        for units in cut:
            found = [known[u] for u in units]
            text = "".join([t for _, t in found])
            out.append((first + b"".join([i for i, _ in found]) + last, (text[1:] if text.startswith(SPACE) else text).replace(SPACE, " ")))
        for u, (ids, _) in new.items():
            if len(u) > _LONG:
                del known[u]
            else:
                self.kept += 250 + 4 * len(u) + len(ids)
        return out

    def joined(self, ids: list[int]) -> str:
        """The text of ids, with U+2581: control pieces are silent, and bytes that are no UTF-8 become U+FFFD."""
        parts, spelt, value = [], bytearray(), self.value
        for i in ids:
            b = value.get(i)
            if b is not None:
                spelt.append(b)
                continue
            if spelt:
                parts.append(_spelt(spelt))
                spelt = bytearray()
            if self.kind[i] == _NORMAL:
                parts.append(self.text[i])
            elif self.kind[i] == _UNKNOWN:
                parts.append(" ⁇ ")
        if spelt:
            parts.append(_spelt(spelt))
        return "".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian 32-bit); the space in front goes."""
        out = self.joined(np.frombuffer(ids, "<u4").tolist())
        return (out[1:] if out.startswith(SPACE) else out).replace(SPACE, " ")


def _spelt(b: bytearray) -> str:
    """Bytes as text, each one that belongs to no whole character as U+FFFD."""
    out, k = [], 0
    while k < len(b):
        n = 1 if b[k] < 0x80 else 2 if 0xC2 <= b[k] < 0xE0 else 3 if 0xE0 <= b[k] < 0xF0 else 4 if 0xF0 <= b[k] < 0xF5 else 1
        try:
            out.append(bytes(b[k : k + n]).decode())
            k += n
        except UnicodeDecodeError:
            out.append("�")
            k += 1
    return "".join(out)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_STEP = 1 << 22


def coded_of(batches, path: str, begin: bool, end: bool, with_values: bool):
    c = codec(path)
    for batch in batches:
        ids, texts = column(batch, "doc_id").to_pylist(), [t or "" for t in column(batch, "text").to_pylist()]
        k = 0
        while k < len(texts):
            e, size = k, 0
            while e < len(texts) and (e == k or size + len(texts[e]) <= _STEP):
                size += len(texts[e])
                e += 1
            coded, decoded = map(list, zip(*c.encode_batch(texts[k:e], begin, end), strict=True))
            sha = lambda values: [hashlib.sha256(v).hexdigest() for v in values]
            yield to_batch(
                _CODED, ids[k:e], [len(x) // 4 for x in coded], coded if with_values else [None] * (e - k), decoded if with_values else [None] * (e - k), sha(coded), sha([d.encode() for d in decoded])
            )
            k = e


def encode_decode(docs: DataFrame, path: str, begin: bool = True, end: bool = True, with_values: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded, ids_sha256, decoded_sha256.

    ids and decoded are null unless with_values. path is that of the vocabulary on every executor. Null texts count as empty: only begin
    and end ids, decoded to an empty text. Equal texts have equal results. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(
        on_executors("pieces", "coded_of", path, begin, end, with_values, mb=64), "doc_id long, n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string"
    )
