"""Document fingerprints: a digest of quartiles of byte-triplet buckets, and a bounded difference of two digests.

Every window of five bytes gives six triplets, hashed to 128 buckets. A bucket's count is coded by its quartile among all; the digest
also has the length's logarithm, the quartiles' ratios and a check byte. The layout follows the published locality-sensitive hash of
Oliver, Cheng and Chen (2013); hashes and score are of their own.

For neighbours in the order of ids, texts are dealt by range of doc_id and read in order, one row after the other, with the row before
at hand. A partition's last row and the first of the next one that isn't empty meet in a small join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import column, on_executors, stored, to_batch

BUCKETS = 128
BOUND = 256
_BLOCK = 1 << 17
#: Pairs of distances back from a window's newest byte that make a triplet with it.
_TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_TABLE = np.random.default_rng(20240305).integers(0, 2**32 - 1, (3, 256), dtype=np.uint32)
_COST = np.array([0, 1, 2, 6])


def digest(data: bytes) -> str:
    """Lowercase hexadecimal: check byte, length code, ratios of the quartiles, and two bits for each bucket."""
    a = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for s in range(0, max(len(a) - 4, 0), _BLOCK):
        b = a[s : s + _BLOCK + 4]
        x, y, z = (t[b] for t in _TABLE)
        for salt, (i, j) in enumerate(_TRIPLETS):
            h = (x[4:] + y[4 - i : len(b) - i] + z[4 - j : len(b) - j] + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]].tolist()
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.unpackbits(code[:, None], axis=1)[:, 6:].ravel()).tobytes()
    ratio = lambda q: (q * 100 // q3) % 16 if q3 else 0
    length = min(255, int(np.floor(np.log(len(a)) / np.log(1.1)))) if len(a) else 0
    return bytes([hashlib.blake2b(data, digest_size=1).digest()[0], length, ratio(q1) << 4 | ratio(q2)]).hex() + body.hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests; the sum over buckets of the cost of their codes' distance, and of the headers' distances, BOUND at most."""
    if a == b:
        return 0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    around = lambda p, q, n: min((p - q) % n, (q - p) % n)
    header = abs(int(x[1]) - int(y[1])) + around(int(x[2]) >> 4, int(y[2]) >> 4, 16) + around(int(x[2]) & 15, int(y[2]) & 15, 16) + (x[0] != y[0])
    codes = lambda v: (np.unpackbits(v[3:]).reshape(-1, 2) @ np.array([2, 1], np.uint8)).astype(np.int64)
    return int(min(BOUND, header + _COST[np.abs(codes(x) - codes(y))].sum()))


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_PACKED = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_PRINTS = pa.schema([*_FIELDS, ("kind", pa.int32()), ("part", pa.int32()), ("packed", pa.binary())])
RESULT, FIRST, LAST = 0, 1, 2


def _row(doc_id, text: str, own: str, following: str, other: str) -> tuple:
    new = edited(text, following).encode()
    changed = digest(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), own, changed, likeness(own, changed), likeness(own, other)


def packed_of(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield to_batch(_PACKED, column(batch, "doc_id"), [pack.compress((t or "").encode()) for t in column(batch, "text").to_pylist()])


def neighbours_of(batches):
    """Rows in the order of doc_id: a result for each but the last, and the first and the last as they are."""
    from pyspark import TaskContext

    part, unpack, last = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), None
    bare = lambda r, kind: (r[0], None, None, None, None, None, None, kind, part, r[3])
    for batch in batches:
        out = []
        for doc_id, packed in zip(column(batch, "doc_id").to_pylist(), column(batch, "packed").to_pylist(), strict=True):
            data = unpack.decompress(packed)
            now = doc_id, data.decode(), digest(data), packed
            if last is None:
                out.append(bare(now, FIRST))
            else:
                out.append((*_row(*last[:3], now[1], now[2]), RESULT, part, None))
            last = now
        if out:
            yield to_batch(_PRINTS, *zip(*out, strict=True))
    if last is not None:
        yield to_batch(_PRINTS, *zip(bare(last, LAST), strict=True))


def edges_of(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc_id, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = unpack.decompress(a), unpack.decompress(b)
            out.append(_row(doc_id, a.decode(), digest(a), b.decode(), digest(b)))
        if out:
            yield to_batch(pa.schema(_FIELDS), *zip(*out, strict=True))


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next doc_id; after the last comes the first, and a single row is its own next. Null ids come first, rows
    of one id in the order of their packed texts. Null texts count as empty; texts of less than five bytes have no triplets, and differ
    in header only. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.mapInArrow(on_executors("fingerprints", "packed_of"), "doc_id long, packed binary")
    dealt = packed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")
    prints = stored(dealt.mapInArrow(on_executors("fingerprints", "neighbours_of"), f"{_RESULT}, kind int, part int, packed binary"), "prints")
    parts = sorted(r.part for r in prints.where(F.col("kind") == FIRST).select("part").collect())  # one number for each partition
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    first = prints.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("packed").alias("b"))
    last = prints.where(F.col("kind") == LAST).select("part", "doc_id", F.col("packed").alias("a"))
    edges = last.join(after, "part").join(first, "next").select("doc_id", "a", "b").mapInArrow(on_executors("fingerprints", "edges_of"), _RESULT)
    return prints.where(F.col("kind") == RESULT).select(edges.columns).unionByName(edges)
