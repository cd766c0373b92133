"""Best-fit packing of documents into bins of fixed capacity, under conflicts of source and of duplicate cluster.

A document longer than a bin is cut into pieces of the bin's size and a rest. Pieces are dealt by hash to shards of about `shard`
pieces, and each shard packs its own by best-fit decreasing: bins stand in the order of their residual and carry bitmaps of the
sources and clusters in them; from the least residual that holds a piece, the search goes on to the next one until a bin
conflicts in neither, which so is the tightest compatible one; else a bin is opened. Text is never moved.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import on_executors, to_batch

CAPACITY = 8192
SHARD = 20_000
_OFTEN = 64

_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_bytes", pa.int64()), ("bin", pa.int64()), ("slot", pa.int32())])


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, slot) of each piece. Larger pieces come first, equal ones in the given order; None conflicts with nothing.

    For sources and clusters of many pieces, the number of bins without them is kept by residual, so that a search does
    not visit bins that all conflict.
    """
    number = lambda values: {v: k for k, v in enumerate(sorted((v for v, n in Counter(values).items() if v is not None and n > 1), key=str))}
    bit_s, bit_c = number(sources), number(clusters)
    often = [("s", v) for v, n in Counter(sources).items() if n >= _OFTEN and v is not None] + [("c", v) for v, n in Counter(clusters).items() if n >= _OFTEN and v is not None]
    row = {k: j for j, k in enumerate(often)}
    free = np.zeros((len(often) + 1, capacity + 1), np.int32)  # the last row: all bins
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    masks: list[list[int]] = []
    lacks: list[np.ndarray] = []
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size, s, c = sizes[k], sources[k], clusters[k]
        rows = [row[x] for x in (("s", s), ("c", c)) if x in row] or [len(often)]
        s_bit, c_bit = 1 << bit_s[s] if s in bit_s else 0, 1 << bit_c[c] if c in bit_c else 0
        there = free[rows[0], size:] > 0
        if len(rows) > 1:
            there &= free[rows[1], size:] > 0
        found = None
        for residual in np.flatnonzero(there) + size:
            found = next((b for b in levels[residual] if not (masks[b][0] & s_bit or masks[b][1] & c_bit)), None)
            if found is not None:
                levels[residual].remove(found)
                free[lacks[found], residual] -= 1
                break
        else:
            residual = capacity
            found = len(masks)
            masks.append([0, 0])
            lacks.append(np.arange(len(often) + 1))
            used.append(0)
        out[k] = found, used[found]
        used[found] += 1
        masks[found][0] |= s_bit
        masks[found][1] |= c_bit
        lacks[found] = lacks[found][~np.isin(lacks[found], [r for r in rows if r < len(often)])]
        levels[residual - size].append(found)
        free[lacks[found], residual - size] += 1
    return out


def packed_of(batches, capacity: int):
    """Rows in the order of shard. Bins are numbered shard * 2**32 + their number in it."""
    held, last = [], None

    def settle():
        held.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        got = best_fit([r[4] for r in held], [r[5] for r in held], [r[6] for r in held], capacity)
        return to_batch(_PACKED, *([r[j] for r in held] for j in (1, 2, 3, 4)), [(last << 32) + b for b, _ in got], [s for _, s in got])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[0] != last and held:
                yield settle()
                held = []
            last = r[0]
            held.append(r)
    if held:
        yield settle()


def pack(docs: DataFrame, length: str = "length", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Rows (doc_id, piece, start, n_bytes, bin, slot): the pieces of every row of docs (doc_id, and columns for length, source and cluster) and their bins.

    No bin holds over `capacity`, nor two pieces of one source or of one cluster, but pieces without room beside them are alone in any case.
    Null lengths count as 0, and a row of length 0 is one piece of 0; null sources and clusters conflict with nothing. Repeated rows are
    packed each. Pieces of one document conflict with each other as its source does. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")).alias("n"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("long").alias("cluster")
    )
    count = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("long")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).withColumn("start", F.col("piece") * capacity)
    n = rows.agg(F.sum(count)).first()[0] or 0
    shards = max(1, -(-n // shard))
    pieces = pieces.select(
        F.pmod(F.xxhash64("doc_id", "piece", "source", "n", "cluster"), F.lit(shards)).cast("long").alias("shard"), "doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("long").alias("n_bytes"), "source", "cluster"
    )
    dealt = pieces.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(on_executors("packing", "packed_of", capacity), "doc_id long, piece long, start long, n_bytes long, bin long, slot int")
