"""Suffix-array dedup by prefix-free parsing: the bytes of 200-byte strings that occur more than once in the corpus.

Parsing. A rolling hash is taken of every 100-byte string; one that is least (leftmost of equal ones) among the 101 of some
200-byte string is a trigger. Whether it is, only depends on that string, so equal strings have their trigger at the same
place. A text falls into phrases, from a string's start to the end of its trigger, each followed by what comes after the
trigger: no phrase with its trigger is a proper prefix of another, and a string starts in one phrase only.

1. `anchors`: for every run of 200-byte strings with the same trigger (at most 101 starts), the trigger's hash and the hash of
   the run's whole content. Dealt by trigger. A trigger that occurs once ends the matter for all its strings. Where a run's
   whole content occurs again, all its strings do. That settles all but the edges of repeated passages, without any text.
2. For edges, and for one run of each different content that they are compared with, the content is dealt by trigger, and
   `repeated_starts` puts its suffixes into corpus order: the suffix array of the dictionary (the distinct phrases) orders
   them by phrase, the ranks of the parse's continuations by what follows, and neighbours with 200 bytes in common repeat.
3. A trigger with more than `crowd` different runs is not gathered: each of its strings goes by its own hash, and is counted.

The texts with removed bytes are read once more to cut them; texts without any, and texts removed whole, are not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _BYTE, mix, powers
from .util import column, on_executors, stored, to_batch, utf8

LENGTH = 200
CROWD = 4096
_U = np.uint64
_CHUNK = 1 << 19
_AT_ONCE = 1 << 21
FULL, EDGE = 0, 1

_EXACT = _BYTE.copy()
_EXACT[65:91] = np.random.default_rng(20240302).integers(1, 2**64 - 1, 26, dtype=np.uint64)  # here A-Z aren't a-z

_ANCHORS = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("row", pa.int64()), ("run", pa.int64()), ("told", pa.bool_())])
_VERDICTS = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("run", pa.int64()), ("kind", pa.int32())])
_BASE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
_TEXTS = pa.schema([("row", pa.int64()), ("n_bytes", pa.int64()), ("packed", pa.binary())])
_NOTHING = hashlib.sha256(b"").hexdigest()
_EDGES = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("trigger", pa.int32()), ("content", pa.binary())])
_STRINGS = pa.schema([("string", pa.int64()), ("row", pa.int64()), ("start", pa.int64())])
_STARTS = pa.schema([("row", pa.int64()), ("starts", pa.list_(pa.int64()))])
_CUT = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def prefix_hashes(a: np.ndarray) -> np.ndarray:
    power, _ = powers(len(a) + 1)
    h = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_EXACT[a] * power[: len(a)], out=h[1:])
    return h


def string_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings [start, end) from the prefix hashes; the length is part of it."""
    _, inverse = powers(len(h))
    return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, from running minima of blocks."""
    n, pad = len(v), -len(v) % width
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).ravel()[:n]
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return np.minimum(back[: n - width + 1], ahead[width - 1 :])


def runs(a: np.ndarray, h: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first, last) of every run: strings with starts from first to last have their trigger at that place."""
    w = length // 2
    out = []
    for s in range(0, len(a) - length + 1, _CHUNK):
        e = min(s + _CHUNK, len(a) - length + 1)  # starts s to e - 1
        start = np.arange(s, e + length - w)
        _, inverse = powers(len(h))
        v = mix((h[start + w] - h[start]) * inverse[start])
        v = (v & _U(~((1 << 20) - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(start), dtype=np.uint64)
        place = (_sliding_least(v, length - w + 1) & _U((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        out.append((place[new] + s, new + s, np.append(new[1:], e - s) - 1 + s))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors_of(batches, length: int):
    """A run is packed as 256 * its first start + its number of further starts, of which there are at most length // 2.

    Of runs with the same content in a batch only the first goes on to be compared; all of them are told at once to repeat.
    """
    w = length // 2
    for batch in batches:
        out = []
        for row, t in zip(column(batch, "row").to_pylist(), utf8(batch), strict=True):
            if t is None or len(t) < length:
                continue
            a = np.frombuffer(t, np.uint8)
            h = prefix_hashes(a)
            at, lo, hi = runs(a, h, length)
            content = string_hashes(h, lo, hi + length) + mix((at - lo).astype(np.uint64))
            out.append((string_hashes(h, at, at + w).view(np.int64), content.view(np.int64), np.full(len(at), row), lo * 256 + hi - lo))
        if out:
            key, content, row, run = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((content, key))
            new = np.append(True, (key[order[1:]] != key[order[:-1]]) | (content[order[1:]] != content[order[:-1]]))
            first = order[new]
            several = order[np.repeat(np.diff(np.append(np.flatnonzero(new), len(order))) > 1, np.diff(np.append(np.flatnonzero(new), len(order))))]
            yield to_batch(_ANCHORS, *(np.concatenate([x[first], x[several]]) for x in (key, content, row, run)), np.repeat([False, True], [len(first), len(several)]))


def base_of(batches):
    for batch in batches:
        texts = [t or b"" for t in utf8(batch)]
        yield to_batch(_BASE, column(batch, "doc_id"), column(batch, "row"), [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts])


def verdicts_of(batches):
    """Rows in the order of (told, key, content), those that are told just go on. Of others: FULL for every row of a content that has several, EDGE for the first row of every content of a key that has several.

    Kept from batch to batch: the last row, the key's first row, and whether that is the only content so far.
    """
    last = lead = None  # (key, content, row, run, starts a content), (row, run, is the key's only content)
    for batch in batches:
        told = column(batch, "told")
        if told.true_count:
            gone = batch.filter(told)
            yield to_batch(_VERDICTS, column(gone, "key"), column(gone, "row"), column(gone, "run"), np.full(len(gone), FULL, np.int32))
            batch = batch.filter(pa.array(~told.to_numpy(zero_copy_only=False)))
        key, content, row, run = (column(batch, c).to_numpy() for c in ("key", "content", "row", "run"))
        if not len(key):
            continue
        if last is not None:
            key, content, row, run = (np.insert(x, 0, v) for x, v in zip((key, content, row, run), last[:4], strict=True))
        new_key = np.append(last is None, key[1:] != key[:-1])
        new = np.append(last is None, content[1:] != content[:-1]) | new_key
        begins = new.copy()
        if last is not None:
            begins[0] = last[4]
        again = ~new
        if last is not None:
            again[0] = False  # it was told before
        both = again.copy()
        both[:-1] |= again[1:] & begins[:-1]
        other = new & ~new_key
        at = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), -1))
        lead_row = np.where(at >= 0, row[np.maximum(at, 0)], lead[0] if lead else 0)
        lead_run = np.where(at >= 0, run[np.maximum(at, 0)], lead[1] if lead else 0)
        seen = np.cumsum(other)
        before = np.where(at >= 0, seen[np.maximum(at, 0)], 0)
        second = other & (seen - before == 1) & ((at >= 0) | bool(lead and lead[2]))
        out = [np.concatenate([x[both], x[other], y[second]]) for x, y in ((key, key), (row, lead_row), (run, lead_run))]
        kind = np.repeat(np.array([FULL, EDGE, EDGE], np.int32), [both.sum(), other.sum(), second.sum()])
        only = seen[-1] == before[-1] and (at[-1] >= 0 or bool(lead and lead[2]))
        last = key[-1], content[-1], row[-1], run[-1], begins[-1]
        lead = lead_row[-1], lead_run[-1], only
        yield to_batch(_VERDICTS, *out, kind)


def texts_of(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        keep = [(r, len(t), pack.compress(t)) for r, t in zip(column(batch, "row").to_pylist(), utf8(batch), strict=True) if t]
        yield to_batch(_TEXTS, *([x[j] for x in keep] for j in range(3)))


def _of_edges(batches, length: int, crowded: bool):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row, packed, edges in zip(*(column(batch, c).to_pylist() for c in ("row", "packed", "edges")), strict=True):
            edges = sorted((e["run"] >> 8, e["run"] & 255, e["key"]) for e in edges if e["crowded"] == crowded)
            if edges:
                t = unpack.decompress(packed)
                yield row, t, np.frombuffer(t, np.uint8), edges


def edges_of(batches, length: int):
    out, size = [], 0
    for row, t, a, edges in _of_edges(batches, length, False):
        at, lo, _ = runs(a, prefix_hashes(a), length)
        place = dict(zip(lo.tolist(), at.tolist(), strict=True))
        for s, more, key in edges:
            out.append((key, row, s, more + 1, place[s] - s, t[s : s + more + length]))
            size += more + length
            if size > _AT_ONCE:
                yield to_batch(_EDGES, *zip(*out, strict=True))
                out, size = [], 0
    if out:
        yield to_batch(_EDGES, *zip(*out, strict=True))


def strings_of(batches, length: int):
    for row, _, a, edges in _of_edges(batches, length, True):
        h = prefix_hashes(a)
        start = np.concatenate([np.arange(s, s + more + 1) for s, more, _ in edges])
        yield to_batch(_STRINGS, string_hashes(h, start, start + length).view(np.int64), np.full(len(start), row), start)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def repeated_starts(items: list[tuple[int, int, bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For each run (its number of starts, its trigger's place, its content): which of its strings are in another place of the runs.

    The corpus order of the strings comes from the suffix array of the dictionary, that is, of all distinct phrases up to the end of
    their trigger, and from the ranks of what follows from the trigger on.
    """
    w = length // 2
    phrase: dict[bytes, int] = {}
    of = np.array([phrase.setdefault(c[: t + w], len(phrase)) for _, t, c in items])
    phrases = list(phrase)
    begin = np.concatenate([[0], np.cumsum([len(p) - w + 1 for p in phrases])])
    suffixes = [p[x:] for p in phrases for x in range(len(p) - w + 1)]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    group = np.zeros(len(suffixes), np.int64)
    group[order] = np.cumsum([k > 0 and suffixes[order[k - 1]] != suffixes[order[k]] for k in range(len(order))])

    follows = [c[t:] for _, t, c in items]
    distinct = sorted(set(follows))
    number = {f: k for k, f in enumerate(distinct)}
    rank = np.array([number[f] for f in follows])
    common = [np.array([_common(a, b) for a, b in zip(distinct, distinct[1:])] or [0])]
    while len(common[-1]) > 1 << (len(common) - 1):
        step = 1 << (len(common) - 1)
        common.append(np.minimum(common[-1][:-step], common[-1][step:]))

    n = np.array([n for n, _, _ in items])
    item = np.repeat(np.arange(len(items)), n)
    x = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    trigger = np.array([t for _, t, _ in items])[item]
    g, r = group[begin[of[item]] + x], rank[item]
    order = np.lexsort((r, g))
    g, r, need = g[order], r[order], (length - trigger + x)[order]
    same = g[1:] == g[:-1]
    width = r[1:] - r[:-1]
    reach = np.full(len(width), length)
    for level, table in enumerate(common):
        k = np.flatnonzero(same & (width >= 1 << level) & (width < 2 << level))
        reach[k] = np.minimum(table[r[:-1][k]], table[r[1:][k] - (1 << level)])
    same &= reach >= need[1:]
    hit = np.zeros(len(item), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    return [x[a:b][hit[a:b]] for a, b in zip(np.cumsum(n) - n, np.cumsum(n), strict=True)]


def starts_of(batches, length: int):
    """Rows in the order of key. Whole keys are taken together, up to about _AT_ONCE bytes of content."""
    held, size, last = [], 0, None

    def settle():
        found: dict[int, list[int]] = {}
        for (_, row, lo, *_), x in zip(held, repeated_starts([i[3:] for i in held], length), strict=True):
            if len(x):  # as runs of neighbouring starts
                first = np.flatnonzero(np.append(True, np.diff(x) > 1))
                last = np.append(first[1:], len(x)) - 1
                found.setdefault(row, []).extend(((x[first] + lo) * 256 + x[last] - x[first]).tolist())
        return to_batch(_STARTS, list(found), list(found.values()))

    for batch in batches:
        for key, row, lo, n, trigger, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last and size > _AT_ONCE:
                yield settle()
                held, size = [], 0
            last = key
            held.append((key, row, lo, n, trigger, content))
            size += len(content)
    if held:
        yield settle()


def cut_of(batches, length: int, with_text: bool):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for row, packed, full, starts in zip(*(column(batch, c).to_pylist() for c in ("row", "packed", "full", "starts")), strict=True):
            a = np.frombuffer(unpack.decompress(packed), np.uint8)
            run = np.array((full or []) + (starts or []), np.int64)
            edge = np.zeros(len(a) + 1, np.int64)
            np.add.at(edge, run >> 8, 1)
            np.add.at(edge, (run >> 8) + (run & 255) + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = a[~gone].tobytes()
            out.append((row, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        if out:
            yield to_batch(_CUT, *zip(*out, strict=True))


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """Adds a row's identity, a hash of its id and text."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def repeated_bytes(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, row, n_bytes, n_removed, n_spans, kept_sha256, and kept.

    kept is null unless with_text is set and bytes go; it is the text of the remaining bytes, without characters that lost some of theirs.

    Removed is each byte that is covered by a string of `length` bytes (at most 508) of the text's UTF-8 that also starts anywhere else,
    in this or another row; strings never cross rows, and are judged on the input. Null counts as empty. Texts shorter than `length`
    stay whole. Of repeated rows of at least that length each is removed whole, since each occurs elsewhere. Other columns are
    not read. An empty table gives an empty result.
    """
    docs = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    run = lambda name, *args: on_executors("suffixes", name, *args)
    anchors = docs.select("row", "text").mapInArrow(run("anchors_of", length), "key long, content long, row long, run long, told boolean")
    dealt = anchors.repartition(F.when(F.col("told"), F.xxhash64("row", "run")).otherwise(F.col("key")))
    verdicts = stored(
        dealt.sortWithinPartitions("told", "key", "content").mapInArrow(run("verdicts_of"), "key long, row long, run long, kind int"), "verdicts"
    )
    edges = verdicts.where(F.col("kind") == EDGE)
    crowds = edges.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key", F.lit(True).alias("crowded"))
    edges = edges.join(crowds, "key", "left").select("row", "key", "run", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    full = verdicts.where(F.col("kind") == FULL).select("row", "run", F.lit(None).cast("long").alias("key"), F.lit(None).cast("boolean").alias("crowded"))
    found = full.unionByName(edges).groupBy("row").agg(
        F.collect_set(F.when(F.col("key").isNull(), F.col("run"))).alias("full"),
        F.collect_set(F.when(F.col("key").isNotNull(), F.struct("key", "run", "crowded"))).alias("edges"),
    )
    found = stored(found.withColumn("covered", F.aggregate("full", F.lit(0).cast("long"), lambda n, r: n + F.pmod(r, F.lit(256)) + 1)), "found")

    base = docs.mapInArrow(run("base_of"), "doc_id long, row long, n_bytes long, sha256 string")
    base = base.join(found.select("row", "covered"), "row", "left").withColumn("whole", F.coalesce(F.col("covered") == F.col("n_bytes") - (length - 1), F.lit(False)))
    packed = docs.select("row", "text").mapInArrow(run("texts_of"), "row long, n_bytes long, packed binary")
    whole = F.col("covered") == F.col("n_bytes") - (length - 1)
    texts = stored(packed.join(found, "row").where(~whole | (F.size("edges") > 0)).dropDuplicates(["row"]), "texts")

    contents = texts.select("row", "packed", "edges").mapInArrow(run("edges_of", length), "key long, row long, lo long, n int, trigger int, content binary")
    starts = contents.repartition("key").sortWithinPartitions("key").mapInArrow(run("starts_of", length), "row long, starts array<long>")
    strings = stored(texts.select("row", "packed", "edges").mapInArrow(run("strings_of", length), "string long, row long, start long"), "strings")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    crowded = strings.join(twice, "string").groupBy("row").agg(F.collect_list(F.col("start") * 256).alias("starts"))
    starts = starts.unionByName(crowded).groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = texts.select("row", "packed", "full").join(starts, "row", "left").mapInArrow(
        run("cut_of", length, with_text), "row long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )
    gone = lambda name, value, none: F.when(F.col("whole"), value).otherwise(F.coalesce(F.col(name), none)).alias(name)
    zero = F.lit(0).cast("long")
    return base.join(cut, "row", "left").select(
        "doc_id", "row", "n_bytes", gone("n_removed", F.col("n_bytes"), zero), gone("n_spans", F.lit(1).cast("long"), zero),
        gone("kept_sha256", F.lit(_NOTHING), F.col("sha256")), gone("kept", F.lit("" if with_text else None).cast("string"), F.lit(None).cast("string")),
    )
