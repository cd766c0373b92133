"""N-gram Jaccard join: all documents whose sets of word shingles are alike, found by T-occurrence search.

The plan, over whole texts:

1. `facts`: a row for each document with its set's size and 64-bit identity (equal sets have equal ones), and the
   counts of shingles that several documents of a batch hold. The counts set the order of shingles, rare first. Any
   order gives the same result, so the table that is broadcast may be, and is, bounded: `hot_tokens` rows.
2. `shared`: the first shingles of each set in that order, so many that of two sets at the threshold, each has at least
   `needed` of its own among the other's. Dealt by shingle; those of one set only end here, and then all sets that have
   fewer than `needed` left. Documents with the same set count as one.
3. A shingle's sets, by classes of size that can be alike, are searched from their least one, the leader: a T-occurrence
   search (`divide_skip`) in the inverted lists of the sets that share a shingle with it.
4. Sets that share a shingle, but neither is its leader, and that are not in one component by now: they are searched
   likewise in blocks, one for each component of leaders, cut to `block` sets a side.
5. Components of these links, and the least doc_id of each.
6. `jaccard_links` only: all sets of a component are compared with each other by counting in inverted lists, and each set's
   links are counted there, so that no table of pairs is made.

Steps 3 and 4 only look for links that join components: a group of near copies costs them a search from one leader, not all
pairs in it. Every link is within a component, so step 6 misses none.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import WORDS, set_id, shingle_set
from .suffixes import with_row
from .util import column, discard, on_executors, stored, to_batch, unused, utf8

PERCENT = 80
HOT_TOKENS = 1 << 19
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
_MU = 0.003
_LEVELS = 16

_FACTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("token", pa.int64()), ("uses", pa.int64())])
_POSTINGS = pa.schema([("token", pa.int64()), ("node", pa.int64())])
_CANDIDATES = pa.schema([("token", pa.int64()), ("leader", pa.int64()), ("leader_n", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
_MARKS = 1 << 24
_TEXTS = pa.schema([("row", pa.int64()), ("packed", pa.binary())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_COUNTS = pa.schema([("node", pa.int64()), ("n_links", pa.int64())])
_AT_ONCE = 1 << 21


def required(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of sets of a and b members with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def needed(n: int) -> int:
    """How many of a set's first shingles a like set must share, at least."""
    return n // 20 + 1


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """The first shingles of a set. Of two like sets a and b, let a's end first in the order: those of b among them are b's first ones, too.

    The overlap is percent of n at least, and n - prefix_length(n) of it may come later, so needed(n) of them are shared.
    """
    return min(n, n - -(-percent * n // 100) + needed(n))


def divide_skip(lists: list[np.ndarray], threshold: int, mu: float = _MU) -> list[tuple[int, int]]:
    """(id, occurrences) of the ids that are in at least `threshold` of the sorted lists, in the order of id.

    The longest lists are set aside; the short ones are merged by a heap that skips to where an id can still reach what is
    needed without the long ones; all that do are probed in one long list after the other by binary search, as long as they can
    still reach the threshold.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if threshold < 1 or len(lists) < threshold:
        return []
    aside = min(threshold - 1, int(threshold / (mu * log2(len(lists[-1])) + 1)))
    short, long = [np.asarray(x).tolist() for x in lists[: len(lists) - aside]], lists[len(lists) - aside :]
    need = threshold - aside
    at = [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    ids, counts = [], []
    while len(heap) >= need:
        least = heap[0][0]
        popped = []
        while heap and heap[0][0] == least:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            ids.append(least)
            counts.append(len(popped))
            for k in popped:
                at[k] += 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
            for k in popped:
                at[k] = bisect_left(short[k], target, at[k])
        for k in popped:
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))
    ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
    for left, x in zip(range(len(long), 0, -1), long, strict=True):
        can = counts + left >= threshold
        if not can.all():
            ids, counts = ids[can], counts[can]
        if not len(ids):
            break
        x = np.asarray(x)
        counts += x[np.minimum(np.searchsorted(x, ids), len(x) - 1)] == ids
    reached = counts >= threshold
    return list(zip(ids[reached].tolist(), counts[reached].tolist(), strict=True))


def search(queries: list[tuple[int, int, np.ndarray]], index: list[tuple[int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links between queries and indexed sets, each (node, component, set), that join all components which any link joins.

    What is of a query's own component by now is left out of the inverted lists.
    """
    if not queries or not index:
        return
    index = sorted(index, key=lambda x: len(x[2]))
    sizes = np.array([len(s) for _, _, s in index], np.int64)
    tokens, owner = np.concatenate([s for _, _, s in index]), np.repeat(np.arange(len(index), dtype=np.int32), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    number: dict[int, int] = {}
    comp = np.array([number.setdefault(c, len(number)) for _, c, _ in index], np.int64)
    asks = [number.setdefault(c, len(number)) for _, c, _ in queries]
    now = np.arange(len(number))  # the component that each is in by now
    for own, (node, _, s) in zip(asks, queries, strict=True):
        lo, hi = np.searchsorted(sizes, [-(-percent * len(s) // 100), len(s) * 100 // percent + 1])
        alive = now[comp] != now[own]
        alive[:lo] = alive[hi:] = False
        if not alive.any():
            continue
        start, end = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        start, end = start[end > start], end[end > start]
        t = required(len(s), int(sizes[np.argmax(alive)]), percent)
        if len(start) < t:
            continue
        held = np.concatenate([owner[a:b] for a, b in zip(start, end, strict=True)])
        keep = alive[held]
        cuts = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(end - start))]
        held = held[keep]
        for k, count in divide_skip([held[a:b] for a, b in pairwise(cuts.tolist())], t):
            if now[comp[k]] != now[own] and count >= required(len(s), int(sizes[k]), percent):
                yield node, index[k][0]
                now[now == now[comp[k]]] = now[own]


def facts_of(batches, least: int, k: int):
    for batch in batches:
        sets = [shingle_set(t or b"", k) for t in utf8(batch)]
        nodes = [set_id(s) if len(s) else None for s in sets]
        yield to_batch(_FACTS, column(batch, "doc_id"), column(batch, "row"), [len(s) for s in sets], nodes, pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64()))
        once = {n: s for n, s in zip(nodes, sets, strict=True) if n is not None}
        if once:
            token, uses = np.unique(np.concatenate(list(once.values())), return_counts=True)
            token, uses = token[uses >= least].view(np.int64), uses[uses >= least]
            yield to_batch(_FACTS, *(pa.nulls(len(token), pa.int64()) for _ in range(4)), token, uses)


def postings_of(batches, hot, percent: int, k: int):
    (token, uses), seen = hot.value, set()
    for batch in batches:
        out = []
        for t in utf8(batch):
            s = shingle_set(t or b"", k)
            if not len(s) or (node := set_id(s)) in seen:
                continue
            seen.add(node)
            if len(token):
                at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                s = s[np.lexsort((s, np.where(token[at] == s, uses[at], 0)))]
            s = s[: prefix_length(len(s), percent)]
            out.append((s.view(np.int64), np.full(len(s), node)))
        if out:
            yield to_batch(_POSTINGS, np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))


def shared_of(batches):
    """Rows in the order of (token, node): those of the tokens with several nodes, once for each node. The state kept is the last row and whether it was told."""
    last = None
    for batch in batches:
        token, node = column(batch, "token").to_numpy(), column(batch, "node").to_numpy()
        if not len(token):
            continue
        told = False
        if last is not None:
            token, node, told = np.insert(token, 0, last[0]), np.insert(node, 0, last[1]), last[2]
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node = token[new], node[new]
        same = token[1:] == token[:-1]
        keep = np.append(same, False) | np.append(False, same)
        last = token[-1], node[-1], bool(keep[-1]) or (len(token) == 1 and told)
        keep[0] &= not told
        yield to_batch(_POSTINGS, token[keep], node[keep])


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that can be alike are in one class or in two neighbouring ones."""
    return np.floor(np.log(n) / -np.log(percent / 100) + 1e-9).astype(np.int64)


def candidates_of(batches, percent: int):
    """Rows (token, node, n) in the order of (token, n, node). A group holds two neighbouring classes of a token, and its first node is its leader.

    Kept from batch to batch: the token, its last class and the first nodes of that and of the class before.
    """
    state = None
    for batch in batches:
        token, node, n = (column(batch, c).to_numpy() for c in ("token", "node", "n"))
        if not len(token):
            continue
        kind = size_class(n, percent)
        begin = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])))
        own, before = np.empty((len(begin), 2), np.int64), np.empty((len(begin), 2), np.int64)
        for k, i in enumerate(begin):
            t, c, first = int(token[i]), int(kind[i]), (int(node[i]), int(n[i]))
            if state is None or state[:2] != (t, c):
                lead = state[2] if state is not None and state[:2] == (t, c - 1) else first
                state = t, c, first, lead
            own[k], before[k] = state[2], state[3]
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(token))))
        lead = np.concatenate([before[run], own[run]])
        out = [np.concatenate([token * 64 + kind % 64, token * 64 + (kind + 1) % 64]), lead[:, 0], lead[:, 1], np.tile(node, 2), np.tile(n, 2)]
        keep = out[1] != out[3]
        yield to_batch(_CANDIDATES, *(x[keep] for x in out))


def texts_of(batches, wanted):
    """(row, packed text) of the rows whose marks are set, once for each row identity of a task."""
    pack, marks, seen = zstandard.ZstdCompressor(level=1), wanted.value, set()
    for batch in batches:
        rows = column(batch, "row").to_numpy()
        hit = np.flatnonzero(marks[rows & (_MARKS - 1)])
        out = []
        for row, t in zip(rows[hit].tolist(), utf8(batch.take(pa.array(hit))), strict=True):
            if row not in seen:
                seen.add(row)
                out.append((row, pack.compress(t or b"")))
        if out:
            yield to_batch(_TEXTS, *zip(*out, strict=True))


def links_of(batches, percent: int, k: int):
    """Rows (block, part, asks, node, comp, packed) in the order of block, part: one search for each block and part of it."""
    unpack = zstandard.ZstdDecompressor()
    now, queries, index = None, {}, {}
    for batch in batches:
        links = []
        for row in batch.to_pylist():
            if (key := (row["block"], row["part"])) != now:
                links += search(list(queries.values()), list(index.values()), percent)
                now, queries, index = key, {}, {}
            side = queries if row["asks"] else index
            if row["node"] not in side:
                side[row["node"]] = row["node"], row["comp"], shingle_set(unpack.decompress(row["packed"]), k)
        yield to_batch(_LINKS, [a for a, _ in links], [b for _, b in links])
    links = list(search(list(queries.values()), list(index.values()), percent))
    yield to_batch(_LINKS, [a for a, _ in links], [b for _, b in links])


def count_links(queries: list[tuple[int, np.ndarray]], index: list[tuple[int, np.ndarray]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the indexed sets each query is like, and the other way round; both (node, set). A node isn't compared with itself."""
    sizes = np.array([len(s) for _, s in index], np.int64)
    nodes = np.array([n for n, _ in index], np.int64)
    tokens, owner = np.concatenate([s for _, s in index]), np.repeat(np.arange(len(index)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    asked, held = np.zeros(len(queries), np.int64), np.zeros(len(index), np.int64)
    for j, (node, s) in enumerate(queries):
        start = np.searchsorted(tokens, s, "left")
        width = np.searchsorted(tokens, s, "right") - start
        until = np.cumsum(width)
        common = np.zeros(len(index), np.int64)
        for a in range(0, int(until[-1]), _AT_ONCE):
            at = np.arange(a, min(a + _AT_ONCE, int(until[-1])))
            which = np.searchsorted(until, at, "right")
            common += np.bincount(owner[at - until[which] + width[which] + start[which]], minlength=len(index))
        like = ((100 + percent) * common >= percent * (len(s) + sizes)) & (nodes != node)
        asked[j] = like.sum()
        held += like
    return asked, held


def counts_of(batches, percent: int, k: int):
    """Rows (root, low, high, own, node, packed) in the order of root, low, high: the sets of two parts of a component, or of one."""
    unpack = zstandard.ZstdDecompressor()
    now, sides = None, ({}, {})

    def settle():
        a, b = (list(x.items()) for x in sides)
        if now is None or not a or not (b or now[1] == now[2]):
            return to_batch(_COUNTS, [], [])
        asked, held = count_links(a, b or a, percent)
        return to_batch(_COUNTS, [n for n, _ in a + b], np.concatenate([asked, held]) if b else asked)

    for batch in batches:
        for row in batch.to_pylist():
            if (key := (row["root"], row["low"], row["high"])) != now:
                yield settle()
                now, sides = key, ({}, {})
            sides[row["own"] != row["low"]][row["node"]] = shingle_set(unpack.decompress(row["packed"]), k)
    yield settle()


def most_used(uses: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the tokens, those of most uses, in their order, and the uses.

    Uses are counted by levels, `_LEVELS` for each power of two. All tokens over a level are taken, and of those of the level that doesn't
    fit as a whole so many as do, by their hash. Which ones they are changes no result, as any order of tokens gives the same.
    """
    level = F.floor(F.log2("uses") * _LEVELS).cast("int")
    levels = sorted(((r.u, r.n) for r in uses.groupBy(level.alias("u")).agg(F.count("*").alias("n")).collect()), reverse=True)  # _LEVELS * 64 rows at most
    least, total, share = 64 * _LEVELS, 0, 0.0
    for least, n in levels:
        if total + n > most:
            share = 0.9 * (most - total) / n
            break
        total, share = total + n, 1.0
    over = (level > least) | ((level == least) & (F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < F.lit(share * (1 << 30))))
    got = uses.where(over).limit(most).toArrow()
    token = got.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], got.column("uses").to_numpy()[order]


def marked(rows: DataFrame) -> np.ndarray:
    """A fixed number of marks by the low bits of `row`, to leave out most other rows early. Its size doesn't depend on the data."""
    low = rows.select(F.col("row").bitwiseAND(_MARKS - 1).alias("b"))
    words = low.groupBy(F.shiftright("b", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(_MARKS >> 5, np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _parts(df: DataFrame, key: str, block: int, name: str) -> DataFrame:
    """Into how many parts each key's rows (n: a set's size) are cut, for about `block` sets and BLOCK_SHINGLES shingles a part at most."""
    return df.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name))


def _searched(queries: DataFrame, index: DataFrame, texts: DataFrame, percent: int, k: int, block: int) -> DataFrame:
    """Links (u, v) of queries and indexed nodes of one block; both (block, node, n, comp). Each side is cut to parts."""
    n = _parts(queries, "block", block, "nq").join(_parts(index, "block", block, "ni"), "block")
    cut = lambda m: F.pmod(F.xxhash64("node"), F.col(m)).cast("int")
    asked = queries.drop("n").join(n, "block").withColumns({"asks": F.lit(True), "part": F.explode(F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: cut("nq") * F.col("ni") + i))})
    held = index.drop("n").join(n, "block").withColumns({"asks": F.lit(False), "part": F.explode(F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: q * F.col("ni") + cut("ni")))})
    rows = asked.unionByName(held).join(texts, "node").select("block", "part", "asks", "node", "comp", "packed")
    return rows.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(on_executors("jaccard", "links_of", percent, k), "u long, v long")


def _counted(roots: DataFrame, texts: DataFrame, percent: int, k: int, block: int) -> DataFrame:
    """(node, n_links) of all nodes of the components (node, root). Each pair of a component is in one pair of its parts."""
    sized = roots.join(texts.select("node", "n"), "node")
    own = sized.join(_parts(sized, "root", block, "parts"), "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node")
    dealt = rows.join(texts.drop("n"), "node").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return dealt.mapInArrow(on_executors("jaccard", "counts_of", percent, k), "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _placed(docs: DataFrame, percent: int, k: int, hot_tokens: int, hot_least: int, block: int, counted: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, row, n_shingles, node, root, n_links. Rows of one component have one root, those without shingles none; n_links is null unless `counted`."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = stored(with_row(docs).mapInArrow(on_executors("jaccard", "facts_of", hot_least, k, mb=24), "doc_id long, row long, n_shingles long, node long, token long, uses long"), "facts")
    uses = stored(facts.where("token is not null").groupBy("token").agg(F.sum("uses").alias("uses")), "uses")
    hot = spark.sparkContext.broadcast(most_used(uses, hot_tokens))
    postings = docs.mapInArrow(on_executors("jaccard", "postings_of", hot, percent, k), "token long, node long")
    own = facts.where("token is null").select("doc_id", "row", "n_shingles", "node")
    run = lambda name, *args: on_executors("jaccard", name, *args)
    shared = stored(postings.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run("shared_of"), "token long, node long"), "shared")
    sizes = own.where("node is not null").groupBy("node").agg(F.min("n_shingles").alias("n"))
    least = F.floor(F.ceil(F.col("n") * percent / 100) / 20) + 1
    enough = shared.groupBy("node").agg(F.count("*").alias("c")).join(sizes, "node").where(F.col("c") >= least).select("node", "n")
    dealt = shared.join(enough, "node").select("token", "n", "node").repartition("token").sortWithinPartitions("token", "n", "node")
    candidates = stored(dealt.mapInArrow(run("candidates_of", percent), "token long, leader long, leader_n long, node long, n long"), "candidates")

    pairs = stored(candidates.select("leader", "leader_n", "node", "n").distinct(), "pairs")
    wanted = pairs.select("node").unionAll(pairs.select("leader")).distinct()
    # One row's text stands for all of the same set, so copies are neither packed nor dealt.
    bearers = stored(own.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"), F.min("n_shingles").alias("n")), "bearers")
    marks = spark.sparkContext.broadcast(marked(bearers))
    packed = with_row(docs).select("row", "text").mapInArrow(run("texts_of", marks), "row long, packed binary")
    texts = stored(packed.groupBy("row").agg(F.first("packed").alias("packed")).join(bearers, "row").select("node", "n", "packed"), "texts")
    leader = F.col("leader")
    from_leaders = _searched(
        pairs.select(leader.alias("block"), leader.alias("node"), F.col("leader_n").alias("n"), leader.alias("comp")).distinct(),
        pairs.select(leader.alias("block"), "node", "n", F.col("node").alias("comp")),
        texts, percent, k, max(1, block // 4),
    )
    first = stored(from_leaders, "links")
    # Labels that some of a component's nodes have in common are enough here: what they leave out is found to be of one component already.
    roots = stored(connected_components(first, rounds=1), "roots")
    root = lambda name: F.coalesce(F.col(name), F.col(name.replace("root", "node")))

    # Groups of three nodes or more, of two components or more, whose members beside the leader have not been compared.
    several = candidates.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    members = candidates.join(several, "token", "left_semi").join(roots, "node", "left").select("token", "leader", "node", "n", root("root").alias("comp"))
    members = members.join(roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root")), "leader", "left").withColumn("block", F.coalesce("leader_root", "leader"))
    mixed = members.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("token")
    members = stored(members.join(mixed, "token", "left_semi").select("block", "node", "n", "comp").distinct(), "members")
    rest = stored(_searched(members.where("comp != block"), members, texts, percent, k, block), "links")
    roots, old = stored(connected_components(first.unionAll(rest)), "roots"), roots

    if counted:
        each = roots.join(stored(_counted(roots, texts, percent, k, block), "counts"), "node", "left")
    else:
        each = roots.withColumn("n_links", F.lit(None).cast("long"))
    discard(uses, shared, candidates, pairs, bearers, texts, first, old, members, rest)
    hot.destroy()
    marks.destroy()
    return own.join(each, "node", "left").select("doc_id", "row", "n_shingles", "node", F.coalesce("root", "node").alias("root"), "n_links")


def _with_component(placed: DataFrame) -> DataFrame:
    ids = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(ids, "root", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def jaccard_join(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, hot_tokens: int = HOT_TOKENS, hot_least: int = 2, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, n_shingles, component_id.

    Documents link if 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles; component_id is the least
    doc_id reachable. Null, empty and wordless texts have no shingles and are alone, as are rows whose text is unlike all
    others. Rows with the same doc_id are documents of their own that share an id. A null doc_id never is a component's id
    if the component has another. Other columns are not read. An empty table gives an empty result.
    """
    return _with_component(_placed(docs, percent, k, hot_tokens, hot_least, block)).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, hot_tokens: int = HOT_TOKENS, hot_least: int = 2, block: int = BLOCK) -> DataFrame:
    """The rows of jaccard_join with set_id, the identity of the document's set, and n_links, to how many other sets that set links: all of them, exactly.

    set_id is null, and n_links 0, without shingles. Documents with the same set have one set_id, and no links for that.
    """
    placed = _placed(docs, percent, k, hot_tokens, hot_least, block, counted=True)
    return _with_component(placed).select("doc_id", "n_shingles", "component_id", F.col("node").alias("set_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, hot_tokens: int = HOT_TOKENS, hot_least: int = 2, block: int = BLOCK) -> DataFrame:
    """The rows of docs (doc_id, text, any others), with all columns: of each component one, the others go; rows without shingles stay.

    It is one with the least doc_id, and of several such texts the one with the least hash; a null doc_id comes last. Of repeated rows
    (same doc_id and text) any one stands for all.
    """
    each = stored(_placed(docs, percent, k, hot_tokens, hot_least, block).where("root is not null").groupBy("root", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "each")
    first = each.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row")).alias("first"))
    judged = each.join(first, "root").select("row", "n", (F.col("row") == F.col("first.row")).alias("stays"))
    own = unused(docs, "row")
    gone = stored(judged.where("not stays or n > 1").select(F.col("row").alias(own), "stays"), "gone")
    rows = with_row(docs, own)
    once = rows.join(gone.select(own), own, "left_anti").select(docs.columns)
    return once.unionByName(rows.join(gone.where("stays").select(own), own, "left_semi").dropDuplicates([own]).select(docs.columns))


def clusters(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, hot_tokens: int = HOT_TOKENS, hot_least: int = 2, block: int = BLOCK) -> DataFrame:
    """(row, cluster), once for each row identity (`with_row`) in a component of several rows of docs (doc_id, text); those that are alone or have no shingles aren't in it."""
    placed = _placed(docs, percent, k, hot_tokens, hot_least, block).where("root is not null")
    each = stored(placed.groupBy("root", "row").agg(F.count("*").alias("n")), "each")
    several = each.groupBy("root").agg(F.sum("n").alias("rows")).where("rows > 1").select("root")
    return stored(each.join(several, "root").select("row", F.col("root").alias("cluster")), "clusters")
