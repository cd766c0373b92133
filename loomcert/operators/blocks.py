"""The checks of gq4's tampered reductions, by blocks of wedges that are made from edges where they are needed: no wedge is stored or shuffled.

Both roles of the bag are joined on their ends, so they are dealt by them: role1's a -> b -> c and role2's x -> y -> z are of the block of
(u, v) = (a, c) = (z, x). A block gets the edges at its u and the edges at their other ends, as lists. All wedges of a pair of ends are in one
block, so a block's flags are the reduction's, and each check is a sum over blocks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import in_ranges, rows_to_join, stored
from .graph import multiplicity

#: Wedges of both roles in a block, about. Nodes with more are shared out by a hash of the other end.
WEDGES = 1 << 22
_D = "decimal(38,0)"
_BITS = 56
_SUMS = "rows1 rows2 sign1 sign2 violations only join_all join_clean".split()
_SCHEMA = f"kind string, hidden boolean, x bigint, y bigint, z bigint, most bigint, {', '.join(f'{c} {_D}' for c in _SUMS)}"


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def sign(src: np.ndarray, dst: np.ndarray, n: np.ndarray, place: int) -> np.ndarray:
    """An edge's hash as the first (1) or second (2) one of a wedge, times its number. A wedge's is the product of both, modulo 2^56, so their sum
    over all wedges is known from the sums by middle node."""
    h = _mix(_mix(src.astype(np.uint64) + np.uint64(place * 0x9E3779B97F4A7C15 % 2**64)) + dst.astype(np.uint64))
    return (h | np.uint64(1)) * n.astype(np.uint64)


def _signed(batches):
    for b in batches:
        src, dst, n = (b.column(c).to_numpy() for c in ("src", "dst", "n"))
        own = [(sign(src, dst, n, place) & np.uint64(2**_BITS - 1)).astype(np.int64) for place in (1, 2)]
        yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), b.column("n"), *map(pa.array, own)], names=["src", "dst", "n", "f", "g"])


class Role:
    """The wedges of one role in a block, nodes as places among the block's nodes (which keeps their order): ends u and v, middle, number,
    and of each wedge the edges it is of, by which it has a hash."""

    def __init__(self, near: tuple, far: tuple, nodes: np.ndarray, second: bool):
        u, mid, n = near
        key, v, w = far
        order = np.argsort(key, kind="stable")
        key, v, w = key[order], v[order], w[order]
        self.signs = (sign(mid, u, n, 2), sign(v, key, w, 1)) if second else (sign(u, mid, n, 1), sign(key, v, w, 2))
        u, mid, key, v = (np.searchsorted(nodes, c).astype(np.int32) for c in (u, mid, key, v))
        first, last = np.searchsorted(key, mid), np.searchsorted(key, mid, "right")
        each = last - first
        i = np.repeat(np.arange(len(u), dtype=np.int32), each)
        j = (np.arange(len(i)) - np.repeat(np.cumsum(each) - each - first, each)).astype(np.int32)
        self.near, self.far, self.u, self.mid, self.v, self.n = i, j, u[i], mid[i], v[j], n[i] * w[j]
        self.met = self.v < self.mid if second else self.mid < self.v

    def sign(self, where=slice(None)) -> int:
        """The sum of the wedges' hashes, each times its number, modulo 2^64."""
        return int((self.signs[0][self.near[where]] * self.signs[1][self.far[where]]).sum())

    def most(self, key: np.ndarray, nodes: int) -> int:
        """How often the most frequent wedge occurs, by its ends' number and its middle."""
        code = key * nodes + self.mid
        code.sort()
        new = np.flatnonzero(np.concatenate((code[1:] != code[:-1], [True])))
        return int(np.diff(new, prepend=-1).max()) if len(code) else 0


def _keyed(one: Role, two: Role, nodes: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A number for each pair of ends in both roles, and how many numbers there are."""

    def places(name: str) -> tuple[int, np.ndarray]:
        seen = np.zeros(nodes, bool)
        for r in (one, two):
            seen[getattr(r, name)] = True
        return int(seen.sum()), np.cumsum(seen) - 1

    (n_u, u), (n_v, v) = places("u"), places("v")
    key1, key2 = (u[r.u] * n_v + v[r.v] for r in (one, two))
    if n_u * n_v <= WEDGES:
        return n_u * n_v, key1, key2
    keys, key = np.unique(np.concatenate((key1, key2)), return_inverse=True)
    return len(keys), key[: len(key1)], key[len(key1) :]


def _by_key(size: int, key: np.ndarray, n: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The sums of n by key, exact: by doubles while all are under 2^53."""
    key, n = key[where], n[where]
    if n.sum(dtype=np.float64) < 2**52:
        return np.bincount(key, n, size).astype(np.int64)
    out = np.zeros(size, object)
    np.add.at(out, key, n.astype(object))
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    if float(a.max()) * float(b.sum(dtype=np.float64)) < 2**62:
        return int((a.astype(np.int64) * b.astype(np.int64)).sum())
    return sum(int(x) * int(y) for x, y in zip(a, b, strict=True) if x and y)


def _total(n: np.ndarray) -> int:
    return int(n.sum()) if n.sum(dtype=np.float64) < 2**62 else sum(map(int, n))


def _has(size: int, key: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(size, bool)
    out[key[where]] = True
    return out


def measured(one: Role, two: Role, nodes: np.ndarray) -> list[dict]:
    """A block's share in each check of each tampered reduction (certify.tampered), and for `hide` also that with its own least clean row hidden."""
    size, k1, k2 = _keyed(one, two, len(nodes))
    clean1 = one.met & _has(size, k2, two.met)[k1]
    clean2 = two.met & _has(size, k1, clean1)[k2]
    all1, all2 = _by_key(size, k1, one.n, one.met), _by_key(size, k2, two.n, two.met)
    rows = {"most": max(one.most(k1, len(nodes)), two.most(k2, len(nodes))), "rows1": _total(one.n), "rows2": _total(two.n), "sign1": one.sign() % 2**_BITS, "sign2": two.sign() % 2**_BITS}
    join_all = _dot(all1, all2)

    def share(kind: str, c1: np.ndarray, c2: np.ndarray, **more) -> dict:
        has1, has2 = _has(size, k1, c1), _has(size, k2, c2)
        bad = _total(one.n[c1 & ~one.met]) + _total(two.n[c2 & ~two.met])
        join_clean = _dot(_by_key(size, k1, one.n, c1 & one.met), _by_key(size, k2, two.n, c2 & two.met))
        return {"kind": kind, "hidden": False, "x": None, "y": None, "z": None} | rows | {"violations": bad, "only": int((has1 != has2).sum()), "join_all": join_all, "join_clean": join_clean} | more

    out = [share("all", one.met, two.met), share("select", np.ones(len(k1), bool), clean2)]
    right = share("hide", clean1, clean2)
    twice = two.sign(clean2) * 0x9E3779B97F4A7C15
    out.append(right | {"kind": "misplace", "rows2": right["rows2"] + _total(two.n[clean2]), "sign2": (right["sign2"] + twice) % 2**_BITS, "join_clean": None})
    if clean2.any():
        at = np.flatnonzero(clean2)
        for c in (two.v, two.mid, two.u):
            at = at[c[at] == c[at].min()]
        least = dict(zip("xyz", (int(nodes[c[at[0]]]) for c in (two.v, two.mid, two.u)), strict=True))
        rest = clean2.copy()
        rest[at[0]] = False
        out.append(share("hide", clean1, rest, hidden=True, **least))
        right |= least
    return [*out, right]


def _block(table: pa.Table) -> pa.Table:
    def side(t: int) -> tuple:
        rows = table.filter(pc.equal(table["t"], t))
        k, o, n = (rows[c].combine_chunks() for c in ("k", "o", "n"))
        return np.repeat(k.to_numpy(zero_copy_only=False), o.value_lengths().to_numpy(zero_copy_only=False)), o.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False)

    near1, far1, near2, far2 = map(side, (1, 2, 3, 4))
    nodes = np.unique(np.concatenate([c for s in (near1, far1, near2, far2) for c in s[:2]]))
    one, two = Role(near1, far1, nodes, False), Role(near2, far2, nodes, True)
    out = measured(one, two, nodes) if len(one.u) + len(two.u) else []
    kinds = {"kind": pa.string(), "hidden": pa.bool_()} | dict.fromkeys("xyz", pa.int64()) | {"most": pa.int64()} | dict.fromkeys(_SUMS, pa.decimal128(38, 0))
    value = lambda c, x: Decimal(x) if c in _SUMS and x is not None else x
    return pa.table({c: pa.array([value(c, r[c]) for r in out], kind) for c, kind in kinds.items()})


def _placed(weights: DataFrame) -> DataFrame:
    """(u, p, lots): nodes in ranges of about WEDGES wedges each, and into how many lots a range that has more is cut."""
    r = in_ranges(weights, "u")
    sizes = r.groupBy("part").agg(F.sum("w").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    upto = F.sum("w").over(Window.partitionBy("part").orderBy("u")) + F.col("before")
    r = stored(r.join(before, "part").select("u", "w", F.floor((upto - 1) / WEDGES).cast("bigint").alias("p")), "places")
    lots = r.groupBy("p").agg(F.greatest(F.lit(1), F.round(F.sum("w") / WEDGES)).cast("int").alias("lots"))
    return stored(r.join(lots, "p").select("u", "p", "lots"), "places")


def shares(m: DataFrame, middles: DataFrame) -> DataFrame:
    """The shares of all blocks, from the different edges (src, dst, n) and the nodes that are the middle of a wedge (v, k_in, k_out)."""
    middles = rows_to_join(middles)
    near1 = m.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "n").join(middles, "v")
    near2 = m.select(F.col("dst").alias("u"), F.col("src").alias("v"), "n").join(middles, "v")
    sized = near1.select("u", F.col("k_out").alias("w")).unionByName(near2.select("u", F.col("k_in").alias("w")))
    at = _placed(sized.groupBy("u").agg(F.sum("w").cast("bigint").alias("w")))
    blocks = at.select("p", "lots").distinct().agg(F.coalesce(F.sum("lots"), F.lit(1))).first()[0]
    at = rows_to_join(at)

    def listed(df: DataFrame, t: int) -> DataFrame:
        return df.groupBy("p", "q", "k").agg(F.collect_list("o").alias("o"), F.collect_list("n").alias("n")).select("p", "q", F.lit(t).alias("t"), "k", "o", "n")

    out = []
    for t, near, far in ((1, near1, m.select(F.col("src").alias("k"), F.col("dst").alias("o"), "n")), (3, near2, m.where("src < dst").select(F.col("dst").alias("k"), F.col("src").alias("o"), "n"))):
        own = near.select("u", "v", "n").join(at, "u")
        out.append(listed(own.select("p", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("q"), F.col("u").alias("k"), F.col("v").alias("o"), "n"), t))
        wanted = own.select("p", "lots", F.col("v").alias("k")).distinct()
        out.append(listed(far.join(wanted, "k").select("p", F.pmod(F.xxhash64("o"), "lots").cast("int").alias("q"), "k", "o", "n"), t + 1))
    union = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return union.repartition(min(int(blocks), 2000), "p", "q").groupBy("p", "q").applyInArrow(_block, _SCHEMA)


def outcomes(edges: DataFrame) -> DataFrame:
    """One row for each way of tampering: (kind, conservation, selector, cardinality, pairwise), as certify.tamper has them for gq4."""
    m = stored(multiplicity(edges.where("src is not null")).withColumn("n", F.col("n").cast("bigint")), "multiplicity")
    signed = m.mapInArrow(_signed, "src bigint, dst bigint, n bigint, f bigint, g bigint")
    total = lambda c: F.sum(F.col(c).cast(_D)).cast(_D).alias(c)
    into = signed.where("src < dst").groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("k_in"), F.sum("n").cast(_D).alias("n_in"), total("f"))
    from_ = signed.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("k_out"), F.sum("n").cast(_D).alias("n_out"), total("g"))
    middles = stored(into.join(from_, "v"), "middles")
    part = lambda c: (F.col(c) % F.lit(2**_BITS).cast(_D)).cast("decimal(17,0)")
    none = F.lit(0).cast(_D)
    base = middles.agg(
        F.coalesce(F.sum((F.col("n_in") * F.col("n_out")).cast(_D)), none).alias("n_rows"),
        F.coalesce(F.sum(((part("f") * part("g")) % F.lit(2**_BITS).cast(_D)).cast(_D)) % F.lit(2**_BITS).cast(_D), none).alias("base"),
    )
    found = stored(shares(m, middles.select("v", "k_in", "k_out")), "shares")
    # Each block has hidden its own least clean row; only the block that has the least of all counts with it, the others as they were.
    least = found.where("hidden").agg(F.min(F.struct("x", "y", "z")).alias("least"))
    own = F.coalesce(F.struct("x", "y", "z") == F.col("least"), F.lit(False)) & F.col("x").isNotNull()
    rows = found.join(F.broadcast(least)).where((F.col("kind") != "hide") | (F.col("hidden") == own))
    sums = rows.groupBy("kind").agg(F.max("most").alias("most"), *(F.sum(c).cast(_D).alias(c) for c in _SUMS))
    kinds = edges.sparkSession.createDataFrame([("hide",), ("all",), ("misplace",), ("select",)], "kind string")
    sums = kinds.join(sums, "kind", "left").fillna(0, _SUMS).fillna(1, ["most"]).join(F.broadcast(base))
    same = lambda k: (F.col(f"rows{k}") == F.col("n_rows")) & (F.col(f"sign{k}") % F.lit(2**_BITS).cast(_D) == F.col("base"))
    return sums.select("kind", (F.col("most").eqNullSafe(1) & same(1) & same(2)).cast("int").alias("conservation"), (F.col("violations") == 0).cast("int").alias("selector"), (F.col("join_all") == F.col("join_clean")).cast("int").alias("cardinality"), (F.col("only") == 0).cast("int").alias("pairwise"))
