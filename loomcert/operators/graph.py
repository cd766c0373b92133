"""Counts of ordered patterns in a bag of directed edges, by passing counts along edges: no path is ever made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.store import stored
from ..sources.tables import event_edges

_N = "decimal(38,0)"
LOT = 4096
EDGES = """edges AS (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS eid, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL),
m AS (SELECT src, dst, CAST(count(*) AS HUGEINT) AS n FROM edges GROUP BY ALL)"""


def multiplicity(edges: DataFrame) -> DataFrame:
    """Each distinct edge with its number: joins below are by distinct edges, so repeated ones don't multiply rows."""
    return edges.groupBy("src", "dst").agg(F.count("*").cast(_N).alias("n"))


def _step(m: DataFrame, after: DataFrame) -> DataFrame:
    """Edges x -> y with x < y, weighted by what leaves y (after: src, n), summed by (x, y) and then filtered by the caller."""
    return m.where("src < dst").join(after.select(F.col("src").alias("dst"), F.col("n").alias("w")), "dst")


def _out(m: DataFrame) -> DataFrame:
    return m.groupBy("src").agg(F.sum("n").cast(_N).alias("n"))


def _total(df: DataFrame, value, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name))


def counted(edges: DataFrame) -> DataFrame:
    """multiplicity, written once for all the roles that it plays in a plan."""
    return stored(multiplicity(edges), "multiplicity")


def paths(edges: DataFrame, hops: int, name: str) -> DataFrame:
    """The number of paths whose nodes ascend but for the last hop, which is free.

    Counts go from the last node to the first by node: how many paths of k hops start at each node. A node's count only depends on
    what comes after it, so each hop is one join and one sum, over at most all distinct edges.
    """
    m = counted(edges)
    after = _out(m)
    for _ in range(hops - 2):
        after = _step(m, after).groupBy("src").agg(F.sum((F.col("n") * F.col("w")).cast(_N)).cast(_N).alias("n"))
    return _total(_step(m, after), (F.col("n") * F.col("w")).cast(_N), name)


def meet(left: DataFrame, right: DataFrame, key: str, by: str, lot: int = LOT) -> DataFrame:
    """left and right joined on key, where a key with more than `lot` rows of left is dealt to lots of about that size by a hash of `by`, and
    its rows of right go to each: so what a hub makes is shared out among tasks."""
    heavy = left.groupBy(key).agg(F.count("*").alias("__k")).where(F.col("__k") > lot).select(key, F.ceil(F.col("__k") / lot).cast("int").alias("__lots"))
    lots = F.coalesce("__lots", F.lit(1))
    a = left.join(heavy, key, "left").withColumn("__lot", F.pmod(F.xxhash64(by), lots).cast("int")).drop("__lots")
    b = right.join(heavy, key, "left").withColumn("__lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("__lots")
    return a.join(b, [key, "__lot"]).drop("__lot")


def wedges(m: DataFrame) -> DataFrame:
    """a -> b -> c with a < b, by distinct edges (src, dst, n) with their number."""
    first = m.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("n1"))
    second = m.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("n").alias("n2"))
    return meet(first, second, "b", "a").select("a", "b", "c", (F.col("n1") * F.col("n2")).cast(_N).alias("n"))


def triangles(edges: DataFrame) -> DataFrame:
    m = counted(edges)
    back = m.select(F.col("src").alias("c"), F.col("dst").alias("a"), F.col("n").alias("w"))
    return _total(wedges(m).where("b < c").join(back, ["a", "c"]), (F.col("n") * F.col("w")).cast(_N), "triangles")


def four_cycles(edges: DataFrame) -> DataFrame:
    """a -> b -> c -> d -> a with a < b < c < d: both halves are summed by their ends first, so a pair of ends is one row.

    The second half c -> d -> a is the bag of wedges again, in its other role: its middle is greater than its first node, and its last is less.
    """
    w = wedges(counted(edges))
    first = w.where("b < c").groupBy("a", "c").agg(F.sum("n").cast(_N).alias("n1"))
    second = w.where("c < a").groupBy(F.col("a").alias("c"), F.col("c").alias("a")).agg(F.sum("n").cast(_N).alias("n2"))
    return _total(first.join(second, ["a", "c"]), (F.col("n1") * F.col("n2")).cast(_N), "cycles")


def _edges(t) -> DataFrame:
    return event_edges(t("events"))


@query("gq1", f"WITH {EDGES}, o AS (SELECT src, sum(n) n FROM m GROUP BY 1), s AS (SELECT m.src, sum(m.n * o.n) n FROM m JOIN o ON m.dst = o.src WHERE m.src < m.dst GROUP BY 1) SELECT CAST(COALESCE(sum(m.n * s.n), 0) AS BIGINT) AS paths FROM m JOIN s ON m.dst = s.src WHERE m.src < m.dst")
def gq1(t) -> DataFrame:
    """Paths of three hops."""
    return paths(_edges(t), 3, "paths")


@query("gq2", f"WITH {EDGES}, o AS (SELECT src, sum(n) n FROM m GROUP BY 1), s AS (SELECT m.src, sum(m.n * o.n) n FROM m JOIN o ON m.dst = o.src WHERE m.src < m.dst GROUP BY 1), r AS (SELECT m.src, sum(m.n * s.n) n FROM m JOIN s ON m.dst = s.src WHERE m.src < m.dst GROUP BY 1) SELECT CAST(COALESCE(sum(m.n * r.n), 0) AS BIGINT) AS paths FROM m JOIN r ON m.dst = r.src WHERE m.src < m.dst")
def gq2(t) -> DataFrame:
    """Paths of four hops."""
    return paths(_edges(t), 4, "paths")


@query("gq3", f"WITH {EDGES} SELECT CAST(COALESCE(sum(x.n * y.n * z.n), 0) AS BIGINT) AS triangles FROM m x JOIN m y ON x.dst = y.src JOIN m z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND y.src < y.dst")
def gq3(t) -> DataFrame:
    """Triangles."""
    return triangles(_edges(t))


@query("gq4", f"WITH {EDGES}, w AS (SELECT x.src a, x.dst b, y.dst c, x.n * y.n n FROM m x JOIN m y ON x.dst = y.src WHERE x.src < x.dst) SELECT CAST(COALESCE(sum(p.n * q.n), 0) AS BIGINT) AS cycles FROM (SELECT a, c, sum(n) n FROM w WHERE b < c GROUP BY ALL) p JOIN (SELECT a, c, sum(n) n FROM w GROUP BY ALL) q ON p.a = q.c AND p.c = q.a")
def gq4(t) -> DataFrame:
    """Cycles of four."""
    return four_cycles(_edges(t))


def degrees(edges: DataFrame) -> DataFrame:
    """(v, in_lt, out): edges into v from lesser nodes, and edges out of v."""
    into = edges.where("src < dst").groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("in_lt"))
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out"))
    return into.join(out, "v", "full").select("v", F.coalesce("in_lt", F.lit(0)).alias("in_lt"), F.coalesce("out", F.lit(0)).alias("out"))


def wedge_size(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.coalesce(F.sum((F.col("in_lt").cast(_N) * F.col("out")).cast(_N)), F.lit(0)).cast("bigint").alias("wedge_size"), F.max("in_lt").alias("max_in_lt"), F.max("out").alias("max_out"))
