"""Join trees: full reduction by semijoins, and the four checks of a join's evidence.

A node is a relation with a row id, a predicate and, where a row stands for several equal ones, their number; an edge is a list of column pairs of parent and child. All checks are plans of one
row each, and no relation is collected. Reduction goes from the leaves to the root and back and flags rows: one is clean if it extends to a
row of the join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import keys_to_join, stored


@dataclass
class Node:
    name: str
    rows: DataFrame  # with the column rid
    predicate: Column | None = None
    children: list[tuple[Node, list[tuple[str, str]]]] = field(default_factory=list)
    weight: str | None = None  # a bigint column: how many equal rows of the relation a row stands for; else 1

    def number(self) -> Column:
        return F.lit(1).cast("bigint") if self.weight is None else F.col(self.weight)

    def child(self, node: Node, *pairs: tuple[str, str]) -> Node:
        self.children.append((node, list(pairs)))
        return self

    def walk(self):
        yield self
        for c, _ in self.children:
            yield from c.walk()

    def edges(self):
        for c, pairs in self.children:
            yield self, c, pairs
            yield from c.edges()


def row_id() -> Column:
    """A row's place in the files of a table: to be selected where the table is read. It takes no order and no shuffle."""
    return F.concat_ws("#", "_metadata.file_name", "_metadata.row_index").alias("rid")


def keys_of(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(n).alias(f"k{i}") for i, n in enumerate(names))).distinct()


def _met(df: DataFrame, names: list[str], keys: DataFrame) -> DataFrame:
    """df, whose rows are no longer clean where their key is not among the keys."""
    on = fold(lambda a, b: a & b, [F.col(n) == F.col(f"k{i}") for i, n in enumerate(names)])
    return df.join(keys_to_join(keys).withColumn("__met", F.lit(True)), on, "left").withColumn("clean", F.col("clean") & F.coalesce("__met", F.lit(False))).drop("__met", *keys.columns)


def chosen(n: Node) -> DataFrame:
    """All rows of a node, clean where they meet its predicate."""
    return n.rows.withColumn("clean", F.lit(True) if n.predicate is None else F.coalesce(n.predicate, F.lit(False)))


def reduce_tree(root: Node) -> dict[str, DataFrame]:
    """All rows of every node with the flag `clean`.

    One pass up and one down: each edge's clean keys are written once for each direction, distinct, and nothing else is. So a relation is
    read once on the way up, once on the way down if it has children, and once by whoever asks for its rows, with a join for each edge.
    """
    up: dict[str, DataFrame] = {}
    state: dict[str, DataFrame] = {}

    def rise(n: Node) -> None:
        df = chosen(n)
        for c, pairs in n.children:
            rise(c)
            df = _met(df, [p for p, _ in pairs], stored(keys_of(up[c.name].where("clean"), [q for _, q in pairs]), "up"))
        up[n.name] = df

    def fall(n: Node) -> None:
        for c, pairs in n.children:
            keys = stored(keys_of(state[n.name].where("clean"), [p for p, _ in pairs]), "down")
            state[c.name] = _met(up[c.name], [q for _, q in pairs], keys)
            fall(c)

    rise(root)
    state[root.name] = up[root.name]
    fall(root)
    return state


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))


def sizes(root: Node, state: dict[str, DataFrame]) -> DataFrame:
    """(relation, n_rows, n_clean)."""
    return fold(DataFrame.unionByName, [state[n.name].agg(F.lit(n.name).alias("relation"), _sum(n.number()).alias("n_rows"), _sum(F.when(F.col("clean"), n.number())).alias("n_clean")) for n in root.walk()])


def conservation(root: Node, state: dict[str, DataFrame]) -> DataFrame:
    """(relation, n_rows, n_clean, n_residual, ok): clean and residual rows are the relation's rows, each once and with its number."""
    out = []
    for n in root.walk():
        sign = lambda *c: F.coalesce(F.sum(F.xxhash64(*c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        number = [] if n.weight is None else ["k"]
        base = n.rows.select("rid", n.number().alias("k")).agg(_sum(F.col("k")).alias("n_rows"), sign("rid", *number).alias("base"))
        each = state[n.name].select("rid", "clean", n.number().alias("k")).groupBy("rid").agg(F.count("*").alias("m"), F.sum("k").alias("k"), _sum(F.when(F.col("clean"), F.col("k"))).alias("c"))
        found = each.agg(_sum(F.col("k")).alias("n"), _sum(F.col("c")).alias("n_clean"), F.coalesce(F.max("m"), F.lit(1)).alias("most"), sign("rid", *number).alias("own"))
        ok = (F.col("most") == 1) & (F.col("n") == F.col("n_rows")) & (F.col("base") == F.col("own"))
        out.append(base.join(found).select(F.lit(n.name).alias("relation"), "n_rows", "n_clean", (F.col("n_rows") - F.col("n_clean")).alias("n_residual"), ok.alias("ok")))
    return fold(DataFrame.unionByName, out)


def selector(root: Node, state: dict[str, DataFrame]) -> DataFrame:
    """(relation, violations): clean rows that fail their predicate."""
    bad = lambda n: F.lit(False) if n.predicate is None else F.col("clean") & ~F.coalesce(n.predicate, F.lit(False))
    return fold(DataFrame.unionByName, [state[n.name].agg(F.lit(n.name).alias("relation"), _sum(F.when(bad(n), n.number())).alias("violations")) for n in root.walk()])


def pairwise(root: Node, state: dict[str, DataFrame]) -> DataFrame:
    """(edge, only_parent, only_child): keys of an edge that only one side's clean rows have."""
    out = []
    for p, c, pairs in root.edges():
        side = lambda n, names, mark: keys_of(state[n.name].where("clean"), names).withColumn("__s", F.lit(mark))
        both = side(p, [x for x, _ in pairs], 1).unionByName(side(c, [y for _, y in pairs], 2))
        seen = both.groupBy(*(f"k{i}" for i in range(len(pairs)))).agg(F.sum("__s").alias("__s"))
        count = lambda mark: F.count(F.when(F.col("__s") == mark, 1))
        out.append(seen.agg(F.lit(f"{p.name}-{c.name}").alias("edge"), count(1).alias("only_parent"), count(2).alias("only_child")))
    return fold(DataFrame.unionByName, out)


def _mu(n: Node, state: dict[str, DataFrame]) -> DataFrame:
    """A node's rows with the number of join rows below each, of all rows and of clean rows; absent keys count 0. The sums by key are stored, as
    Spark would broadcast them by the size of the files that they come from."""
    number = "decimal(38,0)"
    b = F.lit(True) if n.predicate is None else F.coalesce(n.predicate, F.lit(False))
    df = state[n.name].withColumns({"__all": F.when(b, n.number()).otherwise(0).cast(number), "__cln": F.when(F.col("clean") & b, n.number()).otherwise(0).cast(number)})
    for k, (c, pairs) in enumerate(n.children):
        below = _mu(c, state).groupBy(*(F.col(y).alias(f"__k{k}_{i}") for i, (_, y) in enumerate(pairs))).agg(F.sum("__all").cast(number).alias("__a"), F.sum("__cln").cast(number).alias("__d"))
        on = fold(lambda x, y: x & y, [F.col(x) == F.col(f"__k{k}_{i}") for i, (x, _) in enumerate(pairs)])
        df = df.join(keys_to_join(stored(below, "below")), on, "left")
        df = df.withColumns({"__all": (F.col("__all") * F.coalesce("__a", F.lit(0))).cast(number), "__cln": (F.col("__cln") * F.coalesce("__d", F.lit(0))).cast(number)}).drop("__a", "__d", *(f"__k{k}_{i}" for i in range(len(pairs))))
    return df


def cardinality(root: Node, state: dict[str, DataFrame]) -> DataFrame:
    """(join_all, join_clean): the join's number of rows by propagated multiplicities, over all and over clean rows; equal for a right reduction."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return _mu(root, state).agg(total("__all").alias("join_all"), total("__cln").alias("join_clean"))


def verdict(root: Node, state: dict[str, DataFrame]) -> DataFrame:
    """One row with the outcome of each check."""
    a = conservation(root, state).agg(F.min(F.col("ok").cast("int")).alias("conservation"))
    b = selector(root, state).agg((F.sum("violations") == 0).cast("int").alias("selector"))
    c = pairwise(root, state).agg((F.sum(F.col("only_parent") + F.col("only_child")) == 0).cast("int").alias("pairwise"))
    d = cardinality(root, state).select((F.col("join_all") == F.col("join_clean")).cast("int").alias("cardinality"))
    return a.join(b).join(c).join(d)
