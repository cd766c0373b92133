"""The join trees of the queries, and their reduction and checks."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import jointree as J
from ..plans.registry import ORACLES, query
from ..sources.store import stored
from ..sources.tables import event_edges
from .graph import counted, wedges
from .tpch import COLOUR, END5, REGION5, REGION8, SEGMENT, SHIP_DATE, START5, TYPE8, moment, partsupp, q3, q18


def tree_q3(t) -> J.Node:
    """orders with customer and lineitem below it."""
    c = J.Node("customer", t("customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").cast("string").alias("rid")), F.col("c_mktsegment") == SEGMENT)
    line = J.Node("lineitem", t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate", J.row_id()), F.col("l_shipdate") > moment(SHIP_DATE))
    o = J.Node("orders", t("orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("rid")), F.col("o_orderdate") < moment(SHIP_DATE))
    return o.child(c, ("o_custkey", "c_custkey")).child(line, ("o_orderkey", "l_orderkey"))


def tree_q5(t) -> J.Node:
    """The cyclic join as a tree of bags: lineitem with supplier, below it orders with customer and nation with region."""
    n = t("nation").join(t("region").where(F.col("r_name") == REGION5), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    nr = J.Node("nr", n.select("n_nationkey", F.col("n_nationkey").cast("string").alias("rid")))
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey", F.col("o_orderkey").cast("string").alias("rid"))
    co = J.Node("co", o, (F.col("o_orderdate") >= moment(START5)) & (F.col("o_orderdate") < moment(END5)))
    ls = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", J.row_id()).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return J.Node("ls", ls).child(co, ("l_orderkey", "o_orderkey"), ("s_nationkey", "c_nationkey")).child(nr, ("s_nationkey", "n_nationkey"))


def tree_q8(t) -> J.Node:
    rid = lambda c: F.col(c).cast("string").alias("rid")
    r = J.Node("region", t("region").select("r_regionkey", "r_name", rid("r_regionkey")), F.col("r_name") == REGION8)
    n1 = J.Node("nation1", t("nation").select(F.col("n_nationkey").alias("n1_key"), "n_regionkey", rid("n_nationkey"))).child(r, ("n_regionkey", "r_regionkey"))
    n2 = J.Node("nation2", t("nation").select(F.col("n_nationkey").alias("n2_key"), "n_name", rid("n_nationkey")))
    c = J.Node("customer", t("customer").select("c_custkey", "c_nationkey", rid("c_custkey"))).child(n1, ("c_nationkey", "n1_key"))
    o = J.Node("orders", t("orders").select("o_orderkey", "o_custkey", "o_orderdate", rid("o_orderkey")), F.year("o_orderdate").isin(1995, 1996)).child(c, ("o_custkey", "c_custkey"))
    p = J.Node("part", t("part").select("p_partkey", "p_type", rid("p_partkey")), F.col("p_type") == TYPE8)
    s = J.Node("supplier", t("supplier").select("s_suppkey", "s_nationkey", rid("s_suppkey"))).child(n2, ("s_nationkey", "n2_key"))
    line = J.Node("lineitem", t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", J.row_id()))
    return line.child(p, ("l_partkey", "p_partkey")).child(o, ("l_orderkey", "o_orderkey")).child(s, ("l_suppkey", "s_suppkey"))


def tree_q9(t) -> J.Node:
    rid = lambda c: F.col(c).cast("string").alias("rid")
    n = J.Node("nation", t("nation").select("n_nationkey", "n_name", rid("n_nationkey")))
    p = J.Node("part", t("part").select("p_partkey", "p_name", rid("p_partkey")), F.col("p_name").contains(COLOUR))
    s = J.Node("supplier", t("supplier").select("s_suppkey", "s_nationkey", rid("s_suppkey"))).child(n, ("s_nationkey", "n_nationkey"))
    o = J.Node("orders", t("orders").select("o_orderkey", "o_orderdate", rid("o_orderkey")))
    ps = J.Node("partsupp", partsupp(t).withColumn("rid", F.concat_ws("-", "ps_partkey", "ps_suppkey")))
    line = J.Node("lineitem", t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", J.row_id()))
    return line.child(p, ("l_partkey", "p_partkey")).child(o, ("l_orderkey", "o_orderkey")).child(ps, ("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")).child(s, ("l_suppkey", "s_suppkey"))


def tree_q18(t) -> J.Node:
    c = J.Node("customer", t("customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("rid")))
    o = J.Node("orders", t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", F.col("o_orderkey").cast("string").alias("rid"))).child(c, ("o_custkey", "c_custkey"))
    return J.Node("lineitem", t("lineitem").select("l_orderkey", "l_quantity", J.row_id())).child(o, ("l_orderkey", "o_orderkey"))


def _edge_node(e: DataFrame, k: int, ordered: bool) -> J.Node:
    return J.Node(f"r{k}", e.select(F.col("src").alias(f"s{k}"), F.col("dst").alias(f"d{k}"), F.col("eid").cast("string").alias("rid")), F.col(f"s{k}") < F.col(f"d{k}") if ordered else None)


def tree_path(t, hops: int) -> J.Node:
    """r1 -> r2 -> ...: the edges in as many roles; all but the last hop ascend."""
    e = stored(event_edges(t("events")), "edges")
    node = _edge_node(e, hops, False)
    for k in range(hops - 1, 0, -1):
        node = _edge_node(e, k, True).child(node, (f"d{k}", f"s{k + 1}"))
    return node


def _wedge_rows(e: DataFrame) -> DataFrame:
    """The bag of wedges a -> b -> c with a < b, written once: a row for each different wedge, with its number n. So edges that occur again
    make no rows, here and in whatever a check shuffles."""
    return stored(wedges(counted(e)).select("a", "b", "c", F.col("n").cast("bigint").alias("n"), F.concat_ws("-", "a", "b", "c").alias("rid")), "wedges")


def tree_gq3(t) -> J.Node:
    """The bag of wedges, and below it the closing edges c -> a."""
    e = stored(event_edges(t("events")), "edges")
    close = J.Node("close", e.select(F.col("src").alias("x"), F.col("dst").alias("z"), F.col("eid").cast("string").alias("rid")))
    return J.Node("wedge", _wedge_rows(e), F.col("b") < F.col("c"), weight="n").child(close, ("c", "x"), ("a", "z"))


def tree_gq4(t) -> J.Node:
    """The bag of wedges in both of its roles, joined on its ends in reverse."""
    w = _wedge_rows(event_edges(t("events")))
    second = J.Node("role2", w.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"), "n", "rid"), F.col("x") < F.col("y"), weight="n")
    return J.Node("role1", w, F.col("b") < F.col("c"), weight="n").child(second, ("c", "x"), ("a", "z"))


TREES = {"q3": tree_q3, "q5": tree_q5, "q8": tree_q8, "q9": tree_q9, "q18": tree_q18, "gq1": lambda t: tree_path(t, 3), "gq2": lambda t: tree_path(t, 4), "gq3": tree_gq3, "gq4": tree_gq4}

_S, _B, _E = f"TIMESTAMP '{SHIP_DATE}'", f"TIMESTAMP '{START5}'", f"TIMESTAMP '{END5}'"
_Q3 = f"c_mktsegment = '{SEGMENT}' AND o_orderdate < {_S} AND l_shipdate > {_S}"
#: For the oracles: the join with its predicates, each relation's rows and what identifies a row.
JOINS = {
    "q3": (f"customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE {_Q3}", {"orders": ("orders", "o_orderkey"), "customer": ("customer", "c_custkey"), "lineitem": ("lineitem", "lid")}, ["orders-customer", "orders-lineitem"]),
    "q5": (
        f"lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{REGION5}' AND o_orderdate >= {_B} AND o_orderdate < {_E}",
        {"ls": ("lineitem", "lid"), "co": ("orders", "o_orderkey"), "nr": (f"nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{REGION5}'", "n_nationkey")}, ["ls-co", "ls-nr"],
    ),
    "q8": (
        f"lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey WHERE r_name = '{REGION8}' AND p_type = '{TYPE8}' AND year(o_orderdate) IN (1995, 1996)",
        {"lineitem": ("lineitem", "lid"), "part": ("part", "p_partkey"), "orders": ("orders", "o_orderkey"), "customer": ("customer", "c_custkey"), "nation1": ("nation", "n1.n_nationkey"), "region": ("region", "r_regionkey"), "supplier": ("supplier", "s_suppkey"), "nation2": ("nation", "n2.n_nationkey")},
        ["lineitem-part", "lineitem-orders", "orders-customer", "customer-nation1", "nation1-region", "lineitem-supplier", "supplier-nation2"],
    ),
    "q9": (
        f"lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey WHERE p_name LIKE '%{COLOUR}%'",
        {"lineitem": ("lineitem", "lid"), "part": ("part", "p_partkey"), "orders": ("orders", "o_orderkey"), "partsupp": ("(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)", "l_partkey || '-' || l_suppkey"), "supplier": ("supplier", "s_suppkey"), "nation": ("nation", "n_nationkey")},
        ["lineitem-part", "lineitem-orders", "lineitem-partsupp", "lineitem-supplier", "supplier-nation"],
    ),
    "q18": ("lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", {"lineitem": ("lineitem", "lid"), "orders": ("orders", "o_orderkey"), "customer": ("customer", "c_custkey")}, ["lineitem-orders", "orders-customer"]),
    "gq1": ("edges r1 JOIN edges r2 ON r1.dst = r2.src JOIN edges r3 ON r2.dst = r3.src WHERE r1.src < r1.dst AND r2.src < r2.dst", {f"r{k}": ("edges", f"r{k}.eid") for k in (1, 2, 3)}, ["r1-r2", "r2-r3"]),
    "gq3": ("edges e1 JOIN edges e2 ON e1.dst = e2.src JOIN edges e3 ON e2.dst = e3.src AND e3.dst = e1.src WHERE e1.src < e1.dst AND e2.src < e2.dst", {"wedge": ("edges e1 JOIN edges e2 ON e1.dst = e2.src WHERE e1.src < e1.dst", "e1.eid || '-' || e2.eid"), "close": ("edges", "e3.eid")}, ["wedge-close"]),
}
_WITH = """WITH lineitem AS (SELECT *, row_number() OVER () AS lid FROM main.lineitem), edges AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS eid, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)
"""
_UP = "SELECT * FROM edges WHERE src < dst AND dst IN (SELECT src FROM {})"
_DOWN = "SELECT * FROM {} WHERE src IN (SELECT dst FROM {})"
_WEDGES = "SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src < x.dst"
#: Where the join itself would be too large for an oracle: each relation's rows and its clean ones, by nested IN.
REDUCED = {
    "gq2": (
        f"u3 AS ({_UP.format('edges')}), u2 AS ({_UP.format('u3')}), u1 AS ({_UP.format('u2')}), d2 AS ({_DOWN.format('u2', 'u1')}), d3 AS ({_DOWN.format('u3', 'd2')}), d4 AS ({_DOWN.format('edges', 'd3')})",
        {"r1": ("edges", "u1"), "r2": ("edges", "d2"), "r3": ("edges", "d3"), "r4": ("edges", "d4")}, ["r1-r2", "r2-r3", "r3-r4"],
    ),
    "gq4": (
        f"w AS ({_WEDGES}), c1 AS (SELECT * FROM w WHERE b < c AND (c, a) IN (SELECT a, c FROM w)), c2 AS (SELECT * FROM w WHERE (a, c) IN (SELECT c, a FROM w WHERE b < c))",
        {"role1": ("w", "c1"), "role2": ("w", "c2")}, ["role1-role2"],
    ),
}


def _counts_sql(q: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The common tables, and for each relation its name and SQL for its number of rows and of clean rows."""
    if q in REDUCED:
        more, relations, _ = REDUCED[q]
        return f"{_WITH}, {more} ", [(name, f"(SELECT count(*) FROM {rel})", f"(SELECT count(*) FROM {clean})") for name, (rel, clean) in relations.items()]
    join, relations, _ = JOINS[q]
    return _WITH, [(name, f"(SELECT count(*) FROM {rel})", f"(SELECT count(DISTINCT {key}) FROM {join})") for name, (rel, key) in relations.items()]


def _sizes_sql(q: str, residual: bool) -> str:
    head, relations = _counts_sql(q)
    part = ", {0} - {1} AS n_residual, true AS ok" if residual else ""
    return head + " UNION ALL ".join(f"SELECT '{name}' AS relation, {n} AS n_rows, {c} AS n_clean{part.format(n, c)}" for name, n, c in relations)


def tampered(kind: str, root: J.Node, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A right reduction made wrong: hide (a clean row of the last relation counts as residual), all (all rows that meet their predicate count as clean),
    select (all rows of the first relation with a predicate count as clean), misplace (the clean rows of the last relation are there twice)."""
    state, nodes = dict(state), list(root.walk())
    last = nodes[-1]
    if kind == "hide":
        one = state[last.name].where("clean").agg(F.min("rid").alias("rid")).withColumn("__hit", F.lit(True))
        state[last.name] = state[last.name].join(one, "rid", "left").withColumn("clean", F.col("clean") & F.col("__hit").isNull()).drop("__hit")
    elif kind == "all":
        state = {n.name: J.chosen(n) for n in nodes}
    elif kind == "select":
        n = next(n for n in nodes if n.predicate is not None)
        state[n.name] = state[n.name].withColumn("clean", F.lit(True))
    elif kind == "misplace":
        state[last.name] = state[last.name].unionByName(state[last.name].where("clean").withColumn("rid", F.concat("rid", F.lit("'"))))
    else:
        raise ValueError(kind)
    return state


#: Of each relation that has one, its predicate; the first is the one that `select` disregards.
PREDICATES = {
    "q3": {"orders": f"o_orderdate < {_S}", "customer": f"c_mktsegment = '{SEGMENT}'", "lineitem": f"l_shipdate > {_S}"},
    "q5": {"co": f"o_orderdate >= {_B} AND o_orderdate < {_E}"},
    "q8": {"part": f"p_type = '{TYPE8}'", "orders": "year(o_orderdate) IN (1995, 1996)", "region": f"r_name = '{REGION8}'"},
    "q9": {"part": f"p_name LIKE '%{COLOUR}%'"},
    "q18": {},
    "gq1": {"r1": "src < dst", "r2": "src < dst"},
    "gq2": {"r1": "src < dst", "r2": "src < dst", "r3": "src < dst"},
    "gq3": {"wedge": "e2.src < e2.dst"},
    "gq4": {"role1": "b < c", "role2": "a < b"},
}


def _tamper_sql(q: str) -> str:
    """What each check must say, from the numbers of rows, of those that meet their predicate and of clean ones."""
    head, relations = _counts_sql(q)
    first = next(iter(PREDICATES[q]), None)
    of = {name: (REDUCED[q][1][name][0] if q in REDUCED else JOINS[q][1][name][0]) for name, _, _ in relations}
    met = {name: n if name not in PREDICATES[q] else f"(SELECT count(*) FROM {of[name]} {'AND' if 'WHERE' in of[name] else 'WHERE'} {PREDICATES[q][name]})" for name, n, _ in relations}
    some = f"{relations[-1][2]} > 0"
    dangling = " + ".join(f"({met[name]} - {c})" for name, _, c in relations)
    rows = [("hide", "conservation", "1"), ("hide", "selector", "1"), ("hide", "cardinality", f"CASE WHEN {some} THEN 0 ELSE 1 END"), ("all", "conservation", "1"), ("all", "selector", "1"), ("all", "cardinality", "1"),
            ("all", "pairwise", f"CASE WHEN {dangling} > 0 THEN 0 ELSE 1 END"), ("misplace", "conservation", f"CASE WHEN {some} THEN 0 ELSE 1 END"), ("misplace", "selector", "1"), ("misplace", "pairwise", "1")]
    if first:
        n = next(n for name, n, _ in relations if name == first)
        rows += [("select", "conservation", "1"), ("select", "selector", f"CASE WHEN {n} > {met[first]} THEN 0 ELSE 1 END"), ("select", "cardinality", "1")]
    return head + " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{check}' AS \"check\", {holds} AS holds" for kind, check, holds in rows)


#: The checks whose outcome follows from the way of tampering alone.
TOLD = {"hide": ("conservation", "selector", "cardinality"), "all": ("conservation", "selector", "cardinality", "pairwise"), "misplace": ("conservation", "selector", "pairwise"), "select": ("conservation", "selector", "cardinality")}


def tamper(q: str, root: J.Node) -> DataFrame:
    """(kind, check, holds): for each way of tampering whether each check still holds, 1 or 0."""
    right, rows = J.reduce_tree(root), []
    for kind in TOLD if PREDICATES[q] else [k for k in TOLD if k != "select"]:
        state = tampered(kind, root, right)
        one = {
            "conservation": lambda s: J.conservation(root, s).agg(F.min(F.col("ok").cast("int")).alias("holds")),
            "selector": lambda s: J.selector(root, s).agg((F.sum("violations") == 0).cast("int").alias("holds")),
            "pairwise": lambda s: J.pairwise(root, s).agg((F.sum(F.col("only_parent") + F.col("only_child")) == 0).cast("int").alias("holds")),
            "cardinality": lambda s: J.cardinality(root, s).select((F.col("join_all") == F.col("join_clean")).cast("int").alias("holds")),
        }
        rows += [one[check](state).select(F.lit(kind).alias("kind"), F.lit(check).alias("check"), "holds") for check in TOLD[kind]]
    return fold(DataFrame.unionByName, rows)


def tamper_gq4(t) -> DataFrame:
    """tamper for gq4, whose wedges may be as many as its edges squared: by blocks that make them from edges, so none is stored or shuffled."""
    from .blocks import outcomes

    found = outcomes(event_edges(t("events")))
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("of"), F.lit(check).alias("check"), F.col(check).alias("holds")) for kind in TOLD for check in TOLD[kind])))
    return found.select("kind", rows.alias("r")).where("kind = r.of").select("kind", "r.check", "r.holds")


def _register(q: str, tree) -> None:
    from . import graph  # noqa: F401

    clean = lambda t: (r := tree(t), J.reduce_tree(r))
    query(f"reduce_{q}", _sizes_sql(q, False))(lambda t: J.sizes(*clean(t)))
    query(f"conserve_{q}", _sizes_sql(q, True))(lambda t: J.conservation(*clean(t)))
    relations, edges = (REDUCED if q in REDUCED else JOINS)[q][1:]
    query(f"selector_{q}", " UNION ALL ".join(f"SELECT '{n}' AS relation, CAST(0 AS BIGINT) AS violations" for n in relations))(lambda t: J.selector(*clean(t)))
    query(f"pairwise_{q}", " UNION ALL ".join(f"SELECT '{e}' AS edge, CAST(0 AS BIGINT) AS only_parent, CAST(0 AS BIGINT) AS only_child" for e in edges))(lambda t: J.pairwise(*clean(t)))
    if q in JOINS:
        sql = _WITH + f"SELECT count(*) AS join_all, count(*) AS join_clean FROM {JOINS[q][0]}"
    else:
        sql = f"SELECT {(c := {'gq2': 'paths', 'gq4': 'cycles'}[q])} AS join_all, {c} AS join_clean FROM ({ORACLES[q]})"
    query(f"cardinality_{q}", sql)(lambda t: J.cardinality(*clean(t)))
    query(f"tamper_{q}", _tamper_sql(q))(tamper_gq4 if q == "gq4" else lambda t: tamper(q, tree(t)))


for _q, _tree in TREES.items():
    _register(_q, _tree)


def reduced_tables(t, q: str):
    """t with the relations of q's tree cut to their clean rows."""
    state = J.reduce_tree(TREES[q](t))
    return lambda name: state[name].where("clean") if name in state else t(name)


@query("superset_guard", " UNION ALL ".join(f"SELECT '{q}' AS query, (SELECT count(*) FROM ({ORACLES[q]})) AS n, CAST(0 AS BIGINT) AS differing" for q in ("q3", "q18")))
def superset_guard(t) -> DataFrame:
    """A certified plan answers what the plain one does: each query over all rows, and over the clean rows of its tree, gives the same bag of rows.

    Queries that need columns which their tree doesn't carry fail here instead of giving something else.
    """
    from .basics import bag_difference

    out = []
    for q, run in (("q3", q3), ("q18", q18)):
        base = run(t)
        out.append(base.agg(F.lit(q).alias("query"), F.count("*").alias("n")).join(bag_difference(base, run(reduced_tables(t, q)).select(base.columns))))
    return fold(DataFrame.unionByName, out)


@query("sigma_default", "SELECT c_custkey, COALESCE(n, 0) AS sigma FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def sigma_default(t) -> DataFrame:
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("sigma"))
