"""Scans, predicates, joins, aggregates, windows, order, sets and encodings, each as a query of its own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode as E
from ..plans.registry import ORACLES, query
from ..sources.store import in_ranges, new_place, placed, stored
from ..sources.tables import GRAPHS, cap_rows, edges_from_text, event_edges, load_graph, require_nonempty, text_table, write_edges, write_text_table
from .graph import EDGES, counted, multiplicity, wedge_size, wedges
from .tpch import _REV, END5, START5, moment, revenue

_F = "CAST(trunc(1000.0::DOUBLE*{}) AS BIGINT)"
_COLUMNS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
#: Tables with a key and a text column, by which their delimited form is compared.
_DELIMITED = {"nation": ("n_regionkey", "n_name"), "region": ("r_regionkey", "r_name"), "part": ("p_size", "p_type"), "customer": ("c_custkey", "c_mktsegment"), "supplier": ("s_nationkey", "s_name"), "orders": ("o_custkey", "o_orderpriority"), "lineitem": ("l_partkey", "l_returnflag")}
for _name, _cols in _COLUMNS.items():
    query(f"scan_{_name}", f"SELECT {', '.join(_cols)} FROM {_name}")(lambda t, n=_name, c=_cols: t(n).select(*c))


@query("scan_partsupp", "SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(trunc(1000.0::DOUBLE*p_retailprice) AS BIGINT) // 20 + (l_suppkey % 10) * 1000 AS ps_cost FROM lineitem JOIN part ON l_partkey = p_partkey")
def scan_partsupp(t) -> DataFrame:
    from .tpch import partsupp

    return partsupp(t)


@query("scan_edges", f"WITH {EDGES} SELECT eid, src, dst FROM edges")
def scan_edges(t) -> DataFrame:
    return event_edges(t("events")).select("eid", "src", "dst")


for _form in ("ws", "csv", "tolerant"):

    @query(f"scan_edges_{_form}", f"WITH {EDGES} SELECT src, dst FROM edges")
    def scan_edges_text(t, form: str = _form) -> DataFrame:
        """Edges of a text file, which is written first: by white space, by comma under a header, or by either among comments."""
        edges = event_edges(t("events"))
        path = new_place(edges.sparkSession, f"edges-{form}")
        write_edges(edges, path, form)
        return edges_from_text(edges.sparkSession, path, form)


@query("scan_text_tables", " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n, CAST(sum({k}) AS BIGINT) AS keys, CAST(sum(length({s})) AS BIGINT) AS letters FROM {n}" for n, (k, s) in _DELIMITED.items()))
def scan_text_tables(t) -> DataFrame:
    """Every table in its delimited form, written and read with its fixed schema: rows, the sum of a key, the length of a text."""
    from functools import reduce

    out = []
    for name, (key, text) in _DELIMITED.items():
        df = t(name)
        path = new_place(df.sparkSession, name)
        write_text_table(df, path, name)
        back = text_table(df.sparkSession, path, name)
        out.append(back.agg(F.lit(name).alias("relation"), F.count("*").alias("n"), F.sum(key).alias("keys"), F.sum(F.char_length(text)).alias("letters")))
    return reduce(DataFrame.unionByName, out)


@query("cap_edges", f"WITH {EDGES} SELECT eid, src, dst FROM edges WHERE eid < 500")
def cap_edges(t) -> DataFrame:
    return cap_rows(event_edges(t("events")), 500, "eid").select("eid", "src", "dst")


@query("load_graph", f"WITH {EDGES} SELECT graph, count(*) AS edges, CAST((SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS BIGINT) AS nodes FROM edges, (VALUES ('facebook'), ('lastfm'), ('wiki')) AS g(graph) GROUP BY 1")
def load_graphs(t) -> DataFrame:
    """The registered graphs by name, from files of their form that hold the event edges."""
    from functools import reduce

    edges = stored(event_edges(t("events")), "edges")
    folder, out = new_place(edges.sparkSession, "graphs"), []
    for name, (file, form) in sorted(GRAPHS.items()):
        write_edges(edges, f"{folder}/{file}", form)
        e = load_graph(edges.sparkSession, folder, name)
        nodes = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().agg(F.count("*").alias("nodes"))
        out.append(e.agg(F.lit(name).alias("graph"), F.count("*").alias("edges")).join(nodes))
    return reduce(DataFrame.unionByName, out)


@query("row_count", " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n FROM {n}" for n in _COLUMNS))
def row_count(t) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [t(n).agg(F.lit(n).alias("relation"), F.count("*").alias("n")) for n in _COLUMNS])


@query("require_nonempty", "SELECT r_regionkey, r_name FROM region")
def nonempty(t) -> DataFrame:
    return require_nonempty(t("region"), "region").select("r_regionkey", "r_name")


@query("parse_field", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN 2 * CAST(round(s_acctbal * 100) AS BIGINT) ELSE -2 * CAST(round(s_acctbal * 100) AS BIGINT) - 1 END AS cell FROM supplier")
def parse_field(t) -> DataFrame:
    """Cells of a text table as numbers."""
    return t("supplier").select("s_suppkey", E.cell_cents(F.format_string("%.2f", "s_acctbal")).alias("cell"))


@query("project_columns", f"SELECT l_orderkey, {_F.format('l_extendedprice')} AS ext, {_F.format('l_discount')} AS disc, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) AS ship FROM lineitem")
def project_columns(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", E.fixed(F.col("l_extendedprice")).alias("ext"), E.fixed(F.col("l_discount")).alias("disc"), E.epoch_seconds(F.col("l_shipdate").cast("string").substr(1, 10)).alias("ship"))


@query("filter_eq", "SELECT c_custkey, c_mktsegment = 'HOUSEHOLD' AS b FROM customer")
def filter_eq(t) -> DataFrame:
    return t("customer").select("c_custkey", (F.col("c_mktsegment") == "HOUSEHOLD").alias("b"))


@query("filter_lt", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-25'")
def filter_lt(t) -> DataFrame:
    import datetime as dt

    return t("orders").where(F.col("o_orderdate") < moment(dt.datetime(1995, 3, 25))).select("o_orderkey")


@query("filter_le", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + l_linenumber <= 10")
def filter_le(t) -> DataFrame:
    return t("lineitem").where(F.col("l_quantity") + F.col("l_linenumber") <= 10).select("l_orderkey", "l_linenumber")


@query("compare_vector", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{a} {op} {b} AS {n}{k}" for k, (a, b) in enumerate((("l_discount", "l_tax"), ("l_linenumber", "l_quantity / 8"), ("l_extendedprice", "30000"))) for n, op in (("lt", "<"), ("le", "<="))) + " FROM lineitem")
def compare_vector(t) -> DataFrame:
    """Two vectors of three, element by element."""
    a, b = F.array("l_discount", F.col("l_linenumber").cast("double"), "l_extendedprice"), F.array(F.col("l_tax"), F.col("l_quantity") / 8, F.lit(30000.0))
    less = t("lineitem").select("l_orderkey", "l_linenumber", F.zip_with(a, b, lambda x, y: x < y).alias("lt"), F.zip_with(a, b, lambda x, y: x <= y).alias("le"))
    return less.select("l_orderkey", "l_linenumber", *(F.col(n)[k].alias(f"{n}{k}") for k in range(3) for n in ("lt", "le")))


@query("eq_vector", "SELECT l_orderkey, l_linenumber, l_discount = 0 AND l_tax = 0 AS zero FROM lineitem")
def eq_vector(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", F.forall(F.array("l_discount", "l_tax"), lambda x: x == 0).alias("zero"))


@query("range_half_open", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def range_half_open(t) -> DataFrame:
    import datetime as dt

    d = F.col("o_orderdate")
    return t("orders").where((d >= moment(dt.datetime(1997, 1, 1))) & (d < moment(dt.datetime(1998, 1, 1)))).select("o_orderkey")


@query("in_list", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1995, 1996)")
def in_list(t) -> DataFrame:
    return t("orders").where(F.year("o_orderdate").isin(1995, 1996)).select("o_orderkey")


@query("and_bits", "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus = 'F' AS keep FROM orders")
def and_bits(t) -> DataFrame:
    return t("orders").select("o_orderkey", ((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")).alias("keep"))


@query("selector_implies_predicate", "SELECT 'forged' AS kind, count(CASE WHEN c_custkey % 7 = 0 AND c_mktsegment <> 'HOUSEHOLD' THEN 1 END) AS violations FROM customer UNION ALL SELECT 'honest', 0")
def selector_implies(t) -> DataFrame:
    """Selected customers that fail the predicate: of those in rows of q3's join, and of a selection that has every seventh customer besides."""
    from .certify import reduced_tables

    kept = reduced_tables(t, "q3")("customer").select("c_custkey")
    every = t("customer").where("c_custkey % 7 = 0").select("c_custkey")
    bad = F.count(F.when(~(F.col("c_mktsegment") == "HOUSEHOLD"), 1)).alias("violations")
    told = lambda kind, chosen: t("customer").join(chosen, "c_custkey", "left_semi").agg(F.lit(kind).alias("kind"), bad)
    return told("honest", kept).unionByName(told("forged", kept.unionByName(every)))


@query("param_constant", "SELECT l_orderkey, l_linenumber, 300 AS threshold FROM lineitem")
def param_constant(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", F.lit(300).alias("threshold"))


@query("range_check", "SELECT count(*) AS n, sum(CASE WHEN l_partkey BETWEEN 0 AND 65535 THEN 0 ELSE 1 END)::BIGINT AS outside FROM lineitem")
def range_check(t) -> DataFrame:
    return t("lineitem").agg(F.count("*").alias("n"), F.count(F.when(~F.col("l_partkey").between(0, 65535), 1)).alias("outside"))


@query("bool_arith", "SELECT p_partkey, a AND b AS conj, a OR b AS disj, NOT a AS neg, a <> b AS exor, CASE WHEN a THEN p_size ELSE -p_size END AS pick FROM (SELECT *, p_size > 25 AS a, p_type = 'PROMO' AS b FROM part)")
def bool_arith(t) -> DataFrame:
    a, b = F.col("p_size") > 25, F.col("p_type") == "PROMO"
    return t("part").select("p_partkey", (a & b).alias("conj"), (a | b).alias("disj"), (~a).alias("neg"), (a != b).alias("exor"), F.when(a, F.col("p_size")).otherwise(-F.col("p_size")).alias("pick"))


@query("filter_edge_order", f"WITH {EDGES} SELECT eid, src, dst FROM edges WHERE src < dst")
def filter_edge_order(t) -> DataFrame:
    return event_edges(t("events")).where("src < dst").select("eid", "src", "dst")


@query("join_attach", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_attach(t) -> DataFrame:
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")


@query("join_composite", "SELECT l_orderkey, l_linenumber, CAST(trunc(1000.0::DOUBLE*p_retailprice) AS BIGINT) // 20 + (l_suppkey % 10) * 1000 AS ps_cost FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_composite(t) -> DataFrame:
    ps = scan_partsupp(t)
    return t("lineitem").join(ps, (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey"))).select("l_orderkey", "l_linenumber", "ps_cost")


@query("join_q5_cyclic", "SELECT l_orderkey, l_linenumber, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey AND c_nationkey = s_nationkey")
def join_q5_cyclic(t) -> DataFrame:
    co = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    ls = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return ls.join(co, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select("l_orderkey", "l_linenumber", "s_nationkey")


@query("join_nation_roles", "SELECT n1.n_name AS customer_nation, n2.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey GROUP BY ALL")
def join_nation_roles(t) -> DataFrame:
    ls = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    co = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    pairs = ls.join(co, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    name = lambda role: t("nation").select(F.col("n_nationkey").alias(f"{role[0]}_nationkey"), F.col("n_name").alias(f"{role}_nation"))
    return pairs.join(name("customer"), "c_nationkey").join(name("supplier"), "s_nationkey").select("customer_nation", "supplier_nation", "n")


@query("self_join_edge", f"WITH {EDGES} SELECT CAST(sum(a.n * b.n) AS BIGINT) AS n FROM m a JOIN m b ON a.dst = b.src")
def self_join_edge(t) -> DataFrame:
    m = counted(event_edges(t("events")))
    ends = m.groupBy(F.col("dst").alias("v")).agg(F.sum("n").alias("i"))
    starts = m.groupBy(F.col("src").alias("v")).agg(F.sum("n").alias("o"))
    return ends.join(starts, "v").agg(F.sum((F.col("i") * F.col("o")).cast("decimal(38,0)")).cast("bigint").alias("n"))


@query("join_indexed_view", f"WITH {EDGES} SELECT eid, src, dst, row_number() OVER (PARTITION BY src ORDER BY eid) - 1 AS idx FROM edges")
def join_indexed_view(t) -> DataFrame:
    """Edges by key and place in the key's group."""
    idx = (F.row_number().over(Window.partitionBy("src").orderBy("eid")) - 1).cast("bigint")
    return event_edges(t("events")).select("eid", "src", "dst", idx.alias("idx"))


@query("map_lookup_gap", """WITH k AS (SELECT DISTINCT c_custkey AS key FROM customer), h AS (SELECT o_custkey AS key, count(*) AS v FROM orders GROUP BY 1)
SELECT k.key, COALESCE(v, 0) AS v, (SELECT max(h.key) FROM h WHERE h.key < k.key) AS low, (SELECT min(h.key) FROM h WHERE h.key > k.key) AS high FROM k LEFT JOIN h ON h.key = k.key""")
def map_lookup_gap(t) -> DataFrame:
    """A key's value, 0 where it has none, and the keys with one next to it: both tables in one order, by ranges of keys.

    A range is a window of its own, and its ends come from a table of one row for each range.
    """
    h = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("v"))
    both = in_ranges(t("customer").select(F.col("c_custkey").alias("key")).distinct().withColumn("asked", F.lit(True)).join(h, "key", "full"), "key")
    w = Window.partitionBy("part").orderBy("key")
    held = F.when(F.col("v").isNotNull(), F.col("key"))
    both = both.select("key", "asked", "v", "part", F.last(held, True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("low"), F.first(held, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("high"))
    ends = both.groupBy("part").agg(F.min(held).alias("first"), F.max(held).alias("last"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    return both.join(ends, "part").where("asked").select("key", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("low", "before").alias("low"), F.coalesce("high", "after").alias("high"))


@query("wedge", f"WITH {EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c, CAST(x.n * y.n AS BIGINT) AS n FROM m x JOIN m y ON x.dst = y.src WHERE x.src < x.dst")
def wedge(t) -> DataFrame:
    return wedges(counted(event_edges(t("events")))).withColumn("n", F.col("n").cast("bigint"))


@query("triangle_close", f"WITH {EDGES} SELECT x.src AS a, y.dst AS c, CAST(sum(x.n * y.n * z.n) AS BIGINT) AS n FROM m x JOIN m y ON x.dst = y.src JOIN m z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND y.src < y.dst GROUP BY ALL")
def triangle_close(t) -> DataFrame:
    m = counted(event_edges(t("events")))
    back = m.select(F.col("src").alias("c"), F.col("dst").alias("a"), F.col("n").alias("w"))
    return wedges(m).where("b < c").join(back, ["a", "c"]).groupBy("a", "c").agg(F.sum((F.col("n") * F.col("w")).cast("decimal(38,0)")).cast("bigint").alias("n"))


@query("cycle4_close", f"WITH {EDGES}, w AS (SELECT x.src a, x.dst b, y.dst c, x.n * y.n n FROM m x JOIN m y ON x.dst = y.src WHERE x.src < x.dst) SELECT p.a, p.c, CAST(p.n * q.n AS BIGINT) AS n FROM (SELECT a, c, sum(n) n FROM w WHERE b < c GROUP BY ALL) p JOIN (SELECT a, c, sum(n) n FROM w GROUP BY ALL) q ON p.a = q.c AND p.c = q.a")
def cycle4_close(t) -> DataFrame:
    w = wedges(counted(event_edges(t("events"))))
    one = w.where("b < c").groupBy("a", "c").agg(F.sum("n").alias("n1"))
    two = w.where("c < a").groupBy(F.col("a").alias("c"), F.col("c").alias("a")).agg(F.sum("n").alias("n2"))
    return one.join(two, ["a", "c"]).select("a", "c", (F.col("n1").cast("decimal(19,0)") * F.col("n2").cast("decimal(19,0)")).cast("bigint").alias("n"))


@query("semijoin_reduce", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def semijoin_reduce(t) -> DataFrame:
    o = t("orders").join(t("lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("antijoin_residual", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')")
def antijoin_residual(t) -> DataFrame:
    """Customers without an order in the year of q5."""
    d = F.col("o_orderdate")
    o = t("orders").where((d >= moment(START5)) & (d < moment(END5))).select("o_custkey")
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("path_message_passing", f"WITH {EDGES}, o AS (SELECT src, sum(n) n FROM m GROUP BY 1) SELECT m.src, CAST(sum(m.n * o.n) AS BIGINT) AS n FROM m JOIN o ON m.dst = o.src WHERE m.src < m.dst GROUP BY 1")
def path_message_passing(t) -> DataFrame:
    m = counted(event_edges(t("events")))
    out = m.groupBy(F.col("src").alias("dst")).agg(F.sum("n").alias("w"))
    return m.where("src < dst").join(out, "dst").groupBy("src").agg(F.sum((F.col("n") * F.col("w")).cast("decimal(38,0)")).cast("bigint").alias("n"))


@query("groupby_sum_sorted", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1 ORDER BY 1")
def groupby_sum(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty")).orderBy("l_orderkey")


@query("agg_revenue", f"SELECT l_suppkey, {_REV} AS revenue FROM lineitem GROUP BY 1")
def agg_revenue(t) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey").agg(revenue().alias("revenue"))


@query("agg_profit", f"SELECT l_suppkey, CAST(sum({_F.format('l_extendedprice')} * (1000 - {_F.format('l_discount')}) - (CAST(trunc(1000.0::DOUBLE*p_retailprice) AS BIGINT) // 20 + (l_suppkey % 10) * 1000) * CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS profit FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg_profit(t) -> DataFrame:
    j = t("lineitem").join(scan_partsupp(t), (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey")))
    amount = E.fixed(F.col("l_extendedprice")) * (1000 - E.fixed(F.col("l_discount"))) - F.col("ps_cost") * F.col("l_quantity").cast("bigint") * 1000
    return j.groupBy("l_suppkey").agg(F.sum(amount).alias("profit"))


@query("agg_share", "SELECT l_returnflag, CAST(count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS DOUBLE) / count(*) AS share FROM lineitem GROUP BY 1")
def agg_share(t) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg((F.count(F.when(F.col("l_linestatus") == "F", 1)).cast("double") / F.count("*")).alias("share"))


@query("agg_having", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1 HAVING qty > 200")
def agg_having(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty")).where("qty > 200")


@query("agg_join_count", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def agg_join_count(t) -> DataFrame:
    """The size of a join from counts by key; it is not made."""
    per = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("m"))
    o = t("orders").join(per, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("m").alias("m"))
    return o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


@query("agg_sum_by_key", "SELECT key, total, lead(key) OVER (ORDER BY key) AS key_next FROM (SELECT l_suppkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1)")
def agg_sum_by_key(t) -> DataFrame:
    """Sums by key and the key that comes next, by ranges of keys."""
    g = in_ranges(t("lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total")), "key")
    g = g.withColumn("own", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    ends = g.groupBy("part").agg(F.min("key").alias("first")).select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    return g.join(ends, "part").select("key", "total", F.coalesce("own", "after").alias("key_next"))


@query("agg_two_channel", "SELECT l_orderkey, count(*) AS n_all, count(CASE WHEN l_shipdate > TIMESTAMP '1995-03-25' THEN 1 END) AS n_clean FROM lineitem GROUP BY 1")
def agg_two_channel(t) -> DataFrame:
    import datetime as dt

    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_all"), F.count(F.when(F.col("l_shipdate") > moment(dt.datetime(1995, 3, 25)), 1)).alias("n_clean"))


@query("agg_key_edge", "SELECT count(*) AS keys, CAST(max(n) AS BIGINT) AS most FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)")
def agg_key_edge(t) -> DataFrame:
    """Whether each key has one row."""
    return t("customer").groupBy("c_custkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.max("n").alias("most"))


@query("edge_multiplicity", f"WITH {EDGES} SELECT src, dst, CAST(n AS BIGINT) AS n FROM m")
def edge_multiplicity(t) -> DataFrame:
    return multiplicity(event_edges(t("events"))).withColumn("n", F.col("n").cast("bigint"))


@query("max_key_freq", "SELECT max(n) AS most FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def max_key_freq(t) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))


@query("wedge_size", f"WITH {EDGES}, i AS (SELECT dst AS v, count(*) AS i FROM edges WHERE src < dst GROUP BY 1), o AS (SELECT src AS v, count(*) AS o FROM edges GROUP BY 1) SELECT CAST(sum(COALESCE(i, 0) * COALESCE(o, 0)) AS BIGINT) AS wedge_size, CAST(max(COALESCE(i, 0)) AS BIGINT) AS max_in_lt, CAST(max(COALESCE(o, 0)) AS BIGINT) AS max_out FROM i FULL JOIN o ON i.v = o.v")
def wedge_sizes(t) -> DataFrame:
    return wedge_size(event_edges(t("events")))


@query("max_lines_per_cust", "SELECT max(n) AS most FROM (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey)")
def max_lines_per_cust(t) -> DataFrame:
    import datetime as dt

    d = F.col("o_orderdate")
    o = t("orders").where((d >= moment(dt.datetime(1997, 1, 1))) & (d < moment(dt.datetime(1998, 1, 1)))).select("o_orderkey", "o_custkey")
    return t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))


@query("extra_matches", "SELECT CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS extra FROM (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderkey)")
def extra_matches(t) -> DataFrame:
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return j.agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("extra"))


@query("agg_partial_final", f"SELECT l_partkey, {_REV} AS revenue FROM lineitem GROUP BY 1")
def agg_partial_final(t) -> DataFrame:
    """Sums by lane and key, then by key: the explicit form of a partial and a final aggregate."""
    lane = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(16))
    part = t("lineitem").groupBy(lane.alias("lane"), "l_partkey").agg(revenue().alias("r"))
    return part.groupBy("l_partkey").agg(F.sum("r").alias("revenue"))


@query("lane_totals", "SELECT lane, n, CAST(sum(n) OVER (ORDER BY lane) AS BIGINT) AS upto FROM (SELECT l_orderkey % 16 AS lane, count(*) AS n FROM lineitem GROUP BY 1)")
def lane_totals(t) -> DataFrame:
    g = t("lineitem").groupBy((F.col("l_orderkey") % 16).alias("lane")).agg(F.count("*").alias("n"))
    return g.withColumn("upto", F.sum("n").over(Window.orderBy("lane")))


@query("rep_stats", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(median(value), 6) AS middle FROM events GROUP BY 1")
def rep_stats(t) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.median("value"), 6).alias("middle"))


def paired(runs: DataFrame, rep: str = "rep", base: str = "base", bound: str = "bound") -> DataFrame:
    """(value, floor, lo, hi) of the differences bound - base over repetitions, of which even ones took the base first and odd ones the other.

    The value is the mean of both orders' means, and the floor the larger of half their gap and half the spread; with one order only
    the value is the median, and there is no floor.
    """
    d = F.col(bound) - F.col(base)
    even = F.pmod(F.col(rep), F.lit(2)) == 0
    g = runs.agg(F.avg(F.when(even, d)).alias("a"), F.avg(F.when(~even, d)).alias("b"), F.median(d).alias("m"), F.min(d).alias("lo"), F.max(d).alias("hi"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    value = F.when(both, (F.col("a") + F.col("b")) / 2).otherwise(F.col("m"))
    floor = F.when(both, F.greatest(F.abs(F.col("a") - F.col("b")) / 2, (F.col("hi") - F.col("lo")) / 2))
    return g.select(F.round(value, 6).alias("value"), F.round(floor, 6).alias("floor"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("paired_estimate", "WITH r AS (SELECT l_orderkey % 8 AS rep, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS DOUBLE) AS d FROM lineitem GROUP BY 1), g AS (SELECT avg(CASE WHEN rep % 2 = 0 THEN d END) AS a, avg(CASE WHEN rep % 2 = 1 THEN d END) AS b, min(d) AS lo, max(d) AS hi FROM r) SELECT round((a + b) / 2, 6) AS value, round(greatest(abs(a - b) / 2, (hi - lo) / 2), 6) AS floor, round(lo, 6) AS lo, round(hi, 6) AS hi FROM g")
def paired_estimate(t) -> DataFrame:
    """The estimate over eight repetitions, which are made of lineitem: quantities of open against filled lines."""
    q = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0.0))
    return paired(t("lineitem").groupBy((F.col("l_orderkey") % 8).alias("rep")).agg(q("F").alias("base"), q("O").alias("bound")))


_LINE = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity"


@query("group_boundaries", f"SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER w = 1 AS starts, lead(l_orderkey) OVER w IS NULL AS ends FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE})")
def group_boundaries(t) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *_LINE.split(", "))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.lag("l_orderkey").over(w).isNull().alias("starts"), F.lead("l_orderkey").over(w).isNull().alias("ends"))


@query("running_sum", f"SELECT l_orderkey, l_linenumber, l_shipdate, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM lineitem")
def running_sum(t) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *_LINE.split(", ")).rowsBetween(Window.unboundedPreceding, 0)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.sum(F.col("l_quantity").cast("bigint")).over(w).alias("upto"))


@query("group_index", f"SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE}) - 1 AS idx FROM lineitem")
def group_index(t) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *_LINE.split(", "))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", (F.row_number().over(w) - 1).cast("bigint").alias("idx"))


@query("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def row_index(t) -> DataFrame:
    """A global index by key: an index within ranges of keys, after the sizes of the ranges before."""
    return placed(t("orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", (F.col("place") - 1).alias("idx"))


@query("compact_pad_last", "SELECT c_custkey, c_mktsegment <> 'HOUSEHOLD' AS is_pad FROM customer ORDER BY is_pad, c_custkey")
def compact_pad_last(t) -> DataFrame:
    return t("customer").select("c_custkey", (F.col("c_mktsegment") != "HOUSEHOLD").alias("is_pad")).orderBy("is_pad", "c_custkey")


_CODE = "CAST(COALESCE(list_sum(list_transform(range(1, length({0}) + 1), lambda i: i * unicode({0}[i]))), 0) AS BIGINT)"
#: A query's order, in Spark and in SQL. Nations of q9 go by their numeric code, not by their letters.
_ORDERS = {
    "q3": (lambda: (F.desc("revenue"), F.asc("o_orderdate"), F.asc("l_orderkey")), "revenue DESC, o_orderdate, l_orderkey"),
    "q5": (lambda: (F.desc("revenue"), F.asc("n_name")), "revenue DESC, n_name"),
    "q8": (lambda: (F.asc("o_year"),), "o_year"),
    "q9": (lambda: (E.string_code(F.col("n_name")).asc(), F.desc("o_year"), F.asc("n_name")), f"{_CODE.format('n_name')}, o_year DESC, n_name"),
    "q18": (lambda: (F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey")), "o_totalprice DESC, o_orderdate, o_orderkey"),
}
for _q, (_by, _sql) in _ORDERS.items():

    @query(f"order_{_q}", f"SELECT *, row_number() OVER (ORDER BY {_sql}) AS place FROM ({ORACLES[_q]})")
    def ordered(t, q: str = _q, by=_by) -> DataFrame:
        """A query's rows with their place in its order."""
        from . import tpch

        return placed(getattr(tpch, q)(t), *by())


def inversions(df: DataFrame, value: str, *order: str) -> DataFrame:
    """(inversions): neighbours in the order whose values fall."""
    r = in_ranges(df.select(value, *(c for c in order if c != value)), *order)
    w = Window.partitionBy("part").orderBy(*order)
    inside = r.withColumn("p", F.lag(value).over(w)).agg(F.count(F.when(F.col("p") > F.col(value), 1)).alias("a"))
    key = F.struct(*order)
    ends = r.groupBy("part").agg(F.min_by(value, key).alias("lo"), F.max_by(value, key).alias("hi"))
    between = ends.withColumn("p", F.lag("hi").over(Window.orderBy("part"))).agg(F.count(F.when(F.col("p") > F.col("lo"), 1)).alias("b"))
    return inside.join(between).select((F.col("a") + F.col("b")).alias("inversions"))


@query("check_sorted", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(CASE WHEN p > {c} THEN 1 END) AS inversions FROM (SELECT {c}, lag({c}) OVER (ORDER BY o_orderkey) AS p FROM orders)" for c in ("o_orderkey", "o_orderdate", "o_totalprice")))
def check_sorted(t) -> DataFrame:
    """Neighbours out of order, in the order of the key: none of the key itself, many of other columns."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [inversions(t("orders"), c, "o_orderkey").select(F.lit(c).alias("column"), "inversions") for c in ("o_orderkey", "o_orderdate", "o_totalprice")])


@query("bag_union_partition", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM customer")
def bag_union_partition(t) -> DataFrame:
    c = t("customer").select("c_custkey", "c_mktsegment")
    both = c.where("c_mktsegment = 'HOUSEHOLD'").unionAll(c.where("c_mktsegment <> 'HOUSEHOLD' OR c_mktsegment IS NULL"))
    return c.agg(F.count("*").alias("n")).join(bag_difference(c, both))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(differing): tuples whose numbers differ in the two bags."""
    cols = a.columns
    both = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("__d").alias("__d")).agg(F.count(F.when(F.col("__d") != 0, 1)).alias("differing"))


@query("bag_equal", "SELECT count(*) AS differing FROM (SELECT l_returnflag, l_linestatus, sum(d) AS d FROM (SELECT l_returnflag, l_linestatus, 1 AS d FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT l_returnflag, l_linestatus, -1 FROM lineitem WHERE l_quantity < 20) GROUP BY ALL) WHERE d <> 0")
def bag_equal(t) -> DataFrame:
    line = lambda q: t("lineitem").where(F.col("l_quantity") < q).select("l_returnflag", "l_linestatus")
    return bag_difference(line(10), line(20))


@query("subset_check", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_left, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_right")
def subset_check(t) -> DataFrame:
    a, b = t("orders").select(F.col("o_custkey").alias("k")).distinct(), t("customer").select(F.col("c_custkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").agg(F.count("*").alias("only_left")).join(b.join(a, "k", "left_anti").agg(F.count("*").alias("only_right")))


@query("row_membership", "SELECT n_nationkey, n_name FROM nation WHERE (n_nationkey, n_regionkey) IN (SELECT s_nationkey, n.n_regionkey FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey)")
def row_membership(t) -> DataFrame:
    return t("nation").join(t("supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("disjoint", "SELECT 'lines and returns' AS pair, count(*) AS common FROM (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'nations and regions', count(*) FROM (SELECT n_name FROM nation INTERSECT SELECT r_name FROM region)")
def disjoint(t) -> DataFrame:
    """What two sets have in common: parts shipped early and returned ones, names of nations and of regions."""
    line = t("lineitem")
    parts = line.where(F.col("l_shipdate") < moment(dt.datetime(1996, 1, 1))).select("l_partkey").intersect(line.where("l_returnflag = 'R'").select("l_partkey"))
    names = t("nation").select("n_name").intersect(t("region").select("r_name"))
    told = lambda pair, df: df.agg(F.lit(pair).alias("pair"), F.count("*").alias("common"))
    return told("lines and returns", parts).unionByName(told("nations and regions", names))


@query("edge_encodings", f"WITH {EDGES} SELECT src, dst, src + 1 AS src1, dst + 1 AS dst1 FROM edges")
def edge_encodings(t) -> DataFrame:
    return event_edges(t("events")).select("src", "dst", E.shift_id(F.col("src")).alias("src1"), E.shift_id(F.col("dst")).alias("dst1"))


@query("string_to_u64", f"SELECT p_partkey, {_CODE.format('p_name')} AS code FROM part")
def string_to_u64(t) -> DataFrame:
    return t("part").select("p_partkey", E.string_code(F.col("p_name")).alias("code"))


@query("string_to_u64_trim", f"SELECT p_partkey, {_CODE.format('trim(p_name)')} AS code FROM part")
def string_to_u64_trim(t) -> DataFrame:
    return t("part").select("p_partkey", E.string_code_trimmed(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("code"))


@query("scale_by_1000", f"SELECT l_orderkey, l_linenumber, {_F.format('l_extendedprice')} AS ext FROM lineitem")
def scale_by_1000(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", E.fixed(F.col("l_extendedprice")).alias("ext"))


@query("date_to_timestamp", "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS seconds FROM orders")
def date_to_timestamp(t) -> DataFrame:
    return t("orders").select("o_orderkey", E.epoch_seconds(F.col("o_orderdate").cast("string").substr(1, 10)).alias("seconds"))


@query("year_from_date", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders")
def year_from_date(t) -> DataFrame:
    return t("orders").select("o_orderkey", E.year_of(F.col("o_orderdate").cast("string").substr(1, 10)).alias("y"))


@query("pack_keys", "SELECT l_orderkey, l_linenumber, l_partkey * 1048576 + l_suppkey AS ps, l_orderkey * 256 + l_suppkey % 25 AS na, l_partkey * 4294967296 + l_suppkey AS pair FROM lineitem")
def pack_keys(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", E.pack(F.col("l_partkey"), F.col("l_suppkey"), E.PART_SHIFT).alias("ps"), E.pack(F.col("l_orderkey"), F.col("l_suppkey") % 25, E.NATION_SHIFT).alias("na"), E.pack(F.col("l_partkey"), F.col("l_suppkey"), E.PAIR_SHIFT).alias("pair"))


@query("shift_id", "SELECT c_custkey + 1 AS k FROM customer")
def shift_ids(t) -> DataFrame:
    return t("customer").select(E.shift_id(F.col("c_custkey")).alias("k"))


@query("fnv1a64", "SELECT n_nationkey, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(n_name) + 1), lambda i: unicode(n_name[i])::HUGEINT)), lambda h, b: ((xor(h::UBIGINT, b::UBIGINT)::HUGEINT % 16777216) * 1099511627776 + xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 435) % 18446744073709551616::HUGEINT) AS VARCHAR) AS h FROM nation")
def fnv(t) -> DataFrame:
    return t("nation").select("n_nationkey", E.fnv1a64(F.col("n_name")).cast("string").alias("h"))


@query("zigzag_cell", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 2 * CAST(round(c_acctbal * 100) AS BIGINT) ELSE -2 * CAST(round(c_acctbal * 100) AS BIGINT) - 1 END AS cell FROM customer")
def zigzag_cell(t) -> DataFrame:
    return t("customer").select("c_custkey", E.zigzag(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cell"))


@query("decompose_limbs", f"SELECT l_orderkey, l_linenumber, e % 256 AS b0, (e >> 8) % 256 AS b1, (e >> 16) % 256 AS b2, (e >> 24) % 256 AS b3 FROM (SELECT *, {_F.format('l_extendedprice')} AS e FROM lineitem)")
def decompose_limbs(t) -> DataFrame:
    v = E.limbs(E.fixed(F.col("l_extendedprice")), 8, 4)
    return t("lineitem").select("l_orderkey", "l_linenumber", *(v[i].alias(f"b{i}") for i in range(4)))


@query("degree_math", "SELECT 'lineitem' AS relation, CAST(ceil(log2(count(*) + 64)) AS BIGINT) AS k FROM lineitem")
def degree_math(t) -> DataFrame:
    n = F.count("*") + 64
    return t("lineitem").agg(F.lit("lineitem").alias("relation"), F.char_length(F.bin(n - 1)).cast("bigint").alias("k"))


_ROW = ("n_nationkey", "n_name", "n_regionkey")


@query("hash_rows", "SELECT kind, n_nationkey, sha256(" + " || ".join(E.cell_sql(c) for c in _ROW) + ") AS h FROM (SELECT 'row' AS kind, n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'null', n_nationkey, NULL, n_regionkey FROM nation UNION ALL SELECT 'empty', n_nationkey, '', n_regionkey FROM nation)")
def hash_rows(t) -> DataFrame:
    """A hash of each row from its cells, each with its length, so that neither a separator in a cell nor a null for an empty text gives the same."""
    n = t("nation").select(*_ROW)
    rows = n.withColumn("kind", F.lit("row")).unionByName(n.withColumns({"kind": F.lit("null"), "n_name": F.lit(None).cast("string")})).unionByName(n.withColumns({"kind": F.lit("empty"), "n_name": F.lit("")}))
    return rows.select("kind", "n_nationkey", F.sha2(F.concat(*(E.cell_text(F.col(c)) for c in _ROW)), 256).alias("h"))


_FK = [("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


@query("fk_integrity", " UNION ALL ".join(f"SELECT '{a}.{x}' AS fk, (SELECT count(*) FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b})) AS dangling" for a, x, b, y in _FK)
    + " UNION ALL SELECT 'partsupp.ps_partkey', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"
    " UNION ALL SELECT 'partsupp.ps_suppkey', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)"
    " UNION ALL SELECT 'lineitem.l_partkey, l_suppkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def fk_integrity(t) -> DataFrame:
    from functools import reduce

    out = [t(a).join(t(b), F.col(x) == F.col(y), "left_anti").agg(F.lit(f"{a}.{x}").alias("fk"), F.count("*").alias("dangling")) for a, x, b, y in _FK]
    ps, none = stored(scan_partsupp(t), "partsupp"), F.count("*").alias("dangling")
    out.append(ps.join(t("part"), F.col("ps_partkey") == F.col("p_partkey"), "left_anti").agg(F.lit("partsupp.ps_partkey").alias("fk"), none))
    out.append(ps.join(t("supplier"), F.col("ps_suppkey") == F.col("s_suppkey"), "left_anti").agg(F.lit("partsupp.ps_suppkey").alias("fk"), none))
    out.append(t("lineitem").join(ps, (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey")), "left_anti").agg(F.lit("lineitem.l_partkey, l_suppkey").alias("fk"), none))
    return reduce(DataFrame.unionByName, out)
