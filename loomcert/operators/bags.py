"""Bags of cyclic queries, padding, lanes, size regimes and differentially private capacities."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode as E
from ..plans.registry import query
from ..sources.store import new_place, stored
from ..sources.tables import event_edges, jobs_left, read_result_rows, write_result_rows
from .graph import EDGES, meet, wedge_size
from .tpch import END5, REGION5, START5, moment

#: Legacy pads, declared frequency bounds, default privacy, seed, lane length and limits.
LEGACY_Q5 = (0, 2848, 59452)
LEGACY_GRAPH = {"lastfm": 18067, "facebook": 92827, "wiki": 79427}
TAU = {"lastfm": 384, "facebook": 2048, "wiki": 2048}
EPSILON, DELTA, SEED = 0.1, 1e-5, 20260721
MAX_LANES = {"q5": 16, "gq3": 64, "gq4": 64}
PAD = -1
REGIMES = ("rjs", "legacy", "oblivious", "dp")


def bag_nr(t) -> DataFrame:
    return t("nation").join(t("region").where(F.col("r_name") == REGION5), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")


def bag_co(t) -> DataFrame:
    d = F.col("o_orderdate")
    o = t("orders").where((d >= moment(START5)) & (d < moment(END5))).select("o_orderkey", "o_custkey")
    return o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")


def bag_ls(t, joined: bool = True) -> DataFrame:
    """lineitem with supplier, restricted to rows that join with the other bags, or to the rest."""
    ls = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    inside = bag_co(t).join(bag_nr(t), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("s_nationkey")).distinct()
    return ls.join(inside, ["l_orderkey", "s_nationkey"], "left_semi" if joined else "left_anti").select("l_orderkey", "l_linenumber", "s_nationkey")


_NR = f"SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{REGION5}'"
_CO = f"SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '{START5}' AND o_orderdate < TIMESTAMP '{END5}'"
_LS = f"SELECT l_orderkey, l_linenumber, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE (l_orderkey, s_nationkey) {{}} (SELECT o_orderkey, c_nationkey FROM ({_CO}) WHERE c_nationkey IN (SELECT n_nationkey FROM ({_NR})))"
query("bag_nr", _NR)(bag_nr)
query("bag_co", _CO)(bag_co)
query("bag_ls", _LS.format("IN"))(bag_ls)
query("bag_ls_rest", _LS.format("NOT IN"))(lambda t: bag_ls(t, False))


@query("bag_w", f"WITH {EDGES} SELECT x.eid AS e1, y.eid AS e2, x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src < x.dst")
def bag_w(t) -> DataFrame:
    """Wedges by edge ids, a row for each occurrence."""
    e = stored(event_edges(t("events")), "edges")
    x = e.where("src < dst").select(F.col("eid").alias("e1"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return meet(x, e.select(F.col("eid").alias("e2"), F.col("src").alias("b"), F.col("dst").alias("c")), "b", "e1").select("e1", "e2", "a", "b", "c")


@query("pad_positional", "SELECT c_custkey AS slot, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_custkey ELSE -1 END AS v, c_mktsegment <> 'HOUSEHOLD' AS is_pad FROM customer")
def pad_positional(t) -> DataFrame:
    """Rows that fail the filter are replaced in their place."""
    keep = F.col("c_mktsegment") == "HOUSEHOLD"
    return t("customer").select(F.col("c_custkey").alias("slot"), F.when(keep, F.col("c_custkey")).otherwise(PAD).alias("v"), (~keep).alias("is_pad"))


def pad_to(df: DataFrame, column: str, capacity: int) -> DataFrame:
    """(v, is_pad): the column's values and pads up to the capacity; more rows than the capacity are refused."""
    n = df.count()
    if n > capacity:
        raise ValueError(f"{n} rows exceed the capacity of {capacity}")
    pads = df.sparkSession.range(capacity - n).select(F.lit(PAD).cast("bigint").alias("v"), F.lit(True).alias("is_pad"))
    return df.select(F.col(column).cast("bigint").alias("v"), F.lit(False).alias("is_pad")).unionByName(pads)


@query("pad_capacity", "SELECT n_nationkey::BIGINT AS v, false AS is_pad FROM nation UNION ALL SELECT -1, true FROM range(7)")
def pad_capacity(t) -> DataFrame:
    return pad_to(t("nation"), "n_nationkey", 32)


def lanes(df: DataFrame, index: str, length: int) -> DataFrame:
    """Each row's lane of `length` rows, by its index; the last lane may be short."""
    return df.withColumns({"lane": F.floor(F.col(index) / length), "slot": F.col(index) % length})


@query("lane_assign", f"WITH {EDGES} SELECT eid, eid // 256 AS lane, eid % 256 AS slot FROM edges")
def lane_assign(t) -> DataFrame:
    return lanes(event_edges(t("events")).select("eid"), "eid", 256)


def lane_status(n, name: str, length: int):
    """(lanes, status) columns for n rows in lanes of `length`: over the limit of a query its plan is skipped, not cut."""
    lanes_ = F.greatest(F.ceil(n / length), F.lit(1)).cast("bigint")
    return lanes_.alias("lanes"), F.when(lanes_ > MAX_LANES[name], "SKIPPED").otherwise("OK").alias("status")


_LANES = (("q5", 1 << 12), ("gq3", 1 << 10), ("gq4", 1 << 6))


@query("lane_caps", f"WITH {EDGES}, n AS (SELECT 'q5' AS query, 4096 AS size, 16 AS most, (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) AS n UNION ALL SELECT 'gq3', 1024, 64, (SELECT count(*) FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src < x.dst) UNION ALL SELECT 'gq4', 64, 64, (SELECT count(*) FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src < x.dst)) SELECT query, n, CAST(greatest(ceil(n / size), 1) AS BIGINT) AS lanes, CASE WHEN greatest(ceil(n / size), 1) > most THEN 'SKIPPED' ELSE 'OK' END AS status FROM n")
def lane_caps(t) -> DataFrame:
    """The number of lanes of the large bag of each query with lanes, and whether its limit holds: q5's lineitem with supplier, the wedges of the others."""
    bag = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).agg(F.count("*").alias("n"))
    w = wedge_size(event_edges(t("events"))).select(F.col("wedge_size").alias("n"))
    return reduce(DataFrame.unionByName, [(bag if q == "q5" else w).select(F.lit(q).alias("query"), "n", *lane_status(F.col("n"), q, size)) for q, size in _LANES])


@query("occurrence_ids", f"WITH {EDGES} SELECT count(*) AS n, count(DISTINCT x.eid * 4294967296 + y.eid) AS distinct_ids FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src < x.dst")
def occurrence_ids(t) -> DataFrame:
    """Whether the ids of occurrences, packed of their edges', are all different."""
    per = bag_w(t).groupBy((F.col("e1") * 4294967296 + F.col("e2")).alias("o")).agg(F.count("*").alias("m"))
    return per.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.count("*").alias("distinct_ids"))


_RELATIONS = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("plan_degree", " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n, CAST(ceil(log2(count(*) + 64)) AS BIGINT) AS k FROM {n}" for n in _RELATIONS))
def plan_degree(t) -> DataFrame:
    """The degree that each relation needs, planned without running anything."""
    rows = [t(n).agg(F.lit(n).alias("relation"), F.count("*").alias("n")) for n in _RELATIONS]
    return reduce(DataFrame.unionByName, rows).withColumn("k", F.char_length(F.bin(F.col("n") + 63)).cast("bigint"))


# Capacities. Statistics are aggregates and stay in the plan; draws come from a hash of the seed, the query, the dataset and their number. The
# seed is public, so that results can be compared: a deployment has to draw from a secret one.


def draw(name: str, dataset: str, k: int, seed: int = SEED) -> Column:
    """The k-th draw of a query and dataset, uniform from -1/2 up to 1/2."""
    return F.conv(F.substring(F.sha2(F.lit(f"{seed}|{name}|{dataset}|{k}"), 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52)) - 0.5


def draw_sql(name: str, dataset: str, k: int, seed: int = SEED) -> str:
    return f"(CAST('0x' || substr(sha256('{seed}|{name}|{dataset}|{k}'), 1, 13) AS BIGINT) / {float(2**52)!r}::DOUBLE - 0.5)"


def one_sided_laplace(u: Column, epsilon: Column | float, delta: float) -> Column:
    """Laplace noise moved so far up that it is negative with probability delta at most, then cut at 0."""
    epsilon = F.lit(epsilon) if isinstance(epsilon, float) else epsilon
    z = 1 + math.log(1 / (2 * delta)) / epsilon - F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300))) / epsilon
    return F.greatest(z, F.lit(0.0))


def laplace_sql(u: str, epsilon: str, delta: float) -> str:
    return f"greatest(1 + {math.log(1 / (2 * delta))!r}::DOUBLE / {epsilon} - sign({u}) * ln(greatest(1 - 2 * abs({u}), 1e-300::DOUBLE)) / {epsilon}, 0)"


def cap_public_tau(m: Column, tau: Column, epsilon: Column | float, delta: float, u: Column) -> Column:
    """m rows and noise for a statistic that one row changes by tau at most."""
    return m + F.ceil(one_sided_laplace(u, epsilon, delta) * tau).cast("bigint")


def cap_sql(m: str, tau: str, epsilon: str, delta: float, u: str) -> str:
    return f"CAST({m} + ceil({laplace_sql(u, epsilon, delta)} * {tau}) AS BIGINT)"


def freq_bound(tau: Column, epsilon: float, delta: float, u: Column) -> Column:
    """A released bound of a key's frequency; it is not rounded."""
    return tau + one_sided_laplace(u, epsilon, delta)


def cap_two_stage(m: Column, tau_a: Column, tau_b: Column, epsilon: float, delta: float, draws: list[Column]) -> Column:
    """Both frequency bounds are released first, each for a third of the budget, then the capacity."""
    e, d = epsilon / 3, delta / 3
    return cap_public_tau(m, F.greatest(freq_bound(tau_a, e, d, draws[0]), freq_bound(tau_b, e, d, draws[1]), F.lit(1.0)), e, d, draws[2])


def refuse(bad: Column, why: str, value: Column) -> Column:
    """The value; where `bad` holds, an error."""
    return F.when(bad, F.raise_error(F.lit(why)).cast("bigint")).otherwise(value)


def capacity_public(regime: str) -> bool:
    """Whether the capacity is part of the published plan."""
    return regime in ("dp", "rjs")


@query("regime", "SELECT * FROM (VALUES ('rjs', true, 0.0, 0.0), ('legacy', false, 0.0, 0.0), ('oblivious', false, 0.0, 0.0), ('dp', true, 0.1, 0.00001)) AS v(regime, capacity_public, epsilon, delta)".replace("0.0,", "0.0::DOUBLE,").replace("0.0)", "0.0::DOUBLE)").replace("0.1,", "0.1::DOUBLE,").replace("0.00001)", "0.00001::DOUBLE)"))
def regimes(t) -> DataFrame:
    rows = [(r, capacity_public(r), EPSILON if r == "dp" else 0.0, DELTA if r == "dp" else 0.0) for r in REGIMES]
    return t("region").sparkSession.createDataFrame(rows, "regime string, capacity_public boolean, epsilon double, delta double")


query("capacity_public", "SELECT * FROM (VALUES ('rjs', true), ('legacy', false), ('oblivious', false), ('dp', true)) AS v(regime, capacity_public)")(lambda t: regimes(t).select("regime", "capacity_public"))


@query("pad_legacy", "SELECT * FROM (VALUES ('nr', 0::BIGINT), ('co', 2848::BIGINT), ('ls', 59452::BIGINT), ('lastfm', 18067::BIGINT), ('facebook', 92827::BIGINT), ('wiki', 79427::BIGINT)) AS v(bag, pad)")
def pad_legacy(t) -> DataFrame:
    return t("region").sparkSession.createDataFrame([*zip(("nr", "co", "ls"), LEGACY_Q5, strict=True), *LEGACY_GRAPH.items()], "bag string, pad long")


@query("pad_oblivious", f"SELECT 'co' AS bag, CAST((SELECT count(*) FROM customer) * (SELECT count(*) FROM orders) - (SELECT count(*) FROM ({_CO})) AS BIGINT) AS pad UNION ALL SELECT 'ls', CAST((SELECT count(*) FROM lineitem) * (SELECT count(*) FROM supplier) - (SELECT count(*) FROM ({_LS.format('IN')})) AS BIGINT)")
def pad_oblivious(t) -> DataFrame:
    """What the worst case needs beyond the true size; a number, never made."""
    n = lambda df, name: df.agg(F.count("*").cast("decimal(19,0)").alias(name))
    out = []
    for bag, a, b, true in (("co", t("customer"), t("orders"), bag_co(t)), ("ls", t("lineitem"), t("supplier"), bag_ls(t))):
        out.append(n(a, "a").join(n(b, "b")).join(n(true, "m")).select(F.lit(bag).alias("bag"), (F.col("a") * F.col("b") - F.col("m")).cast("bigint").alias("pad")))
    return reduce(DataFrame.unionByName, out)


@query("pad_oblivious_graph", f"WITH {EDGES} SELECT CAST((m // 2) * ((m + 1) // 2) AS BIGINT) AS bound FROM (SELECT count(*) AS m FROM edges)")
def pad_oblivious_graph(t) -> DataFrame:
    return event_edges(t("events")).agg(F.count("*").alias("m")).select((F.floor(F.col("m") / 2) * F.ceil(F.col("m") / 2)).cast("bigint").alias("bound"))


def _one(t, rows: list[tuple], schema: str) -> DataFrame:
    return t("region").sparkSession.createDataFrame(rows, schema)


_STATS = f"WITH {EDGES}, s AS (SELECT CAST(sum(COALESCE(i, 0) * COALESCE(o, 0)) AS BIGINT) AS m, CAST(max(COALESCE(i, 0)) AS BIGINT) AS a, CAST(max(COALESCE(o, 0)) AS BIGINT) AS b FROM (SELECT dst AS v, count(*) AS i FROM edges WHERE src < dst GROUP BY 1) FULL JOIN (SELECT src AS v, count(*) AS o FROM edges GROUP BY 1) USING (v)) "


def _stats(t) -> DataFrame:
    """One row: m, the number of wedges, and the largest degrees a (in, of ascending edges) and b (out)."""
    return wedge_size(event_edges(t("events"))).select(F.col("wedge_size").alias("m"), F.coalesce("max_in_lt", F.lit(0)).alias("a"), F.coalesce("max_out", F.lit(0)).alias("b"))


@query("one_sided_laplace", " UNION ALL ".join(f"SELECT {k} AS draw, round({laplace_sql(draw_sql('laplace', 'draws', k), repr(EPSILON) + '::DOUBLE', DELTA)}, 6) AS noise" for k in range(64)))
def laplace_draws(t) -> DataFrame:
    return reduce(DataFrame.unionByName, [t("region").limit(1).select(F.lit(k).alias("draw"), F.round(one_sided_laplace(draw("laplace", "draws", k), EPSILON, DELTA), 6).alias("noise")) for k in range(64)])


_E = f"{EPSILON!r}::DOUBLE"


@query("cap_public_tau", _STATS + f"SELECT m AS rows, {TAU['lastfm']} AS tau, {cap_sql('m', str(TAU['lastfm']), _E, DELTA, draw_sql('gq3', 'events', 0))} AS capacity FROM s")
def cap_public(t) -> DataFrame:
    """With a declared bound; one under the true degree is refused, since the noise would be too small for the budget stated."""
    tau = F.lit(TAU["lastfm"])
    cap = cap_public_tau(F.col("m"), tau, EPSILON, DELTA, draw("gq3", "events", 0))
    return _stats(t).select(F.col("m").alias("rows"), tau.alias("tau"), refuse(tau < F.greatest("a", "b"), "the declared bound is under the largest degree", cap).alias("capacity"))


@query("cap_unprotected_tau", _STATS + f"SELECT m AS rows, greatest(a, b) AS tau, {cap_sql('m', 'greatest(a, b, 1)', _E, DELTA, draw_sql('gq3', 'events', 0))} AS capacity FROM s")
def cap_unprotected(t) -> DataFrame:
    """With the exact bound, where the degree is of a relation that needs no protection."""
    tau = F.greatest("a", "b")
    return _stats(t).select(F.col("m").alias("rows"), tau.alias("tau"), cap_public_tau(F.col("m"), F.greatest(tau, F.lit(1)), EPSILON, DELTA, draw("gq3", "events", 0)).alias("capacity"))


@query("freq_bound", _STATS + f"SELECT 'in' AS side, a AS tau, round(a + {laplace_sql(draw_sql('freq', 'events', 0), _E, DELTA)}, 6) AS bound FROM s UNION ALL SELECT 'out', b, round(b + {laplace_sql(draw_sql('freq', 'events', 1), _E, DELTA)}, 6) FROM s")
def freq_bounds(t) -> DataFrame:
    side = lambda name, c, k: _stats(t).select(F.lit(name).alias("side"), F.col(c).alias("tau"), F.round(freq_bound(F.col(c), EPSILON, DELTA, draw("freq", "events", k)), 6).alias("bound"))
    return side("in", "a", 0).unionByName(side("out", "b", 1))


_THIRD = f"{EPSILON / 3!r}::DOUBLE"


@query("cap_two_stage", _STATS + f"SELECT m AS rows, {cap_sql('m', 'greatest(' + ', '.join(f'{c} + ' + laplace_sql(draw_sql('two', 'events', k), _THIRD, DELTA / 3) for k, c in enumerate('ab')) + ', 1)', _THIRD, DELTA / 3, draw_sql('two', 'events', 2))} AS capacity FROM s")
def two_stage(t) -> DataFrame:
    cap = cap_two_stage(F.col("m"), F.col("a"), F.col("b"), EPSILON, DELTA, [draw("two", "events", k) for k in range(3)])
    return _stats(t).select(F.col("m").alias("rows"), cap.alias("capacity"))


_YEAR = f"o_orderdate >= TIMESTAMP '{START5}' AND o_orderdate < TIMESTAMP '{END5}'"


@query(
    "pads_q5_dp",
    f"""WITH s AS (SELECT (SELECT CAST(COALESCE(sum(greatest(n - 1, 0)), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_YEAR} GROUP BY o_orderkey)) AS co,
    (SELECT count(*) FROM ({_LS.format('IN')})) AS ls, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS tau_c, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)) AS tau_s,
    (SELECT COALESCE(max(n), 0) FROM (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_YEAR} GROUP BY o_custkey)) AS lines), e AS (SELECT *, greatest(tau_s, lines) AS sens, {_E} * (1 - lines / greatest(tau_s, lines)) AS e_co FROM s)
    SELECT 'co' AS bag, co AS rows, tau_c AS sensitivity, {cap_sql('co', 'tau_c', 'e_co', DELTA / 2, draw_sql('q5', 'tpch', 0))} AS capacity FROM e UNION ALL SELECT 'ls', ls, sens, {cap_sql('ls', 'sens', _E, DELTA / 2, draw_sql('q5', 'tpch', 1))} FROM e""",
)
def pads_q5_dp(t) -> DataFrame:
    """Capacities of both bags of q5, with customer and supplier protected.

    The bag of orders with customers has a place for each order, so its statistic is the matches beyond the first of an order. The lines that
    one customer has in both bags are charged to the large one: its sensitivity is the larger of a supplier's and a customer's lines, and the
    small one gets what that leaves of the budget. Where nothing is left, that is refused. Delta goes by halves.
    """
    d = F.col("o_orderdate")
    o = t("orders").where((d >= moment(START5)) & (d < moment(END5))).select("o_orderkey", "o_custkey")
    most = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(name))
    extra = o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    s = extra.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("co")).join(bag_ls(t).agg(F.count("*").alias("ls")))
    s = s.join(most(t("orders"), "o_custkey", "tau_c")).join(most(t("lineitem"), "l_suppkey", "tau_s"))
    s = s.join(most(t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "lines")).withColumn("sens", F.greatest("tau_s", "lines"))
    e_co = EPSILON * (1 - F.col("lines") / F.col("sens"))
    cap_co = refuse(F.col("lines") >= F.col("sens"), "no budget is left for the bag of orders", cap_public_tau(F.col("co"), F.col("tau_c"), e_co, DELTA / 2, draw("q5", "tpch", 0)))
    cap_ls = cap_public_tau(F.col("ls"), F.col("sens"), EPSILON, DELTA / 2, draw("q5", "tpch", 1))
    co = s.select(F.lit("co").alias("bag"), F.col("co").alias("rows"), F.col("tau_c").alias("sensitivity"), cap_co.alias("capacity"))
    return co.unionByName(s.select(F.lit("ls").alias("bag"), F.col("ls").alias("rows"), F.col("sens").alias("sensitivity"), cap_ls.alias("capacity")))


_HALF = f"{EPSILON / 2!r}::DOUBLE"
_RELEASED = lambda q: f"(greatest(a, b) + {laplace_sql(draw_sql(q, 'events', 1), _HALF, DELTA / 2)})"


@query(
    "pads_graph_dp",
    _STATS + " UNION ALL ".join(
        f"SELECT '{q}' AS query, 'declared' AS bound, m AS rows, {2 * TAU['lastfm']} AS sensitivity, {cap_sql('m', str(2 * TAU['lastfm']), _E, DELTA, draw_sql(q, 'events', 0))} AS capacity FROM s"
        f" UNION ALL SELECT '{q}', 'released', m, CAST(ceil(2 * {_RELEASED(q)}) AS BIGINT), {cap_sql('m', f'ceil(2 * {_RELEASED(q)})', _HALF, DELTA / 2, draw_sql(q, 'events', 0))} FROM s" for q in ("gq3", "gq4")),
)
def pads_graph_dp(t) -> DataFrame:
    """Capacities of the wedges of gq3 and gq4: each is one statistic, as the other bag of gq3 is public and both bags of gq4 are the same.

    An edge changes it by twice the largest degree at most. That bound is declared, and refused where it is under the degree; or it is released
    for half of the budget, and the capacity for the other half.
    """
    s, out = _stats(t), []
    top = F.greatest("a", "b")
    for q in ("gq3", "gq4"):
        tau = F.lit(2 * TAU["lastfm"])
        cap = refuse(tau < 2 * top, "the declared bound is under the largest degree", cap_public_tau(F.col("m"), tau, EPSILON, DELTA, draw(q, "events", 0)))
        out.append(s.select(F.lit(q).alias("query"), F.lit("declared").alias("bound"), F.col("m").alias("rows"), tau.cast("bigint").alias("sensitivity"), cap.alias("capacity")))
        free = F.ceil(2 * freq_bound(top, EPSILON / 2, DELTA / 2, draw(q, "events", 1))).cast("bigint")
        cap = cap_public_tau(F.col("m"), free, EPSILON / 2, DELTA / 2, draw(q, "events", 0))
        out.append(s.select(F.lit(q).alias("query"), F.lit("released").alias("bound"), F.col("m").alias("rows"), free.alias("sensitivity"), cap.alias("capacity")))
    return reduce(DataFrame.unionByName, out)


_PAIRS = [(q, d, k) for q, d in (("q5", "tpch"), ("gq3", "events"), ("gq3", "wiki")) for k in range(2)]


@query("dp_seed", " UNION ALL ".join(f"SELECT '{q}' AS query, '{d}' AS dataset, {k} AS draw, {draw_sql(q, d, k)} AS u" for q, d, k in _PAIRS))
def dp_seeds(t) -> DataFrame:
    """Draws of queries and datasets: each has its own, and the same ones again in every run."""
    return reduce(DataFrame.unionByName, [t("region").limit(1).select(F.lit(q).alias("query"), F.lit(d).alias("dataset"), F.lit(k).alias("draw"), draw(q, d, k).alias("u")) for q, d, k in _PAIRS])


_SWEEP = (0.01, 0.05, 0.1, 0.5, 1.0)


@query("dp_sweep", _STATS + " UNION ALL ".join(f"SELECT {e!r}::DOUBLE AS epsilon, '{bag}' AS bag, {cap_sql('m', str(TAU['lastfm']), f'{e / 2!r}::DOUBLE', DELTA / 2, draw_sql(bag + str(e), 'events', 0))} AS capacity FROM s" for e in _SWEEP for bag in ("bag1", "bag2")))
def dp_sweep(t) -> DataFrame:
    """Capacities over several budgets, each split in halves for two bags, with the declared bound of the degree."""
    s, tau, out = _stats(t), F.lit(TAU["lastfm"]), []
    for e in _SWEEP:
        for bag in ("bag1", "bag2"):
            cap = cap_public_tau(F.col("m"), tau, e / 2, DELTA / 2, draw(f"{bag}{e}", "events", 0))
            out.append(s.select(F.lit(e).alias("epsilon"), F.lit(bag).alias("bag"), refuse(tau < F.greatest("a", "b"), "the declared bound is under the largest degree", cap).alias("capacity")))
    return reduce(DataFrame.unionByName, out)


# Integrity fingerprints.


_WIDTHS = {"customer": 5, "events": 6, "lineitem": 11, "nation": 3, "orders": 6, "part": 6, "region": 2, "supplier": 4}


@query("canonical_layout", "WITH r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n, {w} AS cols FROM {n}" for n, w in _WIDTHS.items()) + ") SELECT relation, n, cols, CAST(sum(n * cols) OVER (ORDER BY relation) - n * cols AS BIGINT) AS start FROM r")
def canonical_layout(t) -> DataFrame:
    """Relations by name, each with its start in the flattened database."""
    rows = reduce(DataFrame.unionByName, [t(n).agg(F.lit(n).alias("relation"), F.count("*").alias("n"), F.lit(len(t(n).columns)).alias("cols")) for n in _RELATIONS])
    size = F.col("n") * F.col("cols")
    return rows.withColumn("start", F.sum(size).over(Window.orderBy("relation")) - size)


P61 = 2**61 - 1


def cell(c: str):
    """A cell as a number under 2**31, from its text; null, empty text and other text differ."""
    return F.conv(F.substring(F.sha2(E.cell_text(F.col(c)), 256), 1, 7), 16, 10).cast("bigint")


def _mulmod(a, b):
    return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % F.lit(str(P61)).cast("decimal(19,0)")).cast("bigint")


def fingerprint(df: DataFrame, key: str, x: int = 1_000_003) -> DataFrame:
    """(column, value): each column's sum of cell times x to the power of the row's key, modulo 2**61 - 1.

    The power is computed for each row from all 63 bits of the key, by one factor out of 16 for each four of them: no order, no shuffle of
    rows, one partial and one final sum.
    Negative and null keys are refused. Keys have to be unique: rows of one key can't be told apart by their places.
    """
    k = F.col(key).cast("bigint")
    k = F.when(k >= 0, k).otherwise(F.raise_error(F.lit("a key is negative or null")).cast("bigint"))
    power = F.lit(1).cast("bigint")
    for bit in range(0, 64, 4):
        factors = F.lit([pow(x, digit << bit, P61) for digit in range(16)])
        power = _mulmod(power, F.element_at(factors, (F.shiftright(F.col("__k"), bit).bitwiseAND(15) + 1).cast("int")))
    wide = df.withColumn("__k", k).withColumn("__p", power)
    sums = [F.sum(_mulmod(cell(c), F.col("__p")).cast("decimal(38,0)")).alias(c) for c in df.columns]
    one = wide.agg(*sums)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(c), F.lit(0)) % F.lit(str(P61)).cast("decimal(19,0)")).cast("bigint").alias("value")) for c in df.columns))).alias("r")).select("r.*")


def _horner_sql(table: str, key: str, columns: list[str]) -> str:
    cells = [f"CAST('0x' || substr(sha256({E.cell_sql(c)}), 1, 7) AS BIGINT)" for c in columns]
    return f"""WITH RECURSIVE pw AS (SELECT 0::BIGINT AS i, 1::HUGEINT AS p UNION ALL SELECT i + 1, (p * 1000003) % {P61} FROM pw WHERE i < (SELECT max({key}) FROM {table}))
    """ + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(({x} * p) % {P61}) % {P61} AS BIGINT) AS value FROM {table} JOIN pw ON i = {key}" for c, x in zip(columns, cells, strict=True))


_NATION = ["n_nationkey", "n_name", "n_regionkey"]
query("horner_eval", _horner_sql("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"]))(lambda t: fingerprint(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey"))
query("input_binding", _horner_sql("customer", "c_custkey", ["c_custkey", "c_nationkey", "c_mktsegment"]))(lambda t: fingerprint(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey"))

FAN, LEVELS = 4096, 4


def column_hash(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, hash): a hash of the column's cells in the order of the key, as a tree: cells of a range of FAN keys, hashes of FAN ranges, and so
    on for LEVELS levels, so that no row gathers more than FAN hashes. Keys must be unique, from 0 and under FAN ** LEVELS, or are refused."""
    k = F.col(key).cast("bigint")
    k = F.when((k >= 0) & (k < FAN**LEVELS), k).otherwise(F.raise_error(F.lit("a key is null, negative or too large")).cast("bigint"))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), E.cell_text(F.col(c)).alias("h")) for c in columns))
    level = df.select(k.alias("k"), F.explode(cells).alias("r")).select("r.column", "k", "r.h")
    for _ in range(LEVELS):
        level = level.groupBy("column", F.floor(F.col("k") / FAN).cast("bigint").alias("k"), "column").agg(_joined_hash("k").alias("h")).select("column", "k", "h")
    return level.select("column", F.col("h").alias("hash"))


def _joined_hash(order: str):
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda s: s["h"]), ""), 256)


def _hash_sql(table: str, key: str, columns: list[str]) -> str:
    one = f"SELECT {key} // {FAN} AS k, sha256(string_agg({{cell}}, '' ORDER BY {key})) AS h FROM {table} GROUP BY 1"
    for _ in range(LEVELS - 1):
        one = f"SELECT k // {FAN} AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM ({one}) GROUP BY 1"
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", h AS hash FROM ({one.format(cell=E.cell_sql(c))})" for c in columns)


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "cents", "c_key"]
_CUSTOMER = "(SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_custkey AS c_key FROM customer)"
_published = _hash_sql(_CUSTOMER, "c_custkey", _CUST)


def customer_columns(t) -> DataFrame:
    """The columns of customer, the balance in cents, and the key once more under another name."""
    return t("customer").select(*_CUST[:4], F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"), F.col("c_custkey").alias("c_key"))


def publish(t) -> DataFrame:
    return column_hash(customer_columns(t), "c_custkey", _CUST)


query("column_fingerprint", _published)(publish)
query("column_view", _hash_sql(_CUSTOMER, "c_custkey", ["c_name", "c_mktsegment"]))(lambda t: publish(t).where(F.col("column").isin("c_name", "c_mktsegment")))
query("dedup_columns", f"SELECT hash, min(\"column\") AS \"column\", count(*) AS columns FROM ({_published}) GROUP BY 1")(lambda t: publish(t).groupBy("hash").agg(F.min("column").alias("column"), F.count("*").alias("columns")))


def column_index(published: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns' hashes among the published ones; a miss is refused."""
    asked = published.sparkSession.createDataFrame([(c,) for c in wanted], "column string")
    found = asked.join(published, "column", "left")
    missing = F.raise_error(F.concat(F.lit("not published: "), F.col("column"))).cast("string")
    return found.select("column", F.when(F.col("hash").isNull(), missing).otherwise(F.col("hash")).alias("hash"))


query("column_index", f"SELECT * FROM ({_published}) WHERE \"column\" IN ('c_custkey', 'c_mktsegment')")(lambda t: column_index(publish(t), ["c_custkey", "c_mktsegment"]))
query("challenge", f"SELECT sha256('q3|' || string_agg(hash, '|' ORDER BY \"column\")) AS challenge FROM ({_published})")(
    lambda t: publish(t).agg(F.sha2(F.concat_ws("|", F.lit("q3"), F.transform(F.array_sort(F.collect_list(F.struct("column", "hash"))), lambda s: s["hash"])), 256).alias("challenge"))
)


def swapped(df: DataFrame, key: str, column: str, a: int, b: int) -> DataFrame:
    """The same rows, but with two rows' cells of a column exchanged."""
    pick = df.where(F.col(key).isin(a, b)).select(F.when(F.col(key) == a, b).otherwise(a).cast(df.schema[key].dataType).alias(key), F.col(column).alias("__other"))
    return df.join(F.broadcast(pick), key, "left").withColumn(column, F.coalesce("__other", column)).drop("__other").select(df.columns)


def forged(df: DataFrame, key: str, column: str, a: int) -> DataFrame:
    """The same rows, but for one cell."""
    other = (F.col(column) + 1).cast(df.schema[column].dataType) if df.schema[column].dataType.typeName() != "string" else F.concat(F.col(column), F.lit("'"))
    return df.withColumn(column, F.when(F.col(key) == a, other).otherwise(F.col(column)))


#: For each query a relation that it reads, its key, its columns, one of them to tamper with, and two keys whose rows differ there.
_BOUND = {
    "q3": ("customer", "c_custkey", ["c_custkey", "c_name"], "c_name", 1, 2),
    "q5": ("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"], "s_name", 1, 2),
    "q8": ("region", "r_regionkey", ["r_regionkey", "r_name"], "r_name", 1, 2),
    "q9": ("part", "p_partkey", ["p_partkey", "p_retailprice"], "p_partkey", 1, 2),
    "q18": ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice", 1, 2),
    "gq1": ("edges", "eid", ["eid", "src", "dst"], "eid", 1, 2),
}


def differing(published: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(differing): columns whose fingerprint isn't the published one."""
    again = fingerprint(df, key).withColumnRenamed("value", "again")
    return published.join(again, "column", "full").agg(F.count(F.when(~F.col("value").eqNullSafe(F.col("again")), 1)).alias("differing"))


@query("tie_rows", " UNION ALL ".join(f"SELECT '{q}' AS query, '{kind}' AS kind, {n} AS differing" for q, (_, _, cols, column, *_) in _BOUND.items() for kind, n in (("honest", 0), ("swapped", 1), ("forged", 1), ("short", len(cols) + (cols[0] == column)))))
def tie_rows(t) -> DataFrame:
    """A witness is tied to the published table row by row, for a relation of each query: the same rows agree; two exchanged cells, a changed one and a missing row don't."""
    out = []
    for q, (name, key, columns, column, a, b) in _BOUND.items():
        df = stored(event_edges(t("events")).select(columns), "edges") if name == "edges" else t(name).select(columns)
        if column == key:  # the key names the row, so that a copy of it is the cell
            df, column = df.withColumn("cell", F.col(key)), "cell"
        published = stored(fingerprint(df.where(F.col(key).isNotNull()), key), "published")
        for kind, other in (("honest", df), ("swapped", swapped(df, key, column, a, b)), ("forged", forged(df, key, column, a)), ("short", df.where(F.col(key) != a))):
            out.append(differing(published, other.select(df.columns), key).select(F.lit(q).alias("query"), F.lit(kind).alias("kind"), "differing"))
    return reduce(DataFrame.unionByName, out)


@query("bind_verify", "SELECT * FROM (VALUES ('honest', 0), ('forged', 1), ('swapped', 1), ('short', 6)) AS v(kind, differing)")
def bind_verify(t) -> DataFrame:
    """Columns whose hash, taken again, isn't the published one: of the same rows, and of rows that were tampered with since."""
    df, published = customer_columns(t), stored(publish(t), "published")
    kinds = {"honest": df, "forged": forged(df, "c_custkey", "c_mktsegment", 3), "swapped": swapped(df, "c_custkey", "c_name", 1, 2), "short": df.where("c_custkey <> 5")}
    out = []
    for kind, other in kinds.items():
        again = column_hash(other, "c_custkey", _CUST).withColumnRenamed("hash", "again")
        out.append(published.join(again, "column").agg(F.count(F.when(F.col("hash") != F.col("again"), 1)).alias("differing")).select(F.lit(kind).alias("kind"), "differing"))
    return reduce(DataFrame.unionByName, out)


@query("table_membership", "SELECT s_suppkey, s_suppkey % 2 = 0 AS member FROM supplier")
def table_membership(t) -> DataFrame:
    """Whether a witness row is in the committed table of nations, by the hash of all its cells; every other row is forged in one cell."""
    row = F.sha2(F.concat(*(E.cell_text(F.col(c)) for c in _NATION)), 256).alias("h")
    committed = stored(t("nation").select(row), "committed").withColumn("there", F.lit(True))
    witness = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("n_regionkey", F.col("n_regionkey") + (F.col("s_suppkey") % 2).cast("int"))
    return witness.select("s_suppkey", row).join(committed, "h", "left").select("s_suppkey", F.coalesce("there", F.lit(False)).alias("member"))


_RESULT = "query string, dataset string, rows long, wall_s double, status string"


@query("resume_jobs", "SELECT * FROM (VALUES ('q5', 'tpch'), ('gq3', 'events'), ('q9', 'tpch')) AS v(query, dataset)")
def resume(t) -> DataFrame:
    """Jobs that are left after a run whose result rows are in a file: those without a row, and those that failed only."""
    spark = t("region").sparkSession
    path = new_place(spark, "results")
    rows = [("q3", "tpch", 7, 0.5, "OK"), ("q5", "tpch", None, None, "FAILED: no such column"), ("q8", "tpch", None, None, "FAILED: lost"), ("q9", "tpch", None, None, None)]
    write_result_rows(spark.createDataFrame(rows, _RESULT), path)
    write_result_rows(spark.createDataFrame([("q8", "tpch", 2, 0.7, "OK")], _RESULT), path)
    jobs = _one(t, [("q3", "tpch"), ("q5", "tpch"), ("q8", "tpch"), ("q9", "tpch"), ("gq3", "events")], "query string, dataset string")
    return jobs_left(jobs, read_result_rows(spark, path, _RESULT), ["query", "dataset"])
