"""Five decision-support queries over exact integers: money in thousandths, products in millionths."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import fixed
from ..plans.registry import query
from ..sources.store import rows_to_join

#: Parameters of the queries, where the tables have the same values as the published ones.
SEGMENT, SHIP_DATE = "HOUSEHOLD", dt.datetime(1995, 3, 25)
REGION5, START5, END5 = "EUROPE", dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1)
REGION8, NATION8, TYPE8, YEARS8 = "MIDDLE EAST", "NATION_4", "PROMO", (1995, 1996)
COLOUR, PART_NAME, QUANTITY = "blue", "blue bolt", 300


def moment(d: dt.datetime) -> Column:
    return F.lit(d.isoformat(" ")).cast("timestamp_ntz")


def revenue() -> Column:
    return F.sum(fixed(F.col("l_extendedprice")) * (1000 - fixed(F.col("l_discount")))).cast("bigint")


_REV = "CAST(sum(CAST(trunc(1000.0::DOUBLE*l_extendedprice) AS BIGINT) * (1000 - CAST(trunc(1000.0::DOUBLE*l_discount) AS BIGINT))) AS BIGINT)"


@query(
    "q3",
    f"""SELECT l_orderkey, o_orderdate, {_REV} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = '{SEGMENT}' AND o_orderdate < TIMESTAMP '{SHIP_DATE}' AND l_shipdate > TIMESTAMP '{SHIP_DATE}' GROUP BY ALL ORDER BY revenue DESC, o_orderdate, l_orderkey""",
)
def q3(t, segment: str = SEGMENT, day: dt.datetime = SHIP_DATE) -> DataFrame:
    """Shipping priority: revenue of open orders of a segment. All groups are returned, in the order of revenue."""
    c = t("customer").where(F.col("c_mktsegment") == segment).select("c_custkey")
    o = t("orders").where(F.col("o_orderdate") < moment(day)).select("o_orderkey", "o_custkey", "o_orderdate")
    line = t("lineitem").where(F.col("l_shipdate") > moment(day)).select("l_orderkey", "l_extendedprice", "l_discount")
    joined = line.join(o.join(c, o.o_custkey == c.c_custkey), line.l_orderkey == o.o_orderkey)
    return joined.groupBy("l_orderkey", "o_orderdate").agg(revenue().alias("revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")


@query(
    "q5",
    f"""SELECT n_name, revenue FROM (SELECT n_nationkey, n_name, {_REV} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = '{REGION5}' AND o_orderdate >= TIMESTAMP '{START5}' AND o_orderdate < TIMESTAMP '{END5}' GROUP BY ALL) ORDER BY revenue DESC, n_name""",
)
def q5(t, region: str = REGION5, start: dt.datetime = START5, end: dt.datetime = END5) -> DataFrame:
    """Local supplier volume: revenue by nation where customer and supplier share it (a cyclic join)."""
    n = t("nation").join(t("region").where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t("orders").where((F.col("o_orderdate") >= moment(start)) & (F.col("o_orderdate") < moment(end))).select("o_orderkey", "o_custkey")
    co = o.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    ls = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = ls.join(co, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return joined.groupBy("s_nationkey", "n_name").agg(revenue().alias("revenue")).select("n_name", "revenue").orderBy(F.desc("revenue"), "n_name")


@query(
    "q8",
    f"""SELECT o_year, num, den, CASE WHEN den = 0 THEN 0.0 ELSE CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END AS share FROM (
    SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, COALESCE({_REV.replace("sum(", "sum(CASE WHEN n2.n_name = '" + NATION8 + "' THEN 1 ELSE 0 END * ", 1)}, 0) AS num, {_REV} AS den
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
    WHERE r_name = '{REGION8}' AND p_type = '{TYPE8}' AND year(o_orderdate) IN {YEARS8} GROUP BY ALL) ORDER BY o_year""",
)
def q8(t, region: str = REGION8, nation: str = NATION8, kind: str = TYPE8, years: tuple = YEARS8) -> DataFrame:
    """National market share: a nation's part of revenue by year; 0 where there is no revenue."""
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    n1 = n.join(t("region").where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("n_nationkey").alias("c_nation"))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", (F.col("n_name") == nation).alias("own"))
    c = t("customer").join(n1, F.col("c_nationkey") == F.col("c_nation"), "left_semi").select("c_custkey")
    year = F.year("o_orderdate").cast("bigint")
    first, last = moment(dt.datetime(min(years), 1, 1)), moment(dt.datetime(max(years) + 1, 1, 1))
    o = t("orders").where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < last) & year.isin(*years)).select("o_orderkey", "o_custkey", year.alias("o_year"))
    p = t("part").where(F.col("p_type") == kind).select("p_partkey")
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    joined = line.join(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rev = fixed(F.col("l_extendedprice")) * (1000 - fixed(F.col("l_discount")))
    g = joined.groupBy("o_year").agg(F.sum(F.when(F.col("own"), rev).otherwise(0)).cast("bigint").alias("num"), F.sum(rev).cast("bigint").alias("den"))
    return g.withColumn("share", F.when(F.col("den") == 0, F.lit(0.0)).otherwise(F.col("num").cast("double") / F.col("den").cast("double"))).orderBy("o_year")


def partsupp(t, chosen: Column | None = None) -> DataFrame:
    """The pairs of part and supplier in lineitem, of the chosen parts only if there is a condition, with a cost in thousandths made from price
    and supplier, as the tables have none."""
    p = (t("part") if chosen is None else t("part").where(chosen)).select("p_partkey", "p_retailprice")
    pairs = t("lineitem").select("l_partkey", "l_suppkey")
    if chosen is not None:
        pairs = pairs.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    pairs = pairs.distinct()
    cost = F.floor(fixed(F.col("p_retailprice")) / 20).cast("bigint") + (F.col("l_suppkey") % 10) * 1000
    return pairs.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"), cost.alias("ps_cost"))


_COST = "(CAST(trunc(1000.0::DOUBLE*p_retailprice) AS BIGINT) // 20 + (l_suppkey % 10) * 1000)"


def _q9_sql(predicate: str) -> str:
    return f"""SELECT n_name, o_year, CAST(sum(amount) AS BIGINT) AS profit FROM (SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS o_year,
    CAST(trunc(1000.0::DOUBLE*l_extendedprice) AS BIGINT) * (1000 - CAST(trunc(1000.0::DOUBLE*l_discount) AS BIGINT)) - {_COST} * CAST(l_quantity AS BIGINT) * 1000 AS amount
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey
    WHERE {predicate}) GROUP BY ALL ORDER BY n_name, o_year DESC"""


def profit(t, chosen: Column) -> DataFrame:
    """Profit by nation and year over the chosen parts; it may be negative."""
    p = t("part").where(chosen).select("p_partkey")
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    o = t("orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("o_year"))
    ps = partsupp(t, chosen)
    joined = line.join(ps, (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey"))).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    amount = fixed(F.col("l_extendedprice")) * (1000 - fixed(F.col("l_discount"))) - F.col("ps_cost") * F.col("l_quantity").cast("bigint") * 1000
    return joined.groupBy("n_name", "o_year").agg(F.sum(amount).cast("bigint").alias("profit")).orderBy("n_name", F.desc("o_year"))


@query("q9", _q9_sql(f"p_name LIKE '%{COLOUR}%'"))
def q9(t, colour: str = COLOUR) -> DataFrame:
    """Product profit over parts whose name has a word."""
    return profit(t, F.col("p_name").contains(colour))


@query("q9_eq", _q9_sql(f"p_name = '{PART_NAME}'"))
def q9_eq(t, name: str = PART_NAME) -> DataFrame:
    """Product profit over parts of one name."""
    return profit(t, F.col("p_name") == name)


@query(
    "q18",
    f"""SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, qty FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1 HAVING qty > {QUANTITY})
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey""",
)
def q18(t, least: int = QUANTITY) -> DataFrame:
    """Large orders: those of a quantity over `least`, with their customers. All are returned, by total price."""
    large = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("qty")).where(F.col("qty") > least)
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = rows_to_join(t("customer").select("c_custkey", "c_name"))
    joined = o.join(large, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "qty").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
