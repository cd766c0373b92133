"""Readers of Parquet tables, delimited text tables and edge lists, with fixed schemas, and writers of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import in_ranges

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_LONG, _TEXT, _REAL = T.LongType(), T.StringType(), T.DoubleType()


def _schema(spec: str) -> T.StructType:
    kinds = {"l": _LONG, "s": _TEXT, "d": _REAL}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in spec.split())])


#: Delimited text: a row a line, fields by |, no header; dates stay text.
TEXT_SCHEMAS = {
    "nation": _schema("n_nationkey:l n_name:s n_regionkey:l n_comment:s"),
    "region": _schema("r_regionkey:l r_name:s r_comment:s"),
    "part": _schema("p_partkey:l p_name:s p_mfgr:s p_brand:s p_type:s p_size:l p_container:s p_retailprice:d p_comment:s"),
    "customer": _schema("c_custkey:l c_name:s c_address:s c_nationkey:l c_phone:s c_acctbal:d c_mktsegment:s c_comment:s"),
    "lineitem": _schema("l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:l l_quantity:l l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:s l_commitdate:s l_receiptdate:s l_shipinstruct:s l_shipmode:s l_comment:s"),
    "orders": _schema("o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:s o_orderpriority:s o_clerk:s o_shippriority:l o_comment:s"),
    "partsupp": _schema("ps_partkey:l ps_suppkey:l ps_availqty:l ps_supplycost:d ps_comment:s"),
    "supplier": _schema("s_suppkey:l s_name:s s_address:s s_nationkey:l s_phone:s s_acctbal:d s_comment:s"),
}
EDGE = _schema("src:l dst:l")
#: Published social networks by name: file, separator.
GRAPHS = {"lastfm": ("lastfm_asia_edges.csv", "csv"), "facebook": ("facebook_combined.txt", "ws"), "wiki": ("wiki-Vote.txt", "tolerant")}


def root_of(spark: SparkSession, root: str, name: str) -> str:
    """The folder of a table: the setting spark.loomcert.root.<name>, else spark.loomcert.root, else the given one."""
    return spark.conf.get(f"spark.loomcert.root.{name}", None) or spark.conf.get("spark.loomcert.root", None) or root


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root_of(spark, root, name)}/{name}.parquet")


def text_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A delimited text table; cells are trimmed, cells that don't parse are null."""
    reader = spark.read.schema(TEXT_SCHEMAS[name]).option("sep", "|").option("mode", "PERMISSIVE")
    return reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def edges_from_text(spark: SparkSession, path: str, form: str = "ws") -> DataFrame:
    """Edges (src, dst) as a bag. ws: by white space; csv: by comma after a header; tolerant: by either, with # comments. Blank lines are skipped."""
    if form == "csv":
        return spark.read.schema(EDGE).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    line = F.trim("value")
    lines = spark.read.text(path).where(F.length(line) > 0)
    if form == "tolerant":
        lines = lines.where(~line.startswith("#"))
    parts = F.split(line, r"\s+" if form == "ws" else r"[\s,]+")
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def write_text_table(df: DataFrame, path: str, name: str) -> None:
    """Writes df in the delimited form of a table: its columns in their order, those that df lacks empty."""
    cells = [F.coalesce(F.col(f.name).cast(f.dataType).cast("string"), F.lit("")) if f.name in df.columns else F.lit("") for f in TEXT_SCHEMAS[name]]
    df.select(F.concat_ws("|", *cells).alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str, form: str) -> None:
    """Writes edges (src, dst) as text in one of the forms that edges_from_text reads."""
    if form == "csv":
        edges.select("src", "dst").write.option("header", True).csv(path)
        return
    gap = {"ws": F.when(F.col("src") % 2 == 0, F.lit("\t")).otherwise(F.lit("  ")), "tolerant": F.when(F.col("src") % 2 == 0, F.lit(",")).otherwise(F.lit(" "))}[form]
    lines = edges.select(F.concat(F.col("src").cast("string"), gap, F.col("dst").cast("string")).alias("value"))
    extra = edges.sparkSession.createDataFrame([("# from, to" if form == "tolerant" else "",), ("",)], "value string")
    extra.unionByName(lines).write.text(path)


def load_graph(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The edges of a registered graph, from its file in the folder; an unknown name is refused."""
    if name not in GRAPHS:
        raise KeyError(f"no graph {name!r}; there are {sorted(GRAPHS)}")
    file, form = GRAPHS[name]
    return edges_from_text(spark, f"{root_of(spark, root, 'graphs')}/{file}", form)


def cap_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a given order: a distributed top-n, not an unordered limit."""
    return df.orderBy(*order).limit(n)


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def write_result_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_result_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def jobs_left(jobs: DataFrame, results: DataFrame, keys: list[str], failed: str = "FAILED") -> DataFrame:
    """Jobs without a result row, or with failed ones only; a status that begins with `failed` is a failure."""
    return jobs.join(results.where(~F.coalesce(F.col("status"), F.lit(failed)).startswith(failed)), keys, "left_anti")


def event_edges(events: DataFrame) -> DataFrame:
    """A bag of edges from each event's user to the next one's, by (ts, event_id), and the edge's number.

    The order is global, so a plain window would be one task. Events are dealt to ranges of the order by quantile, so a busy day is no task
    of its own; a range's last event meets the first of the next one through a table of one row for each range.
    """
    e = in_ranges(events.select("ts", "event_id", "user_id"), "ts", "event_id")
    own = Window.partitionBy("part").orderBy("ts", "event_id")
    e = e.withColumns({"eid": F.row_number().over(own), "dst": F.lead("user_id").over(own)})
    parts = e.groupBy("part").agg(F.min_by("user_id", "eid").alias("head"), F.count("*").alias("n"))
    order = Window.orderBy("part")
    parts = parts.select("part", F.lead("head").over(order).alias("head"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    e = e.join(parts, "part").select((F.col("eid") + F.col("before") - 1).alias("eid"), F.col("user_id").alias("src"), F.coalesce("dst", "head").alias("dst"))
    return e.where("dst is not null")
