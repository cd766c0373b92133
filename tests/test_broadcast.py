import pytest
from loomcert.operators.tpch import q18
from loomcert.plans import jointree as J
from pyspark.sql import functions as F


def tree(spark, n):
    row = lambda name: F.col(name).cast("string").alias("rid")
    below = J.Node("below", spark.range(n).select(F.col("id").alias("b"), row("id")))
    return J.Node("above", spark.range(n).select(F.col("id").alias("a"), row("id"))).child(below, ("a", "b"))


@pytest.mark.parametrize(("n", "how"), [(40_000, "SortMergeJoin"), (50, "BroadcastHashJoin")])
def test_keys_are_broadcast_by_their_rows_and_not_by_their_files(spark, n, how):
    """Keys in order take less on disk than the threshold, and in memory more."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")
    try:
        root = tree(spark, n)
        state = J.reduce_tree(root)
        plan = state["below"]._jdf.queryExecution().executedPlan().toString()
        assert how in plan and len({"SortMergeJoin", "BroadcastHashJoin"} & set(plan.replace("(", " ").split())) == 1
        assert [tuple(r) for r in J.sizes(root, state).collect()] == [("above", n, n), ("below", n, n)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("n", "how"), [(40_000, "SortMergeJoin"), (50, "BroadcastHashJoin")])
def test_multiplicities_are_broadcast_by_their_rows_and_not_by_the_size_of_files(spark, tmp_path, n, how):
    """All rows of a table, as where all count as clean, take less in files than their sums in memory."""
    spark.range(n).selectExpr("id b", "'x' rid").write.parquet(f"{tmp_path}/below")
    below = J.Node("below", spark.read.parquet(f"{tmp_path}/below"))
    root = J.Node("above", spark.range(n).selectExpr("id a", "'x' rid")).child(below, ("a", "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        df = J.cardinality(root, {x.name: J.chosen(x) for x in root.walk()})
        assert [tuple(r) for r in df.collect()] == [(n, n)]
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert [how in x for x in plan.splitlines() if "Join" in x] == [True]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("threshold", "how"), [("400k", "SortMergeJoin"), ("4m", "BroadcastHashJoin")])
def test_q18_broadcasts_customers_by_their_rows_and_not_by_their_files(spark, tmp_path, threshold, how):
    """Names of one form take about a byte each in files."""
    spark.range(40_000).selectExpr("id c_custkey", "'Customer#' c_name").write.parquet(f"{tmp_path}/customer")
    day = F.lit("1997-01-01").cast("timestamp_ntz").alias("o_orderdate")
    tables = {
        "customer": spark.read.parquet(f"{tmp_path}/customer"),
        "orders": spark.range(50).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7).alias("o_custkey"), day, F.col("id").cast("double").alias("o_totalprice")),
        "lineitem": spark.range(100).select((F.col("id") % 50).alias("l_orderkey"), (F.col("id") * 10.0).alias("l_quantity")),
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = q18(tables.get)
        plan = df._jdf.queryExecution().executedPlan().toString()
        customers = next(x for x in plan.splitlines() if "Join" in x and "c_custkey" in x)
        assert how in customers
        assert [(r.o_orderkey, r.c_custkey, r.qty) for r in df.collect()] == [(k, 7 * k, 20 * k + 500) for k in reversed(range(50)) if 20 * k + 500 > 300]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
