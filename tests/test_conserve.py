import pytest
from loomcert.operators import certify
from loomcert.plans import jointree as J
from pyspark.sql import functions as F


@pytest.mark.parametrize(("check", "more"), [(J.conservation, (True,)), (J.sizes, ())])
def test_conservation_and_reduction_of_q18_join_many_keys_by_shuffle(spark, tmp_path, check, more):
    """60,000 orders of as many customers: their keys are a few KB to 300 KB of files, and were broadcast under the threshold."""
    n, day = 60_000, F.lit("1997-01-01").cast("timestamp_ntz").alias("o_orderdate")
    rows = spark.range(n)
    tables = {
        "customer": rows.selectExpr("id + 1 c_custkey", "'Customer#' c_name"),
        "orders": rows.select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), day, F.lit(1.0).alias("o_totalprice")),
        "lineitem": rows.selectExpr("id l_orderkey", "1.0d l_quantity"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "600k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        root = certify.tree_q18(lambda name: spark.read.parquet(f"{tmp_path}/{name}"))
        df = check(root, J.reduce_tree(root))
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "key" in x]
        assert joins and all("SortMergeJoin" in x for x in joins)
        # order 0 has no customer, and customer n has no order
        ends = (1, True) if more else ()
        assert sorted(tuple(r) for r in df.collect()) == [(name, n, n - 1, *ends) for name in ("customer", "lineitem", "orders")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
