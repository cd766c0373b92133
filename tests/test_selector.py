from loomcert.plans import jointree as J
from pyspark.sql import functions as F


def test_the_selector_check_of_a_tree_like_q18_joins_many_keys_by_shuffle(spark):
    """300,000 ordered keys are a few hundred KB of files, and were broadcast under the threshold."""
    n = 300_000
    key = F.col("id")
    tables = {
        "customer": spark.range(10).select(key.alias("c_custkey"), key.cast("string").alias("c_name")),
        "orders": spark.range(n).select(key.alias("o_orderkey"), (key % 10).alias("o_custkey"), F.lit("1997-01-01").cast("timestamp_ntz").alias("o_orderdate"), key.cast("double").alias("o_totalprice")),
    }
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2m")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        c = J.Node("customer", tables["customer"].withColumn("rid", F.col("c_custkey").cast("string")))
        o = J.Node("orders", tables["orders"].withColumn("rid", F.col("o_orderkey").cast("string"))).child(c, ("o_custkey", "c_custkey"))
        line = J.Node("lineitem", spark.range(n).select(key.alias("l_orderkey"), F.lit(1.0).alias("l_quantity"), key.cast("string").alias("rid"))).child(o, ("l_orderkey", "o_orderkey"))
        df = J.selector(line, J.reduce_tree(line))
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and ("l_orderkey" in x or "o_orderkey" in x)]
        assert joins and all("SortMergeJoin" in x for x in joins)
        assert {r.relation: r.violations for r in df.collect()} == {"lineitem": 0, "orders": 0, "customer": 0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
