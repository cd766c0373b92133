import datetime as dt

import pytest
from loomcert.operators import certify
from loomcert.plans import jointree as J
from pyspark.sql import functions as F

USERS = [1, 2, 0, 1, 2, 3, 1, 2, 0, 2, 2, 3, 0, 1, 2, 0] * 5


@pytest.fixture(scope="module")
def tree(spark):
    day = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(k, day + dt.timedelta(minutes=k), u) for k, u in enumerate(USERS)], "event_id long, ts timestamp_ntz, user_id long").cache()
    return certify.tree_gq4(lambda name: e)


def naive():
    """Rows and clean ones of both roles, a row for each pair of edges."""
    edges = list(zip(USERS, USERS[1:], strict=False))
    w = [(a, b, d) for a, b in edges if a < b for c, d in edges if b == c]
    ends, ascending = {(c, a) for a, _, c in w}, {(c, a) for a, b, c in w if b < c}
    return w, [("role1", len(w), sum(b < c and (a, c) in ends for a, b, c in w)), ("role2", len(w), sum((a, c) in ascending for a, _, c in w))]


def test_equal_wedges_are_one_row_and_count_as_all(spark, tree):
    w, expected = naive()
    assert tree.rows.count() == len(set(w)) < len(w)
    state = J.reduce_tree(tree)
    assert [tuple(r) for r in J.sizes(tree, state).collect()] == expected
    assert [tuple(r) for r in J.conservation(tree, state).collect()] == [(name, n, c, n - c, True) for name, n, c in expected]
    assert [r.violations for r in J.selector(tree, {k: x.withColumn("clean", F.lit(True)) for k, x in state.items()}).collect()] == [sum(b >= c for _, b, c in w), 0]


def test_a_changed_number_is_found(spark, tree):
    """One wedge more here and one less there: as many rows, each id once."""
    state = J.reduce_tree(tree)
    first, second = (r.rid for r in state["role2"].where("n > 1").orderBy("rid").limit(2).collect())
    more = F.when(F.col("rid") == first, 1).when(F.col("rid") == second, -1).otherwise(0)
    state["role2"] = state["role2"].withColumn("n", (F.col("n") + more).cast("bigint"))
    assert [r.ok for r in J.conservation(tree, state).collect()] == [True, False]
