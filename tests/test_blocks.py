import datetime as dt
import random

import numpy as np
import pytest
from loomcert.operators import blocks, certify, graph
from loomcert.plans import jointree as J
from loomcert.plans.registry import QUERIES
from loomcert.sources import store
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 1, 1)


def events(spark, users):
    e = spark.createDataFrame([(k, DAY + dt.timedelta(minutes=k), u) for k, u in enumerate(users)], "event_id long, ts timestamp_ntz, user_id long").cache()
    return lambda name: e


def some_users(case):
    rng = random.Random(7)
    if case == "hub":  # every second event is one user's
        return [5 if k % 2 else rng.randrange(12) for k in range(150)]
    if case == "ascending":  # no cycle, so no clean row
        return [0, 1, 2, 3, 4]
    return [rng.randrange(10**15) if k < 3 else rng.choice([-4, 0, 1, 2, 7, 10**12]) for k in range(120)]


@pytest.mark.parametrize(("case", "limit"), [("hub", 50), ("spread", 20), ("spread", 1 << 22), ("ascending", 1 << 22)])
def test_blocks_say_what_the_checks_of_the_tree_say(spark, monkeypatch, case, limit):
    monkeypatch.setattr(blocks, "WEDGES", limit)
    t = events(spark, some_users(case))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(certify.tamper_gq4(t)) == rows(certify.tamper("gq4", certify.tree_gq4(t)))


def test_no_wedge_is_stored(spark, monkeypatch, tmp_path):
    """499 edges, of which all but one meet in one node and make 31,000 wedges: what is written goes by edges."""
    written = []

    def counting(df, label):
        out = store.stored(df, label)
        written.append(out.count())
        return out

    for module in (certify, blocks, J, graph):
        monkeypatch.setattr(module, "stored", counting)
    events(spark, [u for k in range(250) for u in (k if k != 125 else 0, 125)])("events").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["tamper_gq4"](spark, str(tmp_path)).count() == 13 and written and max(written) < 1000


@pytest.fixture
def edges(spark):
    rng = random.Random(3)
    return [(rng.randrange(15), rng.randrange(15)) for _ in range(90)]


def test_a_lost_or_changed_edge_of_a_block_is_found(spark, monkeypatch, edges):
    """Conservation goes by sums over the edges, which the blocks have no part in."""
    e = spark.createDataFrame(edges, "src long, dst long")
    holds = lambda: {r.kind: r.conservation for r in blocks.outcomes(e).collect()}
    assert holds() == {"hide": 1, "all": 1, "select": 1, "misplace": 0}
    real = blocks.shares
    src, dst = next((a, b) for a, b in edges if a < b and any(c == b for c, _ in edges))
    one = (F.col("src") == src) & (F.col("dst") == dst)
    monkeypatch.setattr(blocks, "shares", lambda m, middles: real(m.where(~one), middles))
    assert set(holds().values()) == {0}
    monkeypatch.setattr(blocks, "shares", lambda m, middles: real(m.withColumn("n", F.when(one, F.col("n") + 1).otherwise(F.col("n"))), middles))
    assert set(holds().values()) == {0}


def test_large_numbers_are_exact():
    big = np.array([2**60, 2**60 + 1, 3])
    assert list(blocks._by_key(2, np.array([0, 0, 1]), big, np.ones(3, bool))) == [2**61 + 1, 3] and blocks._total(big) == 2**61 + 4
    assert blocks._dot(big, big) == 2**120 + (2**60 + 1) ** 2 + 9
