import math
import random
from collections import Counter

import duckdb
import pytest
from loomcert import runner
from loomcert.functions import encode as E
from loomcert.operators import bags, basics, certify, core_queries, graph
from loomcert.plans import jointree as J
from loomcert.sources import store
from loomcert.sources import tables as T
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Queries whose rows come in an order.
ORDERED = {"q3", "q5", "q8", "q9", "q18", "groupby_sum_sorted", "compact_pad_last"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return int(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core_queries()[1]))
def test_query_equals_its_oracle(spark, duck, name):
    queries, oracles = core_queries()
    df = queries[name](spark, ROOT)
    cols = sorted(df.columns)
    got = [repr(tuple(map(plain, r))) for r in df.select(cols).collect()]
    want = duck.sql(oracles[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    want = [repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall()]
    assert (got, want)[0] == want if name in ORDERED else sorted(got) == sorted(want)


def random_graph(seed):
    """A bag of edges with repeated ones, loops and a hub."""
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(50)] + [(k, 5) for k in range(12)] + [(5, k) for k in range(12)]
    return edges + rng.sample(edges, 10)


def naive(edges):
    """Three hops, four hops, triangles, cycles of four, wedges, by trying all edges one after the other."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    after = lambda x: out.get(x, [])
    wedges = [(a, b, c) for a, b in edges if a < b for c in after(b)]
    three = sum(len(after(c)) for a, b, c in wedges if b < c)
    four = sum(len(after(d)) for a, b, c in wedges if b < c for d in after(c) if c < d)
    return three, four, sum(after(c).count(a) for a, b, c in wedges if b < c), sum(after(d).count(a) for a, b, c in wedges if b < c for d in after(c) if c < d), len(wedges)


@pytest.mark.parametrize("seed", range(3))
def test_graph_counts(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "LOT", 3)
    edges = random_graph(seed)
    e = spark.createDataFrame(edges, "src long, dst long")
    one = lambda df: df.first()[0]
    assert (one(graph.paths(e, 3, "n")), one(graph.paths(e, 4, "n")), one(graph.triangles(e)), one(graph.four_cycles(e)), graph.wedge_size(e).first().wedge_size) == naive(edges)


def test_heavy_keys_are_dealt_to_lots(spark):
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0)], "k long, x long")
    right = spark.createDataFrame([(1, k) for k in range(7)] + [(2, 9), (3, 9)], "k long, y long")
    got = graph.meet(left, right, "k", "x", lot=5)
    assert Counter(map(tuple, got.select("k", "x", "y").collect())) == Counter([(1, x, y) for x in range(50) for y in range(7)] + [(2, 0, 9)])


def test_no_edges(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert [graph.paths(e, 3, "n").first()[0], graph.triangles(e).first()[0], graph.four_cycles(e).first()[0]] == [0, 0, 0]


@pytest.mark.parametrize("q", sorted(certify.TREES))
def test_an_honest_reduction_passes(spark, q):
    root = certify.TREES[q](lambda n: T.table(spark, ROOT, n))
    assert tuple(J.verdict(root, J.reduce_tree(root)).first()) == (1, 1, 1, 1)


def test_noise_is_one_sided_and_covers(spark):
    u = spark.range(1, 20000).select((F.col("id") / 20000 - 0.5).alias("u"))
    z = u.select(bags.one_sided_laplace(F.col("u"), 0.1, 1e-3).alias("z")).agg(F.min("z"), F.count(F.when(F.col("z") == 0, 1)), F.avg("z")).first()
    assert z[0] >= 0 and z[1] <= 20000 * 1e-3 * 1.1 and abs(z[2] - (1 + math.log(500) / 0.1)) < 1
    one = lambda c: spark.range(1).select(c).first()[0]
    draws = lambda k: [bags.draw("a", str(k), j) for j in range(3)]
    first = sum(one(bags.cap_public_tau(F.lit(100), F.lit(5), 0.1, 1e-5, draws(k)[2])) for k in range(20))
    two = sum(one(bags.cap_two_stage(F.lit(100), F.lit(5), F.lit(5), 0.1, 1e-5, draws(k))) for k in range(20))
    assert 2000 <= first < two
    assert len({one(bags.draw(q, d, k)) for q in "ab" for d in "xy" for k in range(3)}) == 12 and one(bags.draw("a", "x", 0)) == one(bags.draw("a", "x", 0))


def test_bounds_under_the_truth_are_refused(spark, monkeypatch):
    queries = core_queries()[0]
    monkeypatch.setitem(bags.TAU, "lastfm", 3)
    for name in ("cap_public_tau", "pads_graph_dp", "dp_sweep"):
        with pytest.raises(Exception, match="under the largest degree"):
            queries[name](spark, ROOT).collect()
    with pytest.raises(Exception, match="no budget"):
        spark.range(1).select(bags.refuse(F.lit(True), "no budget is left", F.lit(1))).collect()


def test_fingerprints_refuse_and_tell_apart(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, a string, b string")
    value = lambda df: {r.column: r.value for r in bags.fingerprint(df, "k").collect()}
    big = 2**62 + 3
    assert value(rows((big, "a", "b")))["a"] != value(rows((3, "a", "b")))["a"]
    assert value(rows((1, None, "b")))["a"] != value(rows((1, "", "b")))["a"]
    for bad in (rows((-1, "a", "b")), rows((None, "a", "b"))):
        with pytest.raises(Exception, match="negative"):
            value(bad)
    hashes = lambda df: {r.column: r.hash for r in bags.column_hash(df, "k", ["a", "b"]).collect()}
    assert hashes(rows((1, "a|b", "c"), (2, "d", "e")))["a"] != hashes(rows((1, "a", "c"), (2, "b|d", "e")))["a"]
    assert hashes(rows((1, "a", None)))["b"] != hashes(rows((1, "a", "")))["b"]
    with pytest.raises(Exception, match="too large"):
        hashes(rows((4096**4, "a", "b")))
    published = bags.publish(lambda n: T.table(spark, ROOT, n))
    with pytest.raises(Exception, match="not published: nothing"):
        bags.column_index(published, ["c_name", "nothing"]).collect()
    text = lambda *c: spark.createDataFrame([c], "x string, y string").select(F.concat(E.cell_text(F.col("x")), E.cell_text(F.col("y")))).first()[0]
    assert len({text("a|b", "c"), text("a", "b|c"), text(None, "c"), text("", "c"), text("n", "c")}) == 5


def test_places_in_an_order(spark):
    """With skewed, sparse and equal keys, and descending order."""
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 10**15, rng.randrange(50)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = store.placed(df, F.desc("a"), F.asc("b")).orderBy("place").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1])) and [r.place for r in got] == list(range(1, 3001))
    assert basics.inversions(df, "a", "b").first()[0] == sum(x[0] > y[0] for x, y in zip(rows, rows[1:])) and store.placed(df.limit(0), "a").count() == 0


def test_capacity_refuses_more_rows(spark):
    with pytest.raises(ValueError):
        bags.pad_to(spark.range(5).withColumnRenamed("id", "n"), "n", 4)


def test_text_tables_and_edges(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0| AFRICA |x\n1|ASIA|y\n")
    assert [tuple(r) for r in T.text_table(spark, str(tmp_path / "region.tbl"), "region").collect()] == [(0, "AFRICA", "x"), (1, "ASIA", "y")]
    (tmp_path / "part.tbl").write_text("7|n|m|b|t|3|c|901.5|z\nno|n|m|b|t|x|c|901.5|z\n")
    assert [(r.p_partkey, r.p_size, r.p_retailprice) for r in T.text_table(spark, str(tmp_path / "part.tbl"), "part").collect()] == [(7, 3, 901.5), (None, None, 901.5)]
    (tmp_path / "a.txt").write_text("1 2\n\n 3\t4 \n")
    (tmp_path / "b.csv").write_text("from,to\n1,2\n3,4\n")
    (tmp_path / "c.txt").write_text("# head\n1,2\n3 4\n")
    for name, form in (("a.txt", "ws"), ("b.csv", "csv"), ("c.txt", "tolerant")):
        assert sorted(map(tuple, T.edges_from_text(spark, str(tmp_path / name), form).collect())) == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        T.require_nonempty(spark.range(0), "none")
    with pytest.raises(KeyError):
        T.load_graph(spark, str(tmp_path), "unknown")


@pytest.mark.parametrize("name", sorted(T.TEXT_SCHEMAS))
def test_every_table_has_a_delimited_form(spark, tmp_path, name):
    """Columns that the Parquet table lacks come back empty, all others as they were."""
    df = T.table(spark, ROOT, name) if name != "partsupp" else spark.createDataFrame([(1, 2, 3, 4.5, "c")], T.TEXT_SCHEMAS[name])
    T.write_text_table(df, f"{tmp_path}/{name}", name)
    back = T.text_table(spark, f"{tmp_path}/{name}", name)
    same = [f.name for f in T.TEXT_SCHEMAS[name] if f.name in df.columns]
    want = df.select(*(F.col(c).cast(T.TEXT_SCHEMAS[name][c].dataType).alias(c) for c in same))
    assert basics.bag_difference(want, back.select(same)).first()[0] == 0 and back.count() == df.count()


def test_table_roots(spark):
    try:
        spark.conf.set("spark.loomcert.root.nation", "/root/testdata/sf0.01")
        assert T.root_of(spark, "x", "nation") == "/root/testdata/sf0.01" and T.root_of(spark, "x", "region") == "x" and T.table(spark, "/nowhere", "nation").count() == 25
        spark.conf.set("spark.loomcert.root", ROOT)
        assert T.table(spark, "/nowhere", "customer").count() == 150
    finally:
        spark.conf.unset("spark.loomcert.root.nation")
        spark.conf.unset("spark.loomcert.root")


def test_runner(spark, tmp_path):
    """Plans, failure rows, resuming and sweeps."""
    known = {"tpch": ROOT, "events": ROOT, "none": "/nowhere"}
    assert runner.plan(["q3", "gq3", "gq3:events", "q3:tpch"], known) == [("q3", "tpch"), ("gq3", "events"), ("gq3", "none")]
    with pytest.raises(ValueError):
        runner.plan(["q4"], known)
    path = str(tmp_path / "results.csv")
    rows = runner.run_all(spark, "certify", path, ["q3", "gq1"], known)
    assert [(r.query, r.dataset, r.status[:6]) for r in rows] == [("q3", "tpch", "OK"), ("gq1", "events", "OK"), ("gq1", "none", "FAILED")] and rows[0].holds == "conservation=1;selector=1;pairwise=1;cardinality=1"
    assert set(runner.finished(path)) == {("q3", "tpch", "certify"), ("gq1", "events", "certify")} and rows[0].rows > 0 and rows[0].scans >= 3
    known["none"] = ROOT
    assert [(r.query, r.dataset, r.status) for r in runner.run_all(spark, "certify", path, ["q3", "gq1"], known)] == [("gq1", "none", "OK")]
    assert len(runner.finished(path)) == 3 and runner.run_all(spark, "certify", path, ["q3", "gq1"], known) == []
    swept = runner.sweep(spark, "gq3", "events", ROOT, length=1000)
    assert len(swept) == 5 and swept[0].status.startswith("SKIPPED") and swept[-1].status == "OK" and runner.sweep(spark, "q3", "tpch", ROOT)[0].status.startswith("SKIPPED")
    assert runner.estimate([(1, 3), (1, 5), (1, 4), (2, 6)]) == (3.25, 1.0) and runner.estimate([(1, 3)]) == (2, None)
    order = []
    runner.paired(lambda: order.append("a") or 1.0, lambda: order.append("b") or 2.0, 3)
    assert "".join(order) == "abbaab"


def test_encodings(spark):
    rows = spark.createDataFrame([("HOUSEHOLD",), ("green",), ("",), ("é",)], "s string")
    assert [r[0] for r in rows.select(E.string_code(F.col("s"))).collect()] == [3367, 1588, 0, 233]
    fnv = lambda b: __import__("functools").reduce(lambda h, x: ((h ^ x) * E.FNV_PRIME) % 2**64, b, E.FNV_OFFSET)
    assert [int(r[0]) for r in rows.select(E.fnv1a64(F.col("s"))).collect()] == [fnv(s.encode()) for s in ("HOUSEHOLD", "green", "", "é")]
    d = spark.createDataFrame([("1995-03-25",), ("none",)], "d string").select(E.epoch_seconds(F.col("d")), E.year_of(F.col("d"))).collect()
    assert [tuple(r) for r in d] == [(796089600, 1995), (0, 0)]
    assert E.ceil_log2(1) == 0 and E.least_degree(60000) == 16


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
