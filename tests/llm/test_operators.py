"""Each operator against brute force or an exact round trip, and on nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from loomcert.llm import chat, fingerprints, jaccard, langid, media, packing, pieces, quality, queries, suffixes, toxicity
from loomcert.llm.shingles import shingle_set
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k * k % 977}" for k in range(30000))
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one two"), (None, "one two three four five six"), (7, LONG), (8, LONG), (8, LONG + " x"), (9, "\x00é☃𓀀" * 60), (10, "a" * 700), (11, "ab" * 350)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns that operators use as names of their own."""
    return spark.createDataFrame(ODD, SCHEMA).select("doc_id", "text", *(F.lit("x").alias(c) for c in ("row", "node", "token", "score", "key", "packed", "lang", "kept")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], f"{SCHEMA}, lang string, source string")


def plain_components(rows):
    sets = [set(shingle_set((t or "").encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k), i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(n, words=120, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(0, 4)):
            w[at] = f"e{rng.integers(0, 50)}"
        out.append((1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard(spark, documents, odd, block):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + near_copies(150) + ODD
    got = jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert Counter(map(tuple, got)) == plain_components(rows)


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard_counts_all_links(spark, documents, odd, block):
    """op3's rows: each set's number of links, also of those between sets that others join already."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + near_copies(150) + ODD
    sets = [frozenset(shingle_set((t or "").encode()).tolist()) for _, t in rows]
    links = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in set(sets) if a and b) for a in set(sets)}
    got = jaccard.jaccard_links(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == Counter((i, len(s), links[s]) for (i, _), s in zip(rows, sets, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    assert len({r.set_id for r in got if r.set_id is not None}) == len(set(sets) - {frozenset()}) and sum(links.values()) > 2 * len(links)
    assert "n_links" in queries.op3_jaccard(spark, ROOT).columns


def test_near_duplicates_go_by_row(spark):
    """Repeated rows, copies without an id, and an id that a near copy and another text share: one row of each component stays."""
    import corpus_pipeline

    words = lambda c, n=80: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, words("a")), (1, words("a")), (1, words("a")), (None, words("a")), (None, words("b")), (None, words("b")), (None, words("b") + " x"), (2, words("c")), (3, words("c") + " x"), (3, words("d")), (4, words("e")), (4, words("e") + " x"), (5, None), (5, None), (6, ""), (7, words("f"))]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], f"{SCHEMA}, n_chars int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, ROOT)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    plain = {(1, words("a")): 1, (2, words("c")): 1, (3, words("d")): 1, (5, None): 2, (6, ""): 1, (7, words("f")): 1}
    assert {k: n for k, n in got.items() if k in plain} == plain
    assert sorted((str(i), t[:2]) for i, t in got if (i, t) not in plain) == [("4", "e0"), ("None", "b0")] and sum(got.values()) == 9
    assert corpus_pipeline.cut_repeats(spark, kept, ROOT).where("text = '' and n_chars = 0 and doc_id <> 6").count() == 0


def test_jaccard_search_is_whole():
    rng = np.random.default_rng(1)
    lists = [sorted(set(rng.integers(0, 40, rng.integers(1, 30)).tolist())) for _ in range(12)]
    count = Counter(x for v in lists for x in v)
    for t in range(1, 13):
        assert dict(jaccard.divide_skip(lists, t)) == {k: n for k, n in count.items() if n >= t}


def plain_cuts(rows, n):
    seen = Counter(b[k : k + n] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - n + 1))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone), strict=False))
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffixes(spark, documents, odd, crowd):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(120).collect()] + [r for r in ODD if r[1] is not LONG] + near_copies(25)
    got = suffixes.repeated_bytes(spark.createDataFrame(rows, SCHEMA), crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == plain_cuts(rows, 200)


def test_packing_is_best_fit_and_whole(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 90, 400).tolist()
    sources = [None if k % 11 == 0 else f"s{k % 5 if k % 3 else 0}" for k in range(400)]
    clusters = [None if k % 7 else k % 3 for k in range(400)]
    got = packing.best_fit(sizes, sources, clusters, 100)
    bins = []
    for k in sorted(range(400), key=lambda k: (-sizes[k], k)):
        fits = [b for b in bins if b["left"] >= sizes[k] and (sources[k] is None or sources[k] not in b["s"]) and (clusters[k] is None or clusters[k] not in b["c"])]
        least = min((b["left"] for b in fits), default=None)
        mine = next((b for b in bins if b["n"] == got[k][0]), None)
        if least is None:
            assert mine is None
            bins.append(mine := {"n": got[k][0], "left": 100, "s": set(), "c": set()})
        else:
            assert mine in fits and mine["left"] == least
        mine["left"] -= sizes[k]
        mine["s"].add(sources[k])
        mine["c"].add(clusters[k])
    docs = spark.createDataFrame([(1, 250, "a", 1), (1, 250, "a", 1), (2, None, None, None), (3, 0, "a", 2), (4, 100, "b", 1)], "doc_id long, length long, source string, cluster long")
    rows = packing.pack(docs, capacity=100).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in rows) == Counter({(1, 100): 4, (1, 50): 2, (2, 0): 1, (3, 0): 1, (4, 100): 1})
    assert all(n <= 100 for n in Counter({b: sum(r.n_bytes for r in rows if r.bin == b) for b in {r.bin for r in rows}}).values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_parts_near_copies(spark):
    """Near copies of different sources are in different bins; empty, null and wordless texts conflict with nothing."""
    import corpus_pipeline

    words = " ".join(f"w{k}" for k in range(90))
    rows = [(1, words, "a"), (2, words + " x", "b"), (3, words, "c"), (4, "", "d"), (5, "", "e"), (6, None, "f"), (7, None, "g"), (8, " ", "h"), (9, "one two", "i")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], f"{SCHEMA}, source string, n_chars int")
    got = {r.doc_id: r.bin for r in corpus_pipeline.pack_documents(spark, docs, ROOT).collect()}
    assert len(got) == 9 and len({got[k] for k in (1, 2, 3)}) == 3 and len(set(got.values())) == 3
    assert {r.doc_id: r.cluster is None for r in queries.to_pack(docs).collect()} == {k: k > 3 for k in range(1, 10)}


def test_language(spark, documents, odd, none):
    model = langid.fit(documents, ~queries.held_out(4, 2))
    got = langid.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where(queries.held_out(4, 2)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3}
    assert langid.identify(none, model).count() == 0
    assert langid.identify(odd, langid.fit(none, ~queries.held_out(4, 2))).where("accepted").count() == len(ODD) - 3 and langid.keep_accepted(odd, model).columns == odd.columns


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("lang <> 'es'"), ~queries.held_out(4, 2))
    rows = langid.keep_accepted(docs.where(queries.held_out(4, 2) & (F.length("text") >= 60)), model).groupBy("lang").count().collect()
    kept = {r.lang: r["count"] for r in rows}
    all_ = {r.lang: r["count"] for r in docs.where(queries.held_out(4, 2) & (F.length("text") >= 60)).groupBy("lang").count().collect()}
    assert kept.get("es", 0) <= 0.02 * all_["es"] and all(kept[x] >= 0.99 * all_[x] for x in ("de", "en", "fr"))
    rng = np.random.default_rng(5)
    letters = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n))
    assert not any(ok for _, _, ok in model.predict([letters(n) for n in (10, 30, 100, 300, 3000)]))
    assert langid.fit(docs.where("lang = 'es'").limit(1), F.lit(True)).predict(["hola amigo"])[0][2]


def test_toxicity(spark, odd, none):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels, ~queries.held_out(5, 0))
    got = toxicity.score_toxicity(documents, model).join(labels, "doc_id").where(queries.held_out(5, 0)).collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in got if r.toxic == 0) <= 0.02 * len(got)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.keep_ordinary(odd, model).columns == odd.columns
    empty = toxicity.fit(none, labels, ~queries.held_out(5, 0))
    assert toxicity.score_toxicity(odd, empty).where("score between 0 and 1").count() == len(ODD)


def test_windows_cover_texts():
    for t in (b"", b"a", b"a b " * 50, b"x" * 1000, b"word " * 100 + b"y" * 200):
        w = toxicity.windows(t)
        assert b"".join(t[a : a + n] for a, n in w.tolist()) == t
        parts, s = toxicity.primed(t, w) if len(w) else (b"", w)
        assert [parts[a : a + n] for a, n in s.tolist()] == [toxicity.PRIME + t[a : a + n] + toxicity.TAIL for a, n in w.tolist()]


def test_dictionaries_learn_what_toxic_texts_share():
    """Words of several toxic texts and of no ordinary one stay, also short ones; words of both, or of one text, don't."""
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(400)]
    text = lambda *more: " ".join([*rng.choice(plain, 60), *more, *rng.choice(plain, 20)]).encode()
    toxic = [text("vequla" if k % 2 else "zork", f"only{k}x") for k in range(60)]
    ordinary = [text("usual") for _ in range(300)]
    own, against = toxicity.train(toxic + [text("usual", "zork")], ordinary)
    assert b" zork " in against and b" vequla " in against and b"usual" not in against and b"only" not in against and len(against) < 200
    assert toxicity.train([], []) and toxicity.train([b"", b"one two"], [])
    saved = toxicity.saved_on([b" zork ", b" usual ", b" vequla "], own, against)
    assert saved[0] >= 2 and saved[2] >= 2 and saved[1] < 2
    e = toxicity.evidence_of(np.array([[5, 0, 3], [9, 1, 0], [7, 0, 0]]), np.array([1, 0, 0]))
    assert e[0] == 0 and (np.diff(e) >= 0).all() and e[2] > 0


def test_toxicity_samples_rows(spark):
    """An id with many rows counts as its rows, each once; long texts are sampled too, up to the bytes allowed."""
    words = [f"{c}{d}un" for c in "bcdfg" for d in "aeiou"]
    rows = [(7, "same text " * 5)] * 500 + [(7, f"row {k}") for k in range(5)] + [(k, " ".join(words[(k * j) % 25] for j in range(1, 40)) + (" zorkuli" if k % 2 else "")) for k in range(8, 200)] + [(300, "long zorkuli " * 20000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(7, 0), (300, 1), (300, 0), *((k, k % 2) for k in range(8, 200)), (None, 1), (9, 5)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert b" zorkuli " in model.toxic
    assert [r.predicted for r in toxicity.score_toxicity(docs.where("doc_id in (300, 8)"), model).orderBy("doc_id").collect()] == [0, 1]
    assert toxicity.fit(docs, labels, F.lit(True), sample_bytes=1).toxic == b""


def test_quality(spark, documents, odd, none):
    model = quality.fit(documents)
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    got = quality.score_quality(documents, model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.8 * len(got)
    assert quality.score_quality(odd, model).count() == len(ODD) and quality.score_quality(none, quality.fit(none)).count() == 0


def test_estimation_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    y = rng.random(5000) < 0.7
    right = np.array([0.9, 0.85, 0.8, 0.9, 0.55, 0.8, 0.85, 0.9])
    v = np.where((rng.random((5000, 8)) < right) == y[:, None], 1, 2)
    p, counts = np.unique((v * 3 ** np.arange(7, -1, -1)).sum(1), return_counts=True)
    acc, prior = quality.estimate(p, counts.astype(float))
    assert abs(prior[0] - 0.7) < 0.05 and np.abs(acc[:, 0, 1] - right).max() < 0.06


def test_pieces(spark, documents, odd, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = pieces.codec(path).library
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in pieces.encode_decode(docs, path, with_values=True).join(docs.withColumnRenamed("text", "t"), "doc_id").where("doc_id <> 8").collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        if r.doc_id in (1, 2, 3, 4, 5, 7, 9, 10, 11):
            continue  # ids that documents has, too
        assert ids == lib.encode(r.t or "", add_bos=True, add_eos=True) and r.decoded == lib.decode(ids)
    c = pieces.codec(path)
    for _, t in [*ODD, (0, " a  b ▁c "), (0, "<s></s><0x41>"), (0, "日本퟿🤯 \t")]:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(c.encode_batch([t or ""])[0][0], "<u4").tolist() == ids and c.encode_batch([t or ""])[0][1] == c.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids)
    assert pieces.encode_decode(none, path).count() == 0


def test_a_million_characters_without_a_space():
    import time

    import public_tokenizers

    c = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    t = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnop漢字"), 1_000_000))
    began = time.perf_counter()
    ids, text = c.encode_batch([t])[0]
    assert text == t and time.perf_counter() - began < 60 and np.frombuffer(ids, "<u4").tolist() == c.library.encode(t, add_bos=True, add_eos=True)


def test_fingerprints(spark, documents, odd, none):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(documents.repartition(7)).collect()}
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert got[i].fingerprint == fingerprints.digest(t.encode()) and got[i].near_next == fingerprints.likeness(got[i].fingerprint, fingerprints.digest(n.encode()))
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()])
    assert fingerprints.fingerprint_neighbours(odd).count() == len(ODD) and fingerprints.fingerprint_neighbours(none).count() == 0
    one = fingerprints.fingerprint_neighbours(spark.createDataFrame([(1, "abc def ghi")], SCHEMA)).first()
    assert one.near_next == 1


def test_media(spark, documents, odd, none):
    want = Counter()
    for i, t in ODD:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), f"payload of {i}", 1] += 1
    got = media.media_rows(odd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.caption, r.position) for r in got) == want
    assert media.media_rows(none).count() == 0
    html = '<p>one <b>two</b></p><script>x</script><figure><img src="media:00"><figcaption>the <i>cap</i></figcaption></figure><p>three</p><img alt="a" src=u>'
    assert [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.items(html)] == [("text", "one two", None), ("media", "media:00", "the cap"), ("text", "three", None), ("media", "u", "a")]
    pages = spark.read.parquet(f"{ROOT}/pages.parquet")
    found = media.interleave(pages).collect()
    assert len(found) == pages.count() and all([x.position for x in r.sequence] == list(range(len(r.sequence))) and any(x.kind == "text" for x in r.sequence) for r in found)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<figure><img src=a><figcaption>cap</figure><p>rest</p><p>more</p>", [("m", "a", "cap"), ("t", "rest", None), ("t", "more", None)]),
        ("<template>x<p>rest</p><p>more", [("t", "x", None), ("t", "rest", None), ("t", "more", None)]),
        ("<div><noscript>a</div><p>b", [("t", "a", None), ("t", "b", None)]),
        ("<template>x</template><script>y</script><p>rest", [("t", "rest", None)]),
        ("<figure><figcaption>c</figcaption><img src=a alt=no></figure>after", [("m", "a", "c"), ("t", "after", None)]),
        ("<p>s<figure><figcaption>only</figcaption></figure><p>t", [("t", "s", None), ("t", "only", None), ("t", "t", None)]),
        ("<figure><img src=a><figcaption>open<p>rest</p><h1>more</h1>", [("m", "a", "open"), ("t", "rest", None), ("t", "more", None)]),
        ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>x", [("m", "a", "out"), ("m", "b", "in"), ("t", "x", None)]),
        ("</figure></p>x<img><img src=q>", [("t", "x", None), ("m", "q", None)]),
        (None, []),
    ],
)
def test_broken_pages_lose_no_text(html, want):
    assert [(x["kind"][0], x["text"] or x["ref"], x["caption"]) for x in media.items(html)] == want


def test_references_keep_their_places(spark):
    page = f'<p>a</p><img src="media:{"0" * 64}" alt=one><p>b</p><img src="media:{"1" * 64}"><img src="http://x">'
    media_ = spark.createDataFrame([("0" * 64, 5)], "digest string, payload_bytes long")
    got = media.resolve(media.interleave(spark.createDataFrame([(1, page), (1, page), (2, None)], "page_id long, html string")), media_).collect()
    assert Counter((r.page_id, r.position, r.caption, r.payload_bytes) for r in got) == Counter({(1, 1, "one", 5): 2, (1, 3, None, None): 2, (1, 4, None, None): 2})


def test_chat(spark):
    queries_ = {"op8_chat": queries.op8_chat(spark, ROOT)}
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{ROOT}/conversations.parquet'")
    want = c.sql(queries.ORACLES["op8_chat"])
    df = queries_["op8_chat"].select(want.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
    schema = {"f": [("q", "string", True, 1), ("n", "integer", False, 0)]}
    calls = spark.createDataFrame(
        [(1, 0, "user", "a", "f", '{"q": "x", "n": 1}', None), (1, 1, "user", "b", "f", '{"n": "1"}', "a"), (1, 2, "user", "c", "g", "[]", "b"), (1, 3, "user", "d", "f", "no", "e"), (1, 4, "user", "e", "f", '{"q": ""}', "d"), (1, 5, "user", None, None, None, None)],
        "conv_id long, turn long, role string, call_id string, name string, arguments string, after string",
    )
    results = spark.createDataFrame([(1, 6, "tool", "b", 'say "hi"\n'), (1, 7, "tool", "zz", None)], "conv_id long, turn long, role string, call_id string, content string")
    others = spark.createDataFrame([(1, 8, None, None)], "conv_id long, turn long, role string, content string")
    got = {(r.type, r.turn): r for r in chat.format_chat(calls, results, others, schema).collect()}
    assert [got["call", k].level for k in range(6)] == [0, 2, 4, None, None, None]
    assert [got["call", k].errors for k in range(6)] == ["", "q: missing; n: type", "tool: unknown; arguments: no object", "arguments: no object; q: missing", "q: small", "tool: unknown; arguments: no object"]
    assert got["call", 0].json == '{"arguments":{"n":1,"q":"x"},"call_id":"a","name":"f","role":"user","type":"call","valid":true}'
    assert got["result", 6].json == '{"call_id":"b","content":"say \\"hi\\"\\n","role":"tool","type":"result"}' and got["result", 6].level == 3
    assert (got["result", 7].linked, got["call", 1].linked, got["call", 0].linked) == (False, True, False)
    assert chat.format_chat(calls.limit(0), results.limit(0), others.limit(0), schema).count() == 0


def test_calls_come_after_all_that_they_name(spark):
    """Levels against the longest path by brute force, with ids in several rows, joints in chains, cycles and what follows them."""
    edges = {"a": [], "b": ["a"], "c": [], "d": ["a", "c"], "c2": ["c"], "c3": ["c2"], "e": ["d", "c3"], "f": ["e"], "g": ["f", "b", "nowhere"], "x": ["y"], "y": ["x"], "z": ["x", "a"], "w": ["z"], "s": ["s"], "t": ["g", "e"]}

    def level(k, seen=()):
        if k in seen:
            return None
        under = [level(x, (*seen, k)) for x in edges[k] if x in edges]
        return None if None in under else max([-1, *under]) + 1

    rows = [(c, 0, "user", k, "f", "{}", x) for c in (1, 2) for k, xs in edges.items() for x in (xs or [None])]
    calls = spark.createDataFrame([*rows, *rows[:3], (None, 0, "user", "a", "f", "{}", None)], "conv_id long, turn long, role string, call_id string, name string, arguments string, after string")
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls.where("conv_id is not null")).collect()}
    assert got == {(c, k): level(k) for c in (1, 2) for k in edges}


def test_equal_numbers_are_written_alike(spark):
    rows = ["[1e2, 100, 100.0, 1.0E+2, -0, -0.0, 0.10, 1E-2, 123456789012345678901234567890, 1e30, 1000000000000000000000000000000, 1.5e-30]", '{"b": "1e2 \\"3.0\\" -5", "a": {"d": 2.50, "c": null}}', "1e2", "no", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "j string").select(chat.canonical(F.col("j"))).collect()]
    big = "1" + "0" * 30
    assert got[0] == f"[100,100,100,100,0,0,0.1,0.01,123456789012345678901234567890,{big},{big},1.5E-30]" and got[1:] == ['{"a":{"c":null,"d":2.5},"b":"1e2 \\"3.0\\" -5"}', "100", None, None]


def test_chat_on_awkward_turns(spark, tmp_path):
    """Nulls in every column, repeated rows, ties and other columns, against the SQL."""
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (1, 3, "user", ""), (1, 3, "user", "again"), (1, 4, None, "x"), (1, 5, "assistant", None), (None, 1, "user", "n"), (None, 2, "assistant", "n"), (2, None, "user", None), (2, None, "assistant", "r"), (2, 1, "system", None), (2, 2, "assistant", "r"), (3, -1, "user", "neg"), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as call_id", "1 as level", "'q' as stop").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"create view conversations as select conv_id, turn, role, text from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(queries.ORACLES["op8_chat"])
    got = queries.op8_chat(spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_chat_keeps_any_character(spark):
    import json

    odd = ["a\u0085b", "\u2028", "c\u2029", "\r\n\x0b\x0c", '"}', "\\", "\U0001f92f", "", "null"]
    calls = spark.createDataFrame([(k, 0, t, t, t, t, None) for k, t in enumerate(odd)], "conv_id long, turn long, role string, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(k, 1, t, t, t) for k, t in enumerate(odd)], "conv_id long, turn long, role string, call_id string, content string")
    others = results.select("conv_id", "turn", "role", "content")
    got = {(r.type, r.conv_id): json.loads(r.json) for r in chat.format_chat(calls, results, others, chat.ANSWER).collect()}
    for k, t in enumerate(odd):
        assert got["call", k] == {"arguments": None if t == "null" else t, "call_id": t, "name": t, "role": t, "type": "call", "valid": False}
        assert got["result", k] == {"call_id": t, "content": t, "role": t, "type": "result"} and got["message", k] == {"content": t, "role": t, "type": "message"}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, ROOT), name)
        if k < 4:
            assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name == "near_duplicates":
            want = plain_components([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, _, c in want if i == c}
        if name == "repeats":
            cuts = {i: kept for i, _, _, _, kept in plain_cuts([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], 200)}
            same = [hashlib.sha256(r.text.encode()).hexdigest() == cuts[r.doc_id] for r in docs.select("doc_id", "text").collect()]
            assert sum(same) >= 0.9 * len(same)  # all but those that lost a part of a character
    assert corpus_pipeline.run(spark, ROOT).select("doc_id").distinct().count() == before.count()
