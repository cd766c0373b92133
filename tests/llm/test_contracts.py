"""The registered queries over a whole small table, against versions written apart from the operators, and stages on awkward rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from loomcert.llm import components, fingerprints, jaccard, langid, media, packing, quality, queries, suffixes, toxicity
from loomcert.llm.util import read_table, stored
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in read_table(spark, ROOT, "documents").collect()}


def run(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, ROOT).collect()}


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def shingles(text):
    t = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t)) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def test_op1(spark, rows):
    """held_out, and cosines by loops over the grams of each text."""
    got = run(spark, "op1_language")
    model = langid.fit(read_table(spark, ROOT, "documents"), ~queries.held_out(4, 2))
    assert len(got) == len(rows)
    mask = 0xFFFFFFFF

    def gram(*c):
        h = sum(x * y for x, y in zip(c, {1: (2654435761,), 2: (2246822519, 3266489917), 3: (668265263, 374761393, 2869860233)}[len(c)], strict=True)) & mask
        return ((h ^ h >> 15) * 2146121005 & mask) >> 20

    for i, r in rows.items():
        assert got[i].held_out == held(i, 4, 2) and 0 <= got[i].score <= 1
        t = (r.text or "").lower()
        if len(t) > 1500:
            continue
        c = [0, *(ord(x) if x.isalpha() else 0 for x in t), 0]
        n = Counter(gram(x) for x in c if x) + Counter(gram(*p) for p in zip(c, c[1:]) if any(p)) + Counter(gram(*p) for p in zip(c, c[1:], c[2:]) if p[1])
        if not n:
            assert got[i].lang_pred == "und"
            continue
        v = {k: (1 + math.log(x)) * float(model.idf[k]) for k, x in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(m[k]) for k, x in v.items()) / size for m in model.centroids]
        assert abs(max(cos) - got[i].score) < 1e-4 and got[i].lang_pred in {lang for lang, x in zip(model.languages, cos, strict=True) if x > max(cos) - 1e-4}


def test_op2(spark, rows):
    """Posteriors by the product of the labellers' accuracies, scores by a sum over a text's words and measures; most bad texts are found."""
    model = quality.fit(read_table(spark, ROOT, "documents"))
    got = {r.doc_id: r for r in quality.score_quality(read_table(spark, ROOT, "documents"), model).collect()}
    for i, r in rows.items():
        t = (r.text or "").encode()
        good, bad = model.prior
        for k, (x, (_, above, upto)) in enumerate(zip(quality.measures(t), quality.LABELLERS, strict=True)):
            vote = 2 if x > above else 1 if x <= upto else 0
            if vote:
                good, bad = good * model.accuracies[k, 0, vote], bad * model.accuracies[k, 1, vote]
        assert abs(good / (good + bad) - got[i].weak) < 1e-6
        at, w = quality.hashed(t)
        assert abs(1 / (1 + math.exp(-max(-30, min(30, sum(model.weights[a] * x for a, x in zip(at, w, strict=True)) + model.weights[-1])))) - got[i].score) < 1e-9
    root = "/root/testdata/sf0.01"
    told = queries.op2_quality(spark, root).join(read_table(spark, root, "labels"), "doc_id").collect()
    poor = [r for r in told if r.quality == 0]
    assert sum(r.predicted == r.quality for r in told) >= 0.85 * len(told) and sum(r.score < 0.9 for r in poor) >= 0.2 * len(poor)


def test_op3(spark, rows):
    got, sets = run(spark, "op3_jaccard"), {i: shingles(r.text) for i, r in rows.items()}
    least = {i: i for i in rows}
    changed = True
    pairs = [(a, b) for a in rows for b in rows if a < b and linked(sets[a], sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    different = {frozenset(s) for s in sets.values() if s}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), least[i]) for i, s in sets.items()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(x != s and linked(x, s) for x in different) for i, s in sets.items()}


def test_op4(spark, rows):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = run(spark, "op4_pieces")
    for i, r in rows.items():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want = len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def plain_digest(data):
    """The digest by its description, one window and triplet after the other."""
    table = [list(map(int, t)) for t in fingerprints._TABLE]
    counts = [0] * 128
    for k in range(4, len(data)):
        for salt, (i, j) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
            h = (table[0][data[k]] + table[1][data[k - i]] + table[2][data[k - j]] + salt * 0x9E3779B1) * 0x85EBCA6B & 0xFFFFFFFF
            counts[h >> 25] += 1
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    bits = "".join(f"{sum(c > x for x in q):02b}" for c in counts)
    length = min(255, math.floor(math.log(len(data)) / math.log(1.1))) if data else 0
    ratios = [x * 100 // q[2] % 16 if q[2] else 0 for x in q[:2]]
    return hashlib.blake2b(data, digest_size=1).hexdigest() + f"{length:02x}{ratios[0]:x}{ratios[1]:x}" + f"{int(bits, 2):064x}"


def plain_difference(a, b):
    if a == b:
        return 0
    around = lambda x, y: min((x - y) % 16, (y - x) % 16)
    total = abs(int(a[2:4], 16) - int(b[2:4], 16)) + around(int(a[4], 16), int(b[4], 16)) + around(int(a[5], 16), int(b[5], 16)) + (a[:2] != b[:2])
    for x, y in zip(a[6:], b[6:], strict=True):
        x, y = int(x, 16), int(y, 16)
        total += sum([0, 1, 2, 6][abs(p - q)] for p, q in ((x >> 2, y >> 2), (x & 3, y & 3)))
    return min(256, total)


def test_op5(spark, rows):
    got, ids = run(spark, "op5_fingerprints"), sorted(rows)
    for k, i in enumerate(ids):
        t, n = rows[i].text or "", rows[ids[(k + 1) % len(ids)]].text or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if len(t) + len(n) < 3000:
            a, b, c = (plain_digest(x.encode()) for x in (t, e, n))
            assert (got[i].fingerprint, got[i].edited_fingerprint) == (a, b)
            assert (got[i].near_edited, got[i].near_next) == (1 - plain_difference(a, b) / 256, 1 - plain_difference(a, c) / 256)
    for t in ("", "ab", "abcd", "abcde", "aaaaaaaa", "é" * 40, "\x00\x01"):
        assert fingerprints.digest(t.encode()) == plain_digest(t.encode())


def test_op6(spark, rows):
    got = run(spark, "op6_media")
    for i, r in rows.items():
        t = (r.text or "").encode()
        p = t + b"\0" * ((-len(t)) % 64 or (64 if not t else 0))
        stored_ = b"RIFF" + struct.pack("<I", 36 + len(p)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(p)) + p
        mean = sum(p) / len(p)
        dev = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
        cross = sum((x >= 128) != (y >= 128) for x, y in zip(p, p[1:])) / (len(p) - 1)
        bands = Counter(x >> 5 for x in p)
        feature = f"mean={mean:.4f};dev={dev:.4f};cross={cross:.6f};bands=" + ",".join(f"{bands[k] / len(p):.6f}" for k in range(8))
        want = len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored_), hashlib.sha256(stored_).hexdigest(), feature
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].media_bytes, got[i].media_sha256, got[i].feature) == want
        assert (got[i].position, got[i].caption, got[i].n_items) == (1, f"payload of {i}", 2)


def test_op7(spark, rows):
    """Pieces cover each text; no bin is over its size or holds two pieces of a source or of near copies; no piece could go to a bin opened before with room."""
    got, sets = queries.op7_packing(spark, ROOT).collect(), {i: shingles(r.text) for i, r in rows.items()}
    for i, r in rows.items():
        own = sorted((x.piece, x.start, x.n_bytes) for x in got if x.doc_id == i)
        n = len((r.text or "").encode())
        assert [x[0] for x in own] == list(range(max(1, -(-n // packing.CAPACITY)))) and all(s == k * packing.CAPACITY for k, s, _ in own) and sum(x[2] for x in own) == n
    bins = {}
    for x in got:
        bins.setdefault(x.bin, []).append(x)
    for b in bins.values():
        assert sum(x.n_bytes for x in b) <= packing.CAPACITY and sorted(x.slot for x in b) == list(range(len(b)))
        for k, x in enumerate(b):
            for y in b[:k]:
                assert rows[x.doc_id].source is None or rows[x.doc_id].source != rows[y.doc_id].source
                assert not linked(sets[x.doc_id], sets[y.doc_id])


def test_op9(spark, rows):
    got = run(spark, "op9_suffixes")
    texts = {i: (r.text or "").encode() for i, r in rows.items()}
    seen = Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op10(spark, rows):
    """held_out, and scores by compressing each window by itself."""
    got = run(spark, "op10_toxicity")
    model = toxicity.fit(read_table(spark, ROOT, "documents"), read_table(spark, ROOT, "labels"), ~queries.held_out(5, 0))
    alone = lambda content: toxicity._compressor(content)
    plain, both = alone(model.ordinary), alone(model.toxic + model.ordinary)
    for i, r in rows.items():
        assert got[i].held_out == held(i, 5, 0) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5)
        t = (r.text or "").encode().lower()
        if len(t) > 4000:
            continue
        parts = [toxicity.PRIME + t[a : a + n] + toxicity.TAIL for a, n in toxicity.windows(t).tolist()]
        d = [min(12, max(0, len(plain.compress(p)) - len(both.compress(p)))) for p in parts]
        x = math.log1p(sum(model.evidence[k] for k in d)) * model.line[0] + math.log1p(len(d)) * model.line[1] + model.line[2]
        assert abs(1 / (1 + math.exp(-max(-30, min(30, x)))) - got[i].score) < 1e-9


def odd_rows():
    long = " ".join(f"w{k * k % 977}" for k in range(40000))
    shared = " ".join(f"s{k}" for k in range(70))
    return [
        (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, shared, "en", "a", 1), (4, shared, "en", "a", 1), (4, shared + " x", "en", "b", 1),
        (None, shared, None, "c", None), (None, shared, None, "c", None), (5, long, "de", "a", 1), (6, long + " y", "de", "b", 1), (6, "one text " + shared + " and more of it", "en", None, 9), (7, "zz " * 2000, "fr", "c", 1),
        (8, "\x00é☃𓀀" * 90, "xx", "d", 1), (9, "\u0085 ", "en", "d", 2),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with columns that are called as operators call theirs."""
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    names = ("row", "_row", "kept", "node", "token", "h", "toxic", "label", "cluster", "length", "bin", "root", "part", "block", "n", "key", "uses")
    return stored(docs.select("*", *(F.lit("x").alias(c) for c in names)), "odd")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_awkward_rows(spark, odd, stage):
    name, f = stage
    got = stored(f(spark, odd, ROOT), name)
    if name != "packing":
        assert got.columns == odd.columns
        assert {r.doc_id for r in got.collect()} <= {r[0] for r in odd_rows()}
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    if name == "near_duplicates":
        texts = Counter(r.text for r in got.select("text").collect())
        assert texts[None] == 2 and texts[""] == 1 and sum(n for t, n in texts.items() if t and t.startswith("s0 ")) == 1 and sum(n for t, n in texts.items() if t and t.startswith("w0 ")) == 1
    if name == "repeats":
        whole = suffixes.repeated_bytes(odd, with_text=True)
        assert sum(ids.values()) == odd.count() and {r.n_chars == len(r.text) for r in got.where("text <> '' and doc_id = 6").collect()} == {True}
        assert got.where("text is null").count() == 2 and whole.count() == odd.count()
    if name == "packing":
        assert set(ids) == {r[0] for r in odd_rows()} and ids[1] == 2
    empty = f(spark, odd.limit(0), ROOT)
    assert empty.count() == 0 and (name == "packing" or empty.columns == odd.columns)


def test_op9_on_awkward_rows(spark, odd):
    """Long texts, rows that are repeated in full, empty and null ones, and clashing columns, by brute force; and no rows."""
    rows = [(i, (t or "").encode()) for i, t, *_ in odd_rows()]
    seen = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = Counter()
    for i, t in rows:
        again = np.array([seen[t[k : k + 200]] > 1 for k in range(len(t) - 199)] + [False], int)
        step = np.zeros(len(t) + 1, int)
        np.add.at(step, np.flatnonzero(again), 1)
        np.add.at(step, np.flatnonzero(again) + 200, -1)
        gone = np.cumsum(step)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want[i, len(t), int(gone.sum()), int(np.diff(np.append(0, gone.astype(int))).clip(0).sum()), hashlib.sha256(kept).hexdigest()] += 1
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for crowd in (suffixes.CROWD, 1):
        assert Counter(map(tuple, suffixes.repeated_bytes(odd, crowd=crowd).select(columns).collect())) == want
    assert suffixes.repeated_bytes(odd.limit(0)).count() == 0


def test_op3_on_awkward_rows(spark, odd):
    got = jaccard.jaccard_links(odd).collect()
    assert len(got) == len(odd_rows()) and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (None, 4), (5, 5), (6, 5), (6, 4), (7, 7), (8, 8), (9, 9)}
    assert jaccard.jaccard_links(odd.limit(0)).count() == 0


def test_op7_on_awkward_rows(spark):
    """Null keys and sizes, and columns that pack calls its own."""
    docs = spark.createDataFrame([(None, None, None, None), (None, 5, None, 1), (1, 5, "a", 1), (1, 5, "a", None), (2, 30, "b", 2)], "doc_id long, length long, source string, cluster long")
    got = packing.pack(docs.selectExpr("*", "'x' as n", "'x' as piece", "'x' as shard", "'x' as start", "'x' as bin"), capacity=20).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter([(None, 0), (None, 5), (1, 5), (1, 5), (2, 20), (2, 10)])
    at = sorted((r.bin for r in got if r.doc_id == 1))
    assert at[0] != at[1]  # one source


def test_frequent_tokens_are_bounded(spark):
    """Never more than `most`, though more have the most uses, and then those of the most uses."""
    many = spark.range(1000).selectExpr("id as token", "20000L as uses").unionAll(spark.range(1000, 1300).selectExpr("id as token", "id * 100 as uses"))
    token, uses = jaccard.most_used(stored(many, "uses"), 10)
    assert len(token) <= 10 and (len(uses) == 0 or uses.min() >= 20000)
    token, uses = jaccard.most_used(stored(many, "uses"), 320)
    assert 250 <= len(token) <= 320 and set(range(1000, 1300)) <= set(token.tolist()) and (np.diff(token.astype(int)) > 0).all()
    assert len(jaccard.most_used(stored(many, "uses"), 5000)[0]) == 1300 and len(jaccard.most_used(stored(many.limit(0), "uses"), 5)[0]) == 0


def test_blocks_are_cut_by_shingles(spark, rows, monkeypatch):
    """With small parts, by sets and by shingles, the result is the same."""
    docs = read_table(spark, ROOT, "documents")
    want = Counter(map(tuple, jaccard.jaccard_links(docs).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)
    assert Counter(map(tuple, jaccard.jaccard_links(docs, block=64, hot_tokens=16).collect())) == want


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 3)]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(250):
        for a, b in edges:
            if a in least and b in least and a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.node: r.root for r in components.connected_components(df).collect()} == least
    some = {r.node: r.root for r in components.connected_components(df, rounds=1).collect()}
    assert some.keys() == least.keys() and all(least[k] == least[v] for k, v in some.items())
    assert components.connected_components(df.limit(0)).count() == 0


def test_samples_are_of_rows(spark):
    """One id with many rows does not bring them all, and one row repeated does not crowd out the rest."""
    docs = spark.range(3000).selectExpr("1L as doc_id", "concat('text of number ', id) as text", "'en' as lang").unionAll(spark.range(3000).selectExpr("2L", "'der die das'", "'de'"))
    model = langid.fit(docs, F.lit(True), per_language=50)
    assert set(model.languages) == {"en", "de"} and langid.identify(docs, model).where("(doc_id = 1) = (lang_pred = 'en')").count() == 6000
    assert quality.fit(docs, sample=40).weights.any()


def test_media_formats_are_lossless():
    for n in (64, 128, 6400):
        p = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        assert media.from_media(media.to_media(p)) == p
