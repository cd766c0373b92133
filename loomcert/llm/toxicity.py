"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text, window by window.

A window's distance is how many bytes fewer it takes with the toxic dictionary before the ordinary one than with the ordinary one
alone. Windows are compressed between two fixed strings that are in both dictionaries: otherwise a window's first match costs more
than the later ones, and its last bytes can't match at all.

The ordinary dictionary is trained on ordinary texts. The toxic one is trained on toxic texts by what it compresses: it starts as
their words (those in several texts); the texts are dealt to folds, and a word of one fold stays if the dictionary of the other folds
saves `GAIN` bytes on it. Words of ordinary texts on which the result saves `HARD_GAIN` go to the ordinary dictionary, and the toxic words
are judged again. So words stay that toxic texts share and ordinary ones don't, by compressed lengths.

That alone is not safe: a few ordinary texts with toxic words, as of a wrong label, would cancel all like words, and a short word may take
more bytes as a match than as it is. So pieces of `PIECE` bytes that are far more usual in toxic texts are `marks`: words with one stay, do
not go to the ordinary dictionary, and are cut from what was trained.

The threshold is calibrated on labelled texts that the dictionaries have not seen. A distance's evidence is the logarithm of how much
more often windows of toxic texts reach it than those of ordinary ones; a text's evidence is summed over its windows and set against
their number, and a text over the line where its label is as likely 1 as 0 counts as toxic. Toxic texts are few, so that line leaves many of
them: a corpus is cut at a score of its own, `bar`, where the share of toxic texts found and that of ordinary ones left add up to most.

The fit takes a bounded sample of labelled rows (`ordinary` and `toxic` at most, those with the least hash, and of these the first
`sample_bytes`) and runs in one task of an executor; every text is then scored whole, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import _SEPARATOR
from .util import column, on_executors, to_batch, utf8

WINDOW = 32
ORDINARY = 5000
TOXIC = 2000
SAMPLE_BYTES = 32 << 20
ORDINARY_BYTES = 112640
HARD_BYTES = 1 << 16
TOXIC_BYTES = 1 << 14
FOLDS = 4
ROUNDS = 2
GAIN = 2
HARD_GAIN = 1
PIECE = 5
RATIO = 12
PRIME, TAIL = bytes(range(1, 17)), bytes(range(17, 25))
_LONGEST = 40
_DISTANCES = 13
_LOT = 100
_LEVEL = 12
#: The same for all dictionaries: zstandard's own change at 128 KB, which can lie between the two that are compared.
_SEARCH = {"strategy": zstandard.STRATEGY_BTLAZY2, "hash_log": 17, "chain_log": 18, "search_log": 7, "target_length": 12}
_GAP = re.compile(rb"[\x20\x09-\x0d]+")
_compressors: dict[bytes, tuple] = {}


def windows(data: bytes, width: int = WINDOW) -> np.ndarray:
    """(offset, length) of windows that cover the text; each ends before the first separator after `width` bytes, or after 2 * width."""
    a = np.frombuffer(data, np.uint8)
    cut = np.arange(width, len(a), width)
    space = np.append(np.flatnonzero(_SEPARATOR[a]), len(a) + 2 * width)
    end = space[np.searchsorted(space, cut)]
    end = np.unique(np.append(np.where(end - cut < width, end, cut), len(a)))
    start = np.append(0, end[:-1])
    return np.stack([start, end - start], 1)[end > start].astype("<u8")


def words(data: bytes) -> set[bytes]:
    """A text's distinct words of four bytes or more, with a separator on each side; long ones in pieces."""
    return {b" " + w[k : k + _LONGEST] + b" " for w in _GAP.split(data) if len(w) > 3 for k in range(0, len(w), _LONGEST)}


def _pieces(data: bytes) -> np.ndarray:
    """The number that each PIECE bytes of the text make, at each place; all separators are alike."""
    a = np.frombuffer(b" " + data + b" ", np.uint8)
    a = np.where(_SEPARATOR[a], 32, a).astype(np.int64)
    n = max(len(a) - PIECE + 1, 0)
    return sum((a[k : k + n] << 8 * k for k in range(PIECE)), np.zeros(n, np.int64))


def marks(toxic: list[bytes], ordinary: list[bytes], ratio: float = RATIO) -> np.ndarray:
    """The pieces whose share of toxic texts, less two deviations of their number, is over `ratio` times that of ordinary ones, sorted."""
    found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(0, len(toxic), _LOT):
        more, at = np.unique(np.concatenate([found, *(np.unique(_pieces(t)) for t in toxic[k : k + _LOT])]), return_inverse=True)
        found, n = more, np.bincount(at, np.append(n, np.ones(len(at) - len(n), np.int64)), len(more)).astype(np.int64)
    low = n - 2 * np.sqrt(n)
    found, low = found[low > 0], low[low > 0]
    usual = np.ones(len(found), np.int64)
    for t in ordinary:
        usual[_among(np.unique(_pieces(t)), found, places=True)] += 1
    return found[low * len(ordinary) > ratio * usual * len(toxic)]


def _among(pieces: np.ndarray, found: np.ndarray, places: bool = False) -> np.ndarray:
    """Which of the pieces are among the sorted ones found, or with `places`, where in these they are."""
    if not len(found):
        return np.zeros(0 if places else len(pieces), np.int64 if places else bool)
    at = np.minimum(np.searchsorted(found, pieces), len(found) - 1)
    same = found[at] == pieces
    return at[same] if places else same


def _unmarked(content: bytes, found: np.ndarray) -> bytes:
    """The content without the bytes of the pieces found."""
    hit = np.append(_among(_pieces(content), found), np.zeros(PIECE, bool))
    covered = np.zeros(len(hit), bool)
    for k in range(PIECE):
        covered[k:] |= hit[: len(hit) - k]
    return np.frombuffer(content, np.uint8)[~covered[1 : len(content) + 1]].tobytes()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content + TAIL + PRIME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(
        _LEVEL, **_SEARCH, source_size=WINDOW, min_match=4, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d)


def primed(data: bytes, s: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The windows, each between PRIME and TAIL, and where they lie in that."""
    n = s[:, 1].astype(np.int64)
    whole = n + len(PRIME) + len(TAIL)
    start = np.append(0, np.cumsum(whole)[:-1])
    out, body = np.empty(int(whole.sum()), np.uint8), np.ones(int(whole.sum()), bool)
    for fixed, offset in ((PRIME, 0), (TAIL, n + len(PRIME))):
        at = (start + offset)[:, None] + np.arange(len(fixed))
        body[at] = False
        out[at] = np.frombuffer(fixed, np.uint8)
    out[body] = np.frombuffer(data, np.uint8)
    return out.tobytes(), np.stack([start, whole], 1).astype("<u8")


def _lengths(compressor: zstandard.ZstdCompressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    got = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
    return np.fromiter((len(got[k]) for k in range(len(got))), np.int64, len(got))


def distances(plain: zstandard.ZstdCompressor, both: zstandard.ZstdCompressor, data: bytes, s: np.ndarray) -> np.ndarray:
    """How many bytes fewer each window (offset, length) of data takes with `both` than with `plain`."""
    if not len(s):
        return np.zeros(0, np.int64)
    data, s = primed(data, s)
    return _lengths(plain, data, s) - _lengths(both, data, s)


def saved_on(parts: list[bytes], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """What the toxic dictionary before the ordinary one saves on each part."""
    n = np.array([len(p) for p in parts], np.int64)
    s = np.stack([np.cumsum(n) - n, n], 1).astype("<u8").reshape(-1, 2)
    return distances(_compressor(ordinary), _compressor(toxic + ordinary), b"".join(parts), s)


class Model:
    """ordinary, toxic: contents of the dictionaries; evidence: of each distance; line: weights of the standardised summed evidence and number of windows;
    bar: the score from which on a text leaves a corpus."""

    def __init__(self, ordinary: bytes, toxic: bytes, evidence: np.ndarray, line: np.ndarray, bar: float = 0.5):
        self.ordinary, self.toxic, self.evidence, self.line, self.bar = ordinary, toxic, evidence, line, bar

    def counted(self, data: bytes) -> np.ndarray:
        """How many windows of a text have each distance; the last place is for all larger ones, the first for those under 1."""
        key = self.ordinary + b"\0" + self.toxic
        if key not in _compressors:
            _compressors.clear()
            _compressors[key] = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        data = data.lower()
        return np.bincount(np.clip(distances(*_compressors[key], data, windows(data)), 0, _DISTANCES - 1), minlength=_DISTANCES)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.scores_of_counts(np.array([self.counted(t) for t in texts]))

    def scores_of_counts(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[_measured(counts, self.evidence), np.ones(len(counts))] @ self.line, -30, 30)))


def _measured(counts: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    return np.log1p(np.c_[counts @ evidence, counts.sum(1)])


def evidence_of(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each distance, how much likelier windows of toxic texts reach it, as a logarithm that never falls nor is under 0; 0 for no distance."""
    reach = counts[:, ::-1].cumsum(1)[:, ::-1]
    toxic, ordinary = reach[y == 1].sum(0), reach[y == 0].sum(0)
    e = np.maximum(np.log((toxic + 0.5) / (toxic[0] + 1)) - np.log((ordinary + 0.5) / (ordinary[0] + 1)), 0)
    e[0] = 0
    return np.maximum.accumulate(e)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights for x and an intercept, found on standardised x."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, fixed = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + fixed, z.T @ (p - y) + fixed @ w)
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def even_bar(scores: np.ndarray, y: np.ndarray) -> float:
    """The score, 0.5 at most, from which on the share of label 1 and below which that of label 0 add up to most; of equal ones the greatest. With one label only, 0.5."""
    toxic, ordinary = np.sort(scores[y == 1]), np.sort(scores[y == 0])
    if not len(toxic) or not len(ordinary):
        return 0.5
    bars = np.unique(np.append(toxic[toxic < 0.5], 0.5))
    both = np.searchsorted(ordinary, bars) / len(ordinary) - np.searchsorted(toxic, bars) / len(toxic)
    return float(bars[len(bars) - 1 - np.argmax(both[::-1])])


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b" " * 8


def _joined(parts: Iterable[bytes], seen: Counter, size: int) -> bytes:
    """The parts, those of most texts last, so that they cost least; of more than `size` bytes the first go."""
    return b"".join(sorted(parts, key=lambda w: (seen[w], w)))[-size:]


def train(toxic: list[bytes], ordinary: list[bytes], rounds: int = ROUNDS, folds: int = FOLDS, gain: int = GAIN) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from lower-cased texts of each class. A fixed number of rounds; words in one text only are not looked at."""
    plain = _dictionary(ORDINARY_BYTES, [t[k : k + 400] for t in ordinary for k in range(0, len(t), 400)])
    marked = marks(toxic, ordinary)
    plain = _unmarked(plain, marked) or b" " * 8
    fold = [Counter(w for t in toxic[k::folds] for w in words(t)) for k in range(folds)]
    seen, usual = sum(fold, Counter()), Counter(w for t in ordinary for w in words(t))
    kept, common = [w for w, n in seen.items() if n > 1], sorted(w for w, n in usual.items() if n > 1)
    has_mark = lambda w: _among(_pieces(w), marked).any()
    sure = {w for w in kept if has_mark(w)}
    for k in range(rounds):
        told = set(sure)
        for own in fold:
            others = seen - own
            mine = [w for w in kept if own[w] and w not in sure]
            told |= {w for w, g in zip(mine, saved_on(mine, plain, _joined((w for w in kept if others[w]), others, TOXIC_BYTES)), strict=True) if g >= gain}
        kept = sorted(told)
        if k < rounds - 1:
            hard = saved_on(common, plain, _joined(kept, seen, TOXIC_BYTES))
            plain = _joined((w for w, g in zip(common, hard, strict=True) if g >= HARD_GAIN and not has_mark(w)), usual, HARD_BYTES) + plain
    return plain, _joined(kept, seen, TOXIC_BYTES)


def fit_texts(texts: list[bytes], labels: list[int], held: list[int]) -> Model:
    """held: a number for each text, by which a third is kept from the dictionaries for the calibration."""
    texts, y = [t.lower() for t in texts], np.array(labels, float)
    own = np.array([h % 3 > 0 for h in held], bool)
    if y[~own].sum() < 60:  # too few to hold any back
        own[:] = True
    chosen = lambda label: [t for t, k, o in zip(texts, y, own, strict=True) if o and k == label]
    model = Model(*train(chosen(1), chosen(0)), np.zeros(_DISTANCES), np.zeros(3))
    on = ~own if (~own).any() else own
    if not on.any():
        return model
    counts = np.array([model.counted(t) for t, o in zip(texts, on, strict=True) if o])
    model.evidence = evidence_of(counts, y[on])
    model.line = _logistic(_measured(counts, model.evidence), y[on])
    model.bar = even_bar(model.scores_of_counts(counts), y[on])
    return model


_MODEL = pa.schema([("ordinary", pa.binary()), ("toxic", pa.binary()), ("evidence", pa.list_(pa.float64())), ("line", pa.list_(pa.float64())), ("bar", pa.float64())])


def fitted_of(batches, sample_bytes: int):
    """One row, the model of all rows (h, toxic, text), which come in the order of h, up to sample_bytes of text."""
    texts, labels, held, size = [], [], [], 0
    for batch in batches:
        for h, y, t in zip(column(batch, "h").to_pylist(), column(batch, "toxic").to_pylist(), utf8(batch), strict=True):
            if size < sample_bytes:
                texts.append(t)
                labels.append(y)
                held.append((h >> 7) & 0xFFFF)
                size += len(t)
    m = fit_texts(texts, labels, held)
    yield to_batch(_MODEL, [m.ordinary], [m.toxic], [m.evidence], [m.line], [m.bar])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, ordinary: int = ORDINARY, toxic: int = TOXIC, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from the rows of docs (doc_id, text) whose id has a label (doc_id, toxic) and where `learn`, on doc_id, holds.

    Labels other than 0 and 1 and null texts are not used; an id with both labels counts as toxic, and repeated rows count once. Rows are
    sampled, not ids, whatever their length. Without any row, the model scores all texts alike.
    """
    marked = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where(learn & F.col("text").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("h"))
    usable = rows.join(marked, "doc_id").groupBy("doc_id", "h").agg(F.first("toxic").alias("toxic"))
    least = [usable.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(n) for label, n in ((0, ordinary), (1, toxic))]
    texts = docs.where(learn & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    chosen = texts.join(F.broadcast(least[0].union(least[1])), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("h", "toxic", "text")
    one = chosen.repartition(1).sortWithinPartitions("h", "text")
    got = one.mapInArrow(on_executors("toxicity", "fitted_of", sample_bytes), "ordinary binary, toxic binary, evidence array<double>, line array<double>, bar double").first()
    if got is None:
        return fit_texts([], [], [])
    return Model(bytes(got.ordinary), bytes(got.toxic), np.array(got.evidence), np.array(got.line), got.bar)


def scores_of(batches, model):
    model = model.value
    for batch in batches:
        s = model.scores([t or b"" for t in utf8(batch)])
        yield to_batch(pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())]), column(batch, "doc_id"), s, (s >= 0.5).astype(np.int32))


def accepted_of(batches, model):
    model = model.value
    for batch in batches:
        yield batch.filter(pa.array(model.scores([t or b"" for t in utf8(batch)]) < model.bar))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, score (0 to 1, higher: more likely toxic), predicted (1 from 0.5 on).

    Null and empty texts are scored as texts without any window. Equal texts have equal scores. Other columns are not read. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(on_executors("toxicity", "scores_of", docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, that stay under the model's bar."""
    return docs.mapInArrow(on_executors("toxicity", "accepted_of", docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
