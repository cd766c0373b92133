"""Language identification by nearest centroid: TF-IDF vectors of hashed letter n-grams, several centroids a language, cosine, rejection by distance.

The model is fitted on a bounded sample of labelled rows (`sample` at most, the same number for each language, those with the least
hash) in one task of an executor; every text is then classified whole, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import column, on_executors, thinned, to_batch

DIMENSIONS = 4096
SAMPLE = 8000
PER_LANGUAGE = 1000
CENTROIDS = 3
FOLDS = 5
QUANTILE = 0.01
MARGIN = 0.75
ENOUGH = 20
_BLOCK = 1 << 20
_FEW = 10_000
_letters = None

_VECTORS = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32()))])
_MODEL = pa.schema([("languages", pa.list_(pa.string())), ("centroids", pa.list_(pa.float32())), ("idf", pa.list_(pa.float32())), ("least", pa.list_(pa.float64()))])


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of a text's hashed 1-, 2- and 3-grams of lower-cased letters, where all that is no letter is one sign; zeros without a letter."""
    out = np.zeros(dimensions, np.float32)
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    text = (text or "").lower()
    for s in range(0, len(text), _BLOCK):
        code = np.frombuffer(text[max(0, s - 2) : s + _BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[code]
        c = np.concatenate([[0], np.where(letter, code, 0), [0]]).astype(np.uint32)
        letter = c != 0
        one = (c * np.uint32(2654435761))[letter]
        two = (c[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917))[letter[:-1] | letter[1:]]
        three = (c[:-2] * np.uint32(668265263) + c[1:-1] * np.uint32(374761393) + c[2:] * np.uint32(2869860233))[letter[1:-1]]
        for h in (one, two, three):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2146121005)
            out += np.bincount(h >> shift, minlength=dimensions).astype(np.float32)
    return out


def vectors_of(batches, dimensions: int):
    for batch in batches:
        at, weight = [], []
        for t in column(batch, "text").to_pylist():
            v = counts(t, dimensions)
            at.append(k := np.flatnonzero(v))
            weight.append(1 + np.log(v[k]))
        yield to_batch(_VECTORS, column(batch, "h"), column(batch, "lang"), at, weight)


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row nearest to the mean and the rows farthest from those taken."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    c = [x[np.argmax(x @ unit(x.mean(0)))]]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin(np.max(x @ np.array(c).T, 1))])
    c = np.array(c)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.array([unit(x[own == j].mean(0)) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def length_class(v: np.ndarray) -> np.ndarray:
    """The power of two of the number of different grams, of each row: cosines of short texts are lower."""
    return np.log2(np.maximum((v > 0).sum(1), 1)).astype(np.int64)


def held_out_cosines(x: np.ndarray, centroids: int, folds: int = FOLDS) -> np.ndarray:
    """Of each row the cosine to the nearest centroid of the other folds; nan for a single row."""
    out = np.full(len(x), np.nan)
    fold = np.arange(len(x)) % folds
    for f in range(min(folds, len(x)) if len(x) > 1 else 0):
        out[fold == f] = np.max(x[fold == f] @ _clustered(x[fold != f], centroids).T, 1)
    return out


def thresholds(cosines: np.ndarray, kinds: np.ndarray, lang: np.ndarray, names: list[str], classes: int, margin: float, quantile: float) -> dict[str, np.ndarray]:
    """For each language and length class, `margin` times the low quantile of held-out cosines; of all languages where it has few.

    A class has no more than any longer one, and one without texts that of the next longer, or else of the last; 0 if there are none.
    """
    known, out = ~np.isnan(cosines), {}
    for name in names:
        least = np.full(classes, np.inf)
        for k in range(classes):
            every = known & (kinds == k)
            own = every & (lang == name)
            if every.any():
                least[k] = margin * np.quantile(cosines[own if own.sum() >= ENOUGH else every], quantile)
        some = np.flatnonzero(np.isfinite(least))
        least[some[-1] + 1 if len(some) else 0 :] = least[some[-1]] if len(some) else 0
        out[name] = np.minimum.accumulate(least[::-1])[::-1]
    return out


class Model:
    """languages: of each centroid; least: the cosine below which a text is rejected, of each centroid and length class."""

    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.languages, self.centroids, self.idf, self.least = languages, centroids, idf, least

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, accepted). Without a letter: und, 0.0, False; a model that has learned nothing: und, 0.0, True."""
        out: list[tuple[str, float, bool]] = []
        for s in range(0, len(texts), 256):
            v = np.array([counts(t, len(self.idf)) for t in texts[s : s + 256]])
            some_gram = v > 0
            some, kinds = some_gram.any(1), length_class(v)
            if not self.languages:
                out += [("und", 0.0, bool(x)) for x in some]
                continue
            np.log(v, out=v, where=v > 0)
            v += some_gram
            v *= self.idf
            cos = (v @ self.centroids.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            best = np.argmax(cos, 1)
            top = np.clip(cos[np.arange(len(v)), best], 0, 1)
            out += [(self.languages[b], float(c), bool(c >= self.least[b, k])) if x else ("und", 0.0, False) for b, c, k, x in zip(best, top, kinds, some, strict=True)]
        return out


def fit_vectors(x: np.ndarray, lang: np.ndarray, centroids: int, margin: float, quantile: float) -> Model:
    """The model of term weights (a row for each text) and languages; texts without a letter are left out."""
    dimensions = x.shape[1]
    some = x.any(1)
    x, lang = x[some], lang[some]
    kinds = length_class(x)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    names, c, cosines = [], [], np.full(len(x), np.nan)
    for name in sorted(set(lang)):
        own = _clustered(x[lang == name], centroids)
        cosines[lang == name] = held_out_cosines(x[lang == name], centroids)
        names += [name] * len(own)
        c.append(own)
    least = thresholds(cosines, kinds, lang, sorted(set(lang)), dimensions.bit_length(), margin, quantile)
    return Model(names, np.concatenate(c) if c else np.zeros((0, dimensions), np.float32), idf, np.array([least[n] for n in names]))


def fitted_of(batches, dimensions: int, centroids: int, margin: float, quantile: float):
    """One row, the model of all rows, which come in the order of h."""
    lang, rows = [], []
    for batch in batches:
        lang += column(batch, "lang").to_pylist()
        for at, w in zip(column(batch, "at"), column(batch, "weight"), strict=True):
            rows.append(np.zeros(dimensions, np.float32))
            rows[-1][at.values.to_numpy()] = w.values.to_numpy()
    m = fit_vectors(np.array(rows, np.float32).reshape(-1, dimensions), np.array(lang, object), centroids, margin, quantile)
    yield to_batch(_MODEL, [m.languages], [m.centroids.ravel()], [m.idf], [m.least.ravel()])


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, margin: float = MARGIN, quantile: float = QUANTILE, dimensions: int = DIMENSIONS) -> Model:
    """Learns from the rows of docs (doc_id, text, lang) where `learn` holds and text and lang aren't null; repeated rows count once.

    Rows are sampled, not ids. A language's rows are first thinned by hash to about twice its share, so that ranking them takes a task no
    more rows the more there are.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64("doc_id", "text", "lang").alias("h")
    rows = usable.select("lang", h)
    per = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    languages = per.count()
    quota = max(1, min(per_language, sample // max(1, languages)))
    per = F.broadcast(per) if languages <= _FEW else per  # so that rows are thinned before they are dealt by language
    order = Window.partitionBy("lang").orderBy("h")
    ids = rows.join(per, "lang").where(thinned(quota, F.col("n"))).select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= quota).select("h").limit(sample)
    chosen = usable.select(h, "lang", "text").join(F.broadcast(ids), "h", "left_semi").dropDuplicates(["h"])
    vectors = chosen.mapInArrow(on_executors("langid", "vectors_of", dimensions), "h long, lang string, at array<int>, weight array<float>")
    one = vectors.repartition(1).sortWithinPartitions("h")
    got = one.mapInArrow(on_executors("langid", "fitted_of", dimensions, centroids, margin, quantile), "languages array<string>, centroids array<float>, idf array<float>, least array<double>").first()
    if got is None:
        return fit_vectors(np.zeros((0, dimensions), np.float32), np.zeros(0, object), centroids, margin, quantile)
    shaped = lambda v, kind: np.array(v, kind).reshape(len(got.languages), -1)
    return Model(list(got.languages), shaped(got.centroids, np.float32) if got.languages else np.zeros((0, dimensions), np.float32), np.array(got.idf, np.float32), shaped(got.least, float) if got.languages else np.zeros(0))


def predictions_of(batches, model):
    model = model.value
    for batch in batches:
        got = model.predict(column(batch, "text").to_pylist())
        yield to_batch(
            pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())]),
            column(batch, "doc_id"), *([x[j] for x in got] for j in range(3)),
        )


def accepted_of(batches, model):
    model = model.value
    for batch in batches:
        yield batch.filter(pa.array([x[2] for x in model.predict(column(batch, "text").to_pylist())], pa.bool_()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, lang_pred, score (the cosine, 0 to 1), accepted.

    lang_pred is a learned language, or und if the text is null, empty or has no letter; those are not accepted, nor texts whose cosine
    is under `margin` times a low quantile of those that held-out texts of the language and about that length have. Ties go to the first language in alphabetical order. Equal
    texts have equal results. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(on_executors("langid", "predictions_of", docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose text the model accepts."""
    return docs.mapInArrow(on_executors("langid", "accepted_of", docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
