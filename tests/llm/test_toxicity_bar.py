import numpy as np
from loomcert.llm import toxicity


def test_the_bar_is_where_both_shares_add_up_to_most():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        for _ in range(20):
            y, s = np.append([0, 1], rng.integers(0, 2, n)), rng.integers(0, 12, n + 2) / 11
            gain = lambda b: (s[y == 1] >= b).mean() + (s[y == 0] < b).mean()  # noqa: B023, E731
            best = max(gain(b) for b in np.append(s[s < 0.5], 0.5))
            bar = toxicity.even_bar(s, y)
            assert bar <= 0.5 and abs(gain(bar) - best) < 1e-12
    assert toxicity.even_bar(np.array([0.1, 0.2]), np.array([0, 0])) == 0.5 == toxicity.even_bar(np.zeros(0), np.zeros(0))


def test_a_corpus_is_cut_at_the_bar_and_predictions_at_a_half(spark):
    """A text that is rather not toxic by its label's chance, but over the bar, goes."""
    model = toxicity.Model(b"ordinary words ", b"nasty words ", np.zeros(toxicity._DISTANCES), np.array([0.0, 0.0, -1.0]), 0.2)
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert [(round(r.score, 3), r.predicted) for r in toxicity.score_toxicity(docs, model).collect()] == [(0.269, 0)] * 2
    assert toxicity.keep_ordinary(docs, model).count() == 0
    model.bar = 0.3
    assert toxicity.keep_ordinary(docs, model).count() == 2
