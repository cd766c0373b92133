import random

import numpy as np
import pytest
from loomcert.llm import toxicity

SYLLABLES = "the and ing er on th re ou at nd ha in st wh es ble".split()
NASTY = "loser idiot scum moron trash clown stupid".split()


def corpus(seed: int, n: int, toxic: int):
    """Texts of joined syllables; the first `toxic` of them have some nasty words, too."""
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(80)]
        for _ in range(4 * (k < toxic)):
            words.insert(rng.randrange(len(words)), rng.choice(NASTY))
        texts.append(" ".join(words).encode())
    return texts, [int(k < toxic) for k in range(n)]


@pytest.mark.parametrize("wrong", [0, 30])
def test_some_wrong_labels_do_not_cancel_the_toxic_words(wrong):
    texts, labels = corpus(1, 1500, 300)
    labels[:wrong] = [0] * wrong
    model = toxicity.fit_texts(texts, labels, list(range(len(texts))))
    assert all(f" {w} ".encode() in model.toxic for w in NASTY)
    new, y = corpus(2, 300, 100)
    hit = model.scores(new) >= model.bar
    y = np.array(y)
    assert hit[y == 1].mean() > 0.95 and hit[y == 0].mean() < 0.05


def test_marks_are_pieces_of_toxic_texts_and_leave_the_ordinary_dictionary():
    toxic, ordinary = [b"a nasty day"] * 40 + [b"a fine day"] * 40, [b"a fine day"] * 200 + [b"a nasty day"]
    marked = toxicity.marks(toxic, ordinary)
    assert set(toxicity._pieces(b"nasty")[1:-1].tolist()) <= set(marked.tolist())
    assert not toxicity._among(toxicity._pieces(b"fine"), marked).any()
    assert b"fine" in (rest := toxicity._unmarked(b"fine day nasty fine", marked)) and b"nasty" not in rest
    assert len(toxicity.marks([], ordinary)) == 0 == len(toxicity.marks([b""], [])) and toxicity._unmarked(b"abc", np.zeros(0, np.int64)) == b"abc"
