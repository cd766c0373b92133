import random

import public_tokenizers
from loomcert.llm import pieces


def test_units_in_use_are_learned_once_though_others_go(monkeypatch):
    monkeypatch.setattr(pieces, "_KNOWN_BYTES", 3000)
    c = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    learned, merge = [], c.merge
    monkeypatch.setattr(c, "merge", lambda u: learned.append(u) or merge(u))
    for k in range(40):
        text = "the same and other" + "".join(f" x{k}y{j}" for j in range(5))
        (ids, back), = c.encode_batch([text])
        assert back == text and ids == b"".join(i.to_bytes(4, "little") for i in c.library.encode(text, add_bos=True, add_eos=True))
    assert learned.count(pieces.SPACE + "same") == 1 and len(c.known) + len(c.older) < 40


def test_merges_equal_the_library_on_odd_units():
    c, rng = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model")), random.Random(4)
    for k in range(3000):
        unit = "".join(rng.choice("aabcdeeinorstt'0.-äßяж中的€\U0001f600\0") for _ in range(1 + k % 40))
        assert c.merge(pieces.SPACE + unit) == c.library.encode(unit), unit
