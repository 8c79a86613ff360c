"""Ids of words that end in a stop, and what is forgotten."""

import random

import numpy as np
from test_operators import WORD_BPE

from tracewright.llm import packing


def test_ids_are_the_tokenizers_and_early_words_stay(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 400)
    ids, rng = packing.WordIds(WORD_BPE), random.Random(4)
    often = ["the", "and.", "it,", "bé.", "É.", "a.,", "b..", ",", ".", "1.", "x1,", "don't.", "'s,", "İ.", "q;"]
    for i in range(120):
        text = " ".join([*rng.sample(often, 9), *[f"w{rng.randrange(10**6)}{rng.choice(['', ',', '.', '.,'])}" for _ in range(8)]])
        text = text if i else " ".join(often)
        assert np.frombuffer(ids.encode(text.encode()), dtype="<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(ids.known) < 500 and b"the" in ids.known and b"and." in ids.known
