"""The encoder's store of pieces."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_one_bounded_store(monkeypatch):
    """Pieces at the beginning of lines and behind spaces share one store, and ids are the tokenizer's with a full one too."""
    texts = ["", " ", "\n", "a", "a\n", "\na b", "one two, three.\nfour five.", " lead", "trail ", "two  spaces", "x,\ny.", ", . ,,", "é ü z", "tab\tin it", "same same, same.\nsame same,\nsame."]
    texts += [f"word{i} other{i},\nline{i} end{i}." for i in range(60)]
    read = Tokenizer.from_file(PATH)
    want = [np.array(read.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    for most in (10**6, 100):
        monkeypatch.setattr(tokens, "REMEMBERED", most)
        encoder = tokens.Encoder(spec)
        for k in (1, 7, 500):
            assert [ids for a in range(0, len(texts), k) for ids in encoder.encode(texts[a : a + k])] == want
        assert 0 < len(encoder.known) <= most and all(isinstance(ids, bytes) for ids in encoder.known.values())
