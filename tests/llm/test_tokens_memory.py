"""What the encoder holds at once, and what it remembers."""

import numpy as np
import public_tokenizers

from tidemark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Spy:
    """Notes how many texts are encoded at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.sizes = tokenizer, []

    def encode_batch_fast(self, texts, **how):
        self.sizes.append(len(texts))
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_many_new_pieces_and_whole_texts_are_encoded_in_bounded_batches():
    with open(PATH, encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(100)]
    texts += [f"two  spaces {i}" for i in range(100)]
    read = encoder.tokenizer
    want = [np.array(read.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder.tokenizer = Spy(read)
    assert encoder.encode(texts) == want
    assert max(encoder.tokenizer.sizes) <= 1024 and sum(encoder.tokenizer.sizes) == 6100


def test_pieces_met_once_are_not_remembered():
    with open(PATH, encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    texts = [f"once{i} often" for i in range(2000)]
    ids = [x for k in range(0, 2000, 100) for x in encoder.encode(texts[k : k + 100])]
    assert "often" in encoder.known and len(encoder.known) < 100
    assert encoder.encode(texts) == ids and len(encoder.known) >= 2000
    assert encoder.encode(texts) == ids
