"""Words of texts against bytes.split()."""

import random

from quillmark.llm.common import split_words


def test_split_words():
    rng = random.Random(1)
    bits = ["a", "É", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", "bc"]
    texts = [None, "", " "] + ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(2000)]
    for part in (texts, texts[:3], [], ["a b"], [" a"]):
        codes, words, offsets = split_words(part)
        assert [[words[c] for c in codes[a:z]] for a, z in zip(offsets, offsets[1:], strict=False)] == [(t or "").encode().split() for t in part]
