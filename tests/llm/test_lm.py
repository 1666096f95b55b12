"""Language-model scoring against an automaton traversed word by word."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import lm as X


def by_hand(rows, order, strength):
    """States are tuples of words; an arc for every n-gram that occurs; failure arcs drop the first word."""
    texts = [(d, zlib.crc32(str("" if d is None else d).encode()) % 5 == 1, [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), "END"]) for d, t in rows]
    arcs = Counter()
    for _, held, words in texts:
        if not held:
            line = ["END", *words]
            for i in range(1, len(line)):
                for n in range(1, order + 1):
                    if i - n + 1 >= (n == 1):
                        arcs[tuple(line[i - n + 1 : i + 1])] += 1
    total = sum(c for k, c in arcs.items() if len(k) == 1)
    types = sum(len(k) == 1 for k in arcs)
    seen = lambda state: sum(not h for _, h, _ in texts) if state == ("END",) else arcs[state]

    def weight(state, word):
        if not state:
            return (arcs[word,] + 0.5) / (total + 0.5 * (types + 1))
        failed = strength / (seen(state) + strength)
        return arcs[*state, word] / (seen(state) + strength) + failed * weight(state[1:], word)

    out = []
    for d, held, words in texts:
        state, base, score = ("END",)[: order - 1], 0.0, 0.0
        for w in words:
            base += math.log10(weight((), w))
            score += math.log10(weight(state, w))
            state = (*state, w)[-(order - 1) :] if order > 1 else ()
        out.append((d, held, len(words), sum(arcs[w,] > 0 for w in words), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(X, "BLOCK_BYTES", 4000)
    rng = random.Random(order)
    vocabulary = ["The", "the", "É", "river", "ran", "x.", "end", "\t", "so", "on"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for i in range(300)] + [(700, None), (701, ""), (None, "the river"), (5, rows_text := "ran so on"), (5, rows_text), (900, "the river ran so on " * 2000), (901, "unseen words only")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted(X.score(df, order, 4.0).collect(), key=repr)
    want = sorted(by_hand(rows, order, 4.0), key=lambda r: repr(r[:2]))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)
    if order == 2:
        assert X.score(df.limit(0)).count() == 0
        alone = X.score(df.where("doc_id = 0")).collect()
        assert alone[0].train_tokens == alone[0].n_tokens


def test_planes():
    for kind in (np.uint64, np.uint32, np.int64):
        v = np.array([0, 1, 2**31, 255, 256], kind)
        assert X.unplaned(X.planes(v), kind).tolist() == v.tolist()
