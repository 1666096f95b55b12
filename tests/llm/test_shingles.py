"""Links by shingles against all pairs, with planted copies of similarity 0.8 to 0.95."""

import random

import numpy as np

from quillmark.llm import shingles, simhash


def jaccard(a, b, k=5):
    s, t = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.lower().split(), b.lower().split()))
    return len(s & t) / len(s | t)


def changed(rng, text, least, most):
    """The text with words replaced until its similarity lies in the range."""
    words = text.split()
    while not least <= jaccard(text, " ".join(words)) < most:
        if jaccard(text, " ".join(words)) < least:
            words = text.split()
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_connected():
    rng = random.Random(3)
    sets = [np.unique(np.array(rng.sample(range(40), rng.randrange(20, 40)), np.uint64)) for _ in range(60)]

    def parts(links):
        root = list(range(60))
        for i, j in links:
            root = [root[i] if r == root[j] else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    for s in (0.6, 0.7, 0.8):
        want = [(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= s * len(np.union1d(sets[i], sets[j])) - 1e-9]
        got = shingles.connected(sets, s)
        assert parts(got) == parts(want) and {(max(x), min(x)) for x in got} <= set(want)


def test_planted_copies_are_dropped(spark):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(120, 400))) for _ in range(150)]
    rows = list(enumerate(base))
    rows += [(1000 + i, changed(rng, t, a, z)) for i, (t, (a, z)) in enumerate(zip(base[:90], [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95)] * 30, strict=True))]
    rows += [(2000 + i, changed(rng, t, 0.65, 0.78)) for i, t in enumerate(base[90:120])]
    far = sum((simhash.fingerprint(base[i], 5) ^ simhash.fingerprint(t, 5)).bit_count() > 4 for i, (_, t) in enumerate(rows[150:240]))
    assert far > 45  # not found by the radius
    df = spark.createDataFrame([(d, t, "x") for d, t in rows + [(3000, None), (3001, ""), (3002, "a b"), (3003, "A  b")]], "doc_id long, text string, unit string").repartition(3)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(kept) == [*range(150), *range(2000, 2030), 3000, 3002]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
