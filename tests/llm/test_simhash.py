"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash

from quillmark.llm import simhash


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=4):
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted((d is None, d or 0, f, least.get(find(f))) for d, f in pairs)


def test_prints():
    rng = random.Random(2)
    for _ in range(300):
        t = " ".join(rng.choice(["Ab", "É", "c", "\t", "dÉf", "x\n"]) for _ in range(rng.randrange(15)))
        assert simhash.fingerprint(t) == brute_print(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_spanning():
    a, b = np.array([5, 4, 3, 9, 9, 7], np.uint64), np.array([3, 3, 1, 8, 7, 8], np.uint64)
    u, v = simhash.spanning(a, b)
    assert len(u) == 5 and {*u.tolist(), *v.tolist()} == {1, 3, 4, 5, 7, 8, 9}


def test_components_of_planted_prints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ENTRIES", 20_000)
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 1, 7]
    for f in prints[:30]:  # chains of steps of up to 5 bits: some linked, some not
        for _ in range(rng.randrange(6)):
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << bit
            prints.append(f)
    rows = [(i, f) for i, f in enumerate(prints)] + [(5000 + i, prints[3]) for i in range(400)] + [(None, prints[5]), (None, 12345 << 40)]
    rng.shuffle(rows)
    signed = [(d, f - 2**64 if f >= 2**63 else f) for d, f in rows]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs.select("id", "fp"))
    got = simhash.near_duplicates(spark.createDataFrame(signed, "id long, fp long")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component_id) for r in got) == brute_components(rows)


def test_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(20)]
    near = [t.replace(" ", "  ", 3) for t in base] + [t + " tail" for t in base[:5]]
    rows = [(i, t, 1) for i, t in enumerate(base + near + [None, "", "one two", "One  TWO", "z " * 200_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    pairs = [(d, brute_print(t)) for d, t, _ in rows[:-1]] + [(len(rows) - 1, simhash.fingerprint(rows[-1][1]))]
    assert sorted((False, r.doc_id, r.fp % 2**64, r.component_id) for r in got) == brute_components(pairs)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_clashing_columns_stay(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, text, 7, 8), (2, text, 9, 10), (3, "other words altogether in this one here", 11, 12)], "doc_id long, text string, key int, nth int")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, text, 7, 8), (3, "other words altogether in this one here", 11, 12)]
