"""Suffix-array dedup against brute force over all windows."""

import hashlib
import random

from quillmark.llm import suffix_dedup as X


def brute(rows, length=100):
    """rows: (id, text) in the table's order."""
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        t = (rows[i][1] or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        rest = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(rows[i][0]), len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def corpus(rng):
    words = [f"{rng.choice('abcdefgé')}{rng.randrange(10**4)}" for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    line, passage = prose(9), prose(60)
    rows = []
    for i in range(60):
        t = prose(rng.randrange(1, 150))
        rows.append((i, t))
        for _ in range(rng.choice([0, 0, 1, 5])):
            x = t
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(x) + 1)
                x = x[:k] + rng.choice(["", "Z", "zz"]) + x[k + rng.randrange(2) :]
            rows.append((rng.randrange(100, 10_000), x))
    rows += [(20_000 + i, f"{prose(20)} {passage} {prose(5)} {line} {prose(20)}") for i in range(40)]
    rows += [(30_000, "a" * 1000), (30_001, "a" * 100), (30_002, "a" * 99), (30_003, "xy" * 400), (30_004, f"{passage}\n{passage}\n{passage}"), (30_005, "\0" * 300), (30_006, "\0" * 99 + "b" + "\0" * 99), (30_007, ("Thsh " * 300) + "end " + "Thsh " * 90)]
    rows += [(40_000, None), (40_001, ""), (40_002, None), (None, passage), (None, rows[0][1]), (7, rows[7][1]), (50_000, prose(20_000) + passage)]
    rows += [(60_000 + i, rows[1][1]) for i in range(30)]
    return rows


def check(spark, rows, parts, **options):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_bytes int").coalesce(1)
    if parts > 1:
        df = df.repartitionByRange(parts, "doc_id")
    got = X.remove_repeats(df, **options).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, options.get("length", 100))
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "MERGE_BYTES", 5000)
    rng = random.Random(21)
    check(spark, corpus(rng), 1)
    monkeypatch.setattr(X, "BLOCK_BYTES", 20_000)
    check(spark, corpus(rng), 3)
    monkeypatch.setattr(X, "PIECE", 700)
    check(spark, corpus(rng), 2)
    monkeypatch.setattr(X, "HOT_SEGMENTS", 8)
    check(spark, corpus(rng), 3)


def test_small_lengths_and_empty(spark):
    rng = random.Random(22)
    rows = [(i, "".join(rng.choices("ab", k=rng.randrange(60)))) for i in range(80)]
    check(spark, rows, 1, length=12, key_bytes=5)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.remove_repeats(empty).count() == 0
    kept = X.remove_repeats(spark.createDataFrame([(1, "q" * 250)], "doc_id long, text string"), with_kept=True).first()
    assert bytes(kept.kept) == b"q" and kept.n_removed == 249


def test_keys_fill_ranges_evenly():
    rng = random.Random(23)
    text = " ".join(f"{rng.randrange(10**6)}" for _ in range(40_000)).encode()
    counts = [z - a for _, a, z in X.hash_ranges(X.np.unique(X.segments(text, 100, 64)[0]), 5)]
    assert len(counts) == 32 and max(counts) < 1.2 * min(counts)


def test_long_text_in_pieces():
    """Memory beyond the text and its segments is that of a piece."""
    import tracemalloc

    text = random.Random(24).randbytes(40 << 20)
    tracemalloc.start()
    key, start, end = X.segments(text, 100, 64)
    assert tracemalloc.get_traced_memory()[1] < 4 * len(text) and end[-1] == len(text) - 99 and (start[1:] == end[:-1]).all()
    tracemalloc.stop()
