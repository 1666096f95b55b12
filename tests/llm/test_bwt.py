"""Merged transforms against sorted suffixes."""

import random

import numpy as np

from quillmark.llm import bwt


def brute(strings, depth):
    by = {}
    for s, x in enumerate(strings):
        for i in range(len(x) - depth + 1):
            by.setdefault(x[i : i + depth], []).append((s, i))
    return sorted(sorted(v) for v in by.values() if len(v) > 1)


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(50):
        strings = [bytes(rng.choices(b"ab\0", k=rng.randrange(1, 60))) for _ in range(rng.randrange(1, 6))]
        text = bwt.Strings.of(strings)
        got = bwt.suffix_order(text, 0, len(text.data))
        suffix = lambda t: text.data[t : text.stop[t]].tobytes().ljust(100, b"\0") if t < text.stop[t] else b""
        assert [suffix(t) for t in got] == sorted(suffix(t) for t in range(len(text.data)))


def test_repeated_windows():
    rng = random.Random(4)
    for depth in (8, 12, 20, 100):
        for trial in range(60):
            base = bytes(rng.choices(b"ab" if trial % 2 else b"abcdefgh\0", k=200))
            strings = []
            for _ in range(rng.randrange(1, 30)):
                a = rng.randrange(150)
                x = bytearray(base[a : a + rng.randrange(1, 180)])
                if rng.random() < 0.5:
                    x[rng.randrange(len(x))] = 122
                strings.append(bytes(x))
            for shards in (1, 2, 3, 7):
                interval, string, place = bwt.repeated(strings, depth, shards)
                got = {}
                for k, s, i in zip(interval.tolist(), string.tolist(), place.tolist(), strict=True):
                    got.setdefault(k, []).append((s, i))
                assert sorted(sorted(v) for v in got.values()) == brute(strings, depth), (depth, trial, shards)


def test_common_prefixes():
    rng = random.Random(5)
    strings = [bytes(rng.choices(b"ab", k=50)) for _ in range(20)]
    text = bwt.Strings.of(strings)
    rows, common = bwt.merge(text, bwt.transforms(text, 3), 20)
    padded = [text.data[t : text.stop[t]].tobytes()[:20].ljust(20, b"\0") for t in rows]
    for a, b, n in zip(padded, padded[1:], common[1:], strict=False):
        real = next((i for i in range(20) if a[i] != b[i]), 20)
        assert n <= real and (n == 20) == (real == 20)
    assert np.all(np.diff([int.from_bytes(p) for p in padded[160:]], prepend=0) >= 0) or padded == sorted(padded)
