"""Packing: ids against the tokenizer itself, exact cover of documents and sequences, padding."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillmark.llm import packing as X

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    return [[*e.ids, 2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_by_word_equal_ids_of_texts(monkeypatch):
    rng = random.Random(4)
    bits = ["don't", "É", "e", "́", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "ΣΑΣ", "ß", "123", "!?", "<|endoftext|>", "日本", "👍🏽", "'S", "_"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(20))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in range(a, a + 40)) + " " + " ".join("x" + chr(c) + "Y." for c in range(a, a + 40)) for a in range(0x20, 0x2100, 40)]
    texts += ["Hello, World! it's 2024-05-06 <|endoftext|> a|b #tag e-mail@x.org ŒUVRE Straße ĳ İstanbul ŉ ǅ"]
    monkeypatch.setattr(X, "CACHED_WORDS", 700)
    tokenizer = X.WordTokenizer(PATH)
    got = []
    for i in range(0, len(texts), 100):
        ids, ends = tokenizer.ids(texts[i : i + 100])
        got += [ids[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)]
    assert got == [x[:-1] for x in plain_ids(texts)]


def test_patterns_place_every_length():
    rng = random.Random(5)
    for capacity in (1, 8, 100):
        for _ in range(60):
            histogram = {rng.randrange(1, capacity + 1): rng.choice([1, 2, 7, 500]) for _ in range(rng.randrange(1, 12))}
            patterns = X.shortest_pack_first(histogram, capacity)
            total = {}
            for p in patterns:
                used = sum(k * v for k, v in p.copies.items())
                assert used + p.room == capacity and p.count > 0 <= p.room
                for k, v in p.copies.items():
                    total[k] = total.get(k, 0) + v * p.count
            assert total == histogram
            slots = X.slots_of(patterns)
            length = np.concatenate([np.full(n, k) for k, n in histogram.items()])
            rank = np.concatenate([np.arange(n) for n in histogram.values()])
            sequence, offset = slots.place(length, rank)
            cells = np.concatenate([s * capacity + o + np.arange(n) for s, o, n in zip(sequence, offset, length, strict=True)])
            assert len(np.unique(cells)) == len(cells)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_ROWS", 50)
    rng = random.Random(7)
    words = ["stone", "river", "copper", "unbelievably", "a", "é"]
    rows = [(i, " ".join(rng.choices(words, k=int(rng.expovariate(1 / 60)))), 1) for i in range(400)]
    rows += [(1000 + i, "one same text", 1) for i in range(300)] + [(2000, None, 1), (2001, "", 1), (None, "x y", 1), (5, rows[5][1], 1), (3000, "stone river " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = X.pack(X.pieces(df, PATH, 256, 2, with_ids=True), 256)
    got = out.collect()
    want = {d: ids for (d, _, _), ids in zip(rows, plain_ids([t for _, t, _ in rows]), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc == {d: len(ids) * (2 if d == 5 else 1) for d, ids in want.items()}
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    used = sum(n for ps in by_sequence.values() for _, n in ps)
    assert used / (256 * len(by_sequence)) > 0.97 and sorted(by_sequence) == list(range(len(by_sequence)))
    ids = {r.sequence_id: r.ids for r in X.sequences(out).collect()}
    assert sum(map(len, ids.values())) == used
    assert X.pack(X.pieces(df.limit(0), PATH, 256), 256).count() == 0


def test_rows_of_one_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_ROWS", 50)
    rows = [(None, 0, 9)] * 700 + [(7, 0, 9)] * 300 + [(i, 0, 9) for i in range(400)] + [(i, 0, 4) for i in range(90)]
    parts = X.cut(spark.createDataFrame(rows, "doc_id long, start long, length long"))
    got = X.ranked(parts, ["doc_id", "start"], len(rows)).collect()
    assert sorted((r.length, r["rank"]) for r in got) == [(4, i) for i in range(90)] + [(9, i) for i in range(1400)]
    same = [r["rank"] for r in got if r.doc_id == 7 and r.length == 9]
    assert len(same) == 301 and sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, _, _ in rows)
