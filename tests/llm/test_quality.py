"""Quality rules against counts by brute force, and verdicts on planted junk."""

import random
import re

from pyspark.sql import Row

from quillmark.llm import quality

WORDS = "oak river stone cloud lantern meadow copper window harbor silver thread mountain paper candle garden winter".split()


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def prose(rng, n=120):
    return "".join(rng.choice(WORDS) + str(rng.randrange(10**6)) * (rng.random() < 0.2) + rng.choice([" ", " ", " ", ".\n"]) for _ in range(n))


def test_counts_match_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c a b c a b", "x\nx\n\nx\n y", "é b\x0bc", "a a a a a", "#*$%&|<> <>"]
    texts += ["".join(rng.choice(["ab ", "cd ", "ef\n", "# ", "\x0c"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    for t, row in zip(texts, quality.text_statistics(texts).tolist(), strict=True):
        assert tuple(row[:5]) == brute(t), t
    assert quality.text_statistics([]).shape == (0, len(quality.NAMES))


def test_long_text():
    import tracemalloc

    rng = random.Random(4)
    text = " ".join(f"{w}{rng.randrange(99)}" for w in rng.choices(WORDS, k=3_000_000))
    tracemalloc.start()
    row = quality.text_statistics([text])[0]
    assert row[0] == 3_000_000 and tracemalloc.get_traced_memory()[1] < 14 * len(text)
    tracemalloc.stop()


def test_verdicts(spark):
    rng = random.Random(5)
    good = [Row(doc_id=i, text=prose(rng), doc=1) for i in range(300)]
    bad = [Row(doc_id=1000 + i, text=" ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in prose(rng).split()), doc=1) for i in range(60)]
    odd = [Row(doc_id=2000, text=None, doc=1), Row(doc_id=2001, text="", doc=1), Row(doc_id=None, text=prose(rng), doc=1), Row(doc_id=0, text=good[0].text, doc=1), Row(doc_id=2002, text="word " * 400_000, doc=1)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, doc int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(docs, labels).collect()
    assert len(rows) == 365
    assert sum(not r.kept for r in rows if r.doc_id is not None and r.doc_id < 1000) <= 6
    assert not any(r.kept for r in rows if r.doc_id is not None and 1000 <= r.doc_id <= 2002)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert len({r.kept for r in rows if r.doc_id == 0}) == 1
    bare = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.score is None for r in bare)
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
