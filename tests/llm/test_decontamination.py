"""Decontamination against a brute-force version, with verbatim, re-parameterised, inconsistent and clean documents."""

import random
import re

from quillmark.llm import decontamination as X

VOCABULARY = [a + b for a in "ba ke li mo nu ra se ti".split() for b in "dor fin gal hem jos kut lan mer pon rus".split()]


def sentence(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n)).capitalize() + "."


def brute(doc, item, width=8, least_words=5, least_cover=0.5):
    """All windows of the item against all windows of the document, word by word."""

    def canonical(text):
        out, start = [], True
        for raw in (text or "").split():
            kind, bare, ends = X.word_class(raw)
            kind = (X.LITERAL if start else X.NAME) if kind == X.CAPITAL else kind
            out.append((kind, bare if kind == X.LITERAL else None, bare))
            start = ends
        return out

    d, q = canonical(doc), canonical(item)
    w = min(width, len(q))
    if len(q) < least_words:  # a whole line of it
        bare = lambda t: [x for x in (re.sub(r"\W+", "", w.casefold()) for w in t.split()) if x]
        return (1.0, 1, 0, 0) if bare(item or "") and any(bare(line) == bare(item) for line in (doc or "").split("\n")) else None
    n_literal = [sum(x[0] == X.LITERAL for x in q[i : i + w]) for i in range(len(q) - w + 1)]
    hits = [(w, p, i) for i in range(len(q) - w + 1) if n_literal[i] for p in range(len(d) - w + 1) if all(a[:2] == b[:2] for a, b in zip(q[i : i + w], d[p : p + w], strict=True))]
    if not any(n_literal[i] >= min(-(-w // 2), max(n_literal)) for _, _, i in hits):
        return None
    covered, kept, slots, changed = X.consistent(X.Item(0, [x[0] for x in q], [x[2] for x in q]), hits, [x[2] for x in d])
    return (len(covered) / len(q), kept, slots, changed) if hits and len(covered) >= least_cover * len(q) else None


def test_word_classes():
    assert [X.word_class(w)[0] for w in ("12", "3,500.", "$4.99", "5%", "kg", "Miles,", "Anna", "anna", "(7)", "1st")] == [X.NUMBER] * 4 + [X.UNIT] * 2 + [X.CAPITAL, X.LITERAL, X.NUMBER, X.NUMBER]


def test_find_and_drop(spark):
    rng = random.Random(12)
    question = "Yesterday Anna bought 12 apples and 7 pears for her neighbour Boris while the old market closed. Later Anna gave 7 pears back and kept 12 apples for 3 days."
    swapped = question.replace("Anna", "Clara").replace("Boris", "Otto").replace("12", "45").replace("7", "19")
    dense = "They say Anna paid Boris 7 coins so Boris owed Anna 7 coins while Anna lent Boris 7 coins before Boris sent Anna 7 coins"
    broken = "They say Anna paid Boris 7 coins so Otto owed Clara 8 coins while Olga lent Peter 9 coins before Maria sent Simon 11 coins"
    items = [(i, sentence(rng, rng.randrange(8, 40)) + " " + sentence(rng, 12)) for i in range(30)] + [(100, question), (101, "too short"), (102, None), (103, "just six words make this item"), (104, ""), (105, dense)]
    docs = [(i, " ".join(sentence(rng, 15) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    docs += [(200 + i, f"{sentence(rng, 20)} {items[i][1]} {sentence(rng, 20)}") for i in range(30)]
    docs += [(300, f"{sentence(rng, 9)} {swapped} {sentence(rng, 9)}"), (301, f"{sentence(rng, 9)} {broken} {sentence(rng, 9)}"), (302, question), (303, None), (304, ""), (305, "and just six words make this item too"), (306, "too short"), (302, question), (None, question)]
    docs += [(307, f"{sentence(rng, 10)} " * 20_000 + question + f" {question}" * 50)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (2_000_000, 400):  # one block, and several
        got = sorted(((r.doc_id or -1, r.item_id), round(r.coverage, 9), r.n_windows, r.n_slots, r.n_changed) for r in X.find_leaks(df, bench, block_words=words).collect())
        want = []
        for d, t in docs[:-1]:
            for i, q in items:
                if (found := brute(t, q)) is not None:
                    want.append(((d if d is not None else -1, i), round(found[0], 9), *found[1:]))
        assert [g for g in got if g[0][0] != 307] == sorted(want)
        pairs = {g[0]: g for g in got}
        assert pairs[300, 100][4] > 0 and pairs[302, 100][4] == 0 and (307, 100) in pairs and (301, 105) not in pairs and (305, 103) in pairs
        assert {d for (d, _) in pairs} == {*range(200, 230), 300, 302, 305, 306, 307, -1}
    kept = X.drop_leaks(df, bench).collect()
    assert {r.doc_id for r in kept} == {*range(60), 301, 303, 304}
    assert X.find_leaks(df.limit(0), bench).count() == 0 and X.find_leaks(df, bench.limit(0)).count() == 0 and X.drop_leaks(df, bench.limit(0)).count() == df.count()


def test_short_items_slot_heavy_items_and_clashes(spark):
    rng = random.Random(13)
    heavy = "compute 12 + 34 then 56 over 78 and 90 with 11 by 22 plus 33 less 44"
    docs = [(1, "intro\nParis, France!\nmore"), (2, "we saw paris france again"), (3, f"{sentence(rng, 20)} {heavy.replace('12', '99').replace('56', '17').replace('33', '71')} {sentence(rng, 20)}"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20")]
    bench = spark.createDataFrame([(1, "Paris France"), (2, heavy), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "21 22 23 24 25 26 27 28 29")], "item_id long, text string")
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, found_items int")
    assert {(r.doc_id, r.item_id, r.n_changed > 0) for r in X.find_leaks(df, bench).collect()} == {(1, 1, False), (3, 2, True), (4, 3, False)}
    kept = X.drop_leaks(df, bench)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, docs[1][1], 5)]


def test_planted_copies_with_other_parameters():
    """Nine of ten items with new names and numbers are found, in documents of other prose; no other pair is."""
    rng = random.Random(14)
    names = ["Anna", "Boris", "Clara", "Dmitri", "Emma", "Felix", "Greta", "Henrik"]
    question = lambda words, who, n: " ".join(w if i % 9 else (who[i // 9 % len(who)] if i % 2 else str(n[i // 9 % len(n)])) for i, w in enumerate(words, 1))
    items, texts = [], []
    for i in range(200):
        words = rng.choices(VOCABULARY, k=40)
        items.append((i, question(words, rng.sample(names, 4), rng.sample(range(10, 99), 4))))
        texts.append(f"{sentence(rng, 30)} so {question(words, rng.sample(names, 4), rng.sample(range(100, 999), 4))} {sentence(rng, 30)}")
    texts += [sentence(rng, 100) for _ in range(200)]
    found = X.leaks(texts, X.Block(items, 8, 5, 0.5), X.Lexicon(), 0.5)
    caught = sum(any(f["item_id"] == i and f["n_changed"] for f in found[i]) for i in range(200))
    assert caught >= 180 and sum(len(f) for f in found) == sum(any(f["item_id"] == i for f in found[i]) for i in range(200))


def test_one_instruction_for_all_items():
    """An instruction that 5,000 items and 2,000 texts share makes no pairs, and does not hide copies."""
    import time

    rng = random.Random(15)
    instruction = sentence(rng, 25)
    items = [(i, f"{instruction} {sentence(rng, 40)}") for i in range(5000)]
    began = time.time()
    block = X.Block(items, 8, 5, 0.5)
    texts = [f"{instruction} {sentence(rng, 40)}" for _ in range(2000)] + [f"{sentence(rng, 9)} {items[i][1]}" for i in range(0, 5000, 100)]
    found = X.leaks(texts, block, X.Lexicon(), 0.5)
    assert [[f["item_id"] for f in x] for x in found] == [[]] * 2000 + [[i] for i in range(0, 5000, 100)]
    assert all(f["coverage"] == 1.0 for x in found for f in x) and time.time() - began < 60
