"""Held-out trigram cosines from texts: the scores of the relational way, without its relation of works and trigrams."""

import random

from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import attribution as A
from quillmark.operators import chars as CH
from quillmark.operators import vocabulary as V
from quillmark.plans import registry as R


def test_scores_are_those_of_the_relational_way(spark, monkeypatch):
    monkeypatch.setattr(CH, "MOST_WORKS", 3)
    rng = random.Random(4)
    rows = [(a, f"{a}{w}", "".join(rng.choices(letters, k=90))) for a, letters in (("x", "abcé \n"), ("y", "bcd😀 "), ("z", "ade  ß")) for w in range(4)]
    rows += [("x", "x0", "aab cab"), ("z", "tiny", "ab"), ("solo", "solo", "abc dea")]  # a work of two texts, one without trigrams, an author's only one
    works = spark.createDataFrame(rows, "author string, work_id string, text string").repartition(3)
    units = works.select("work_id", "author").distinct()
    table = V.counts(works, T.char_ngrams(F.lower(F.col("text")), 3)).cache()
    for by_work, vocab in ((False, V.pooled_vocabulary(table, 2, 40)), (True, V.work_vocabulary(table, V.sizes_of(table), 40))):
        terms = {tuple(map(ord, r.term)): r.idf for r in vocab.collect()}
        known, idf = CH.trigram_vocabulary(CH.whole_works(works), 40, by_work)
        got = {(g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF): v for g, v in zip(known.tolist(), idf.tolist(), strict=True)}
        assert got.keys() == terms.keys() and all(abs(got[k] - v) < 1e-12 for k, v in terms.items())
        want = {(r.work_id, r.author, r.candidate): r.score for r in A.held_out_cosine(V.tfidf(table, vocab), units).collect()}
        got = {(r.work_id, r.author, r.candidate): r.score for r in CH.trigram_cosines(works, 40, by_work).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_models_make_no_relation_of_works_and_terms(spark, monkeypatch):
    rows = [(a, f"{a}{w}", f"{a} said that it was {w} o'clock and {a} left") for a in ("ann", "bob") for w in range(3)]
    works = spark.createDataFrame(rows, "author string, work_id string, text string")
    monkeypatch.setattr(V, "counts", None)
    for spec in ("delta:5", "delta_cos:5", "char_cos"):
        for weighting in ("none", "work_balanced"):
            assert R.held_out_scores(spec, works, weighting).select("work_id").distinct().count() == 6


def test_best_centroids_are_those_of_the_relational_way(spark, monkeypatch):
    monkeypatch.setattr(CH, "MOST_WORKS", 3)
    rng = random.Random(5)
    rows = [(a, f"{a}{w}", "".join(rng.choices("abcd\u00e9 \n", k=60))) for a in "xyz" for w in range(5)]
    rows += [("z", "tiny", "ab"), ("solo", "solo", "abc dea"), ("other", "other", "QQQQ"), ("x", "blank", " \n ")]
    works = spark.createDataFrame(rows, "author string, work_id string, text string").repartition(3)
    table = V.counts(works, T.char_ngrams(F.lower(F.col("text")), 3)).cache()
    values = V.tfidf(table, V.pooled_vocabulary(table, 2, 40))
    want = {r.work_id: r for r in A.best(A.cosine_scores(values, A.cosine_centroids(values, works.select("work_id", "author")))).collect()}
    monkeypatch.setattr(V, "counts", None)  # no relation of works and trigrams
    got = {r.work_id: r for r in CH.nearest_trigrams(works, 40).collect()}
    assert got.keys() == want.keys() and all(got[k].candidate == r.candidate and abs(got[k].score - r.score) < 1e-9 for k, r in want.items())
