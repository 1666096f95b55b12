"""Panels of one row a work: the same scores and recalls as the relational way, and no table of works and assignments."""

import random

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.functions.words import function_words
from quillmark.operators import attribution as A
from quillmark.operators import panels as P
from quillmark.operators import resampling as R
from quillmark.plans import cases as K

WORDS = sorted(set(function_words("en")))


def panel(spark, works=5):
    rng = random.Random(7)
    likes = {"ann": WORDS[:40], "bob": WORDS[20:60], "cyd": WORDS[50:90]}
    rows = [(f"{a}/{w}/{c}", f"{a}/{w}", a, " ".join(rng.choices([*likes[a], "Zebra", "x-ray"], k=40))) for a in likes for w in range(works) for c in range(1 + w % 3)]
    return spark.createDataFrame([*rows, ("ann/none/0", "ann/none", "ann", "zebra")], "chunk_id string, work_id string, author string, text string")


def test_scores_and_recalls_are_those_of_the_relational_way(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 3)
    monkeypatch.setattr(P, "SENT", 16 * 5)  # five orders a pass
    chunks = panel(spark)
    long = K.work_vectors(chunks, "fw_fixed").cache()
    works = chunks.select("work_id", "author").distinct()
    labels = sorted((r.work_id, r.author) for r in works.collect())
    want = R.panel_recalls(long, [w for w, _ in labels], R.random_orders([a for _, a in labels], 12, 42))
    scores = {(r.work_id, r.candidate): r.score for r in A.held_out_cosine(long, works).collect()}
    for rows in (P.packed_counts(chunks, T.hyphen_words(F.col("text")), WORDS), P.packed(long, chunks, WORDS)):
        own = P.Panel(rows, len(WORDS))
        assert own.authors == ["ann", "bob", "cyd"] and own.works.tolist() == [6, 5, 5]
        assert [own.authors[c] for c in own.labels] == [a for _, a in labels]
        assert np.allclose(own.recalls(own.random_orders(12, 42)), want, atol=1e-12)
        got = {(r.work_id, r.candidate): r.score for r in own.held_out().collect()}
        assert got.keys() == scores.keys() and all(abs(got[k] - v) < 1e-9 for k, v in scores.items())
        own.close()


def test_gate_sends_no_table_of_works_and_assignments(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_WORKS", 1)  # any panel is a large one
    sent, make = [], SparkSession.createDataFrame

    def watched(self, data, *a, **b):
        sent.append(len(data) if hasattr(data, "__len__") else 0)
        return make(self, data, *a, **b)

    chunks = panel(spark)
    monkeypatch.setattr(SparkSession, "createDataFrame", watched)
    found = K.gate(chunks, K.CaseSpec("three", ("ann", "bob", "cyd"), n_random=50), "fw_fixed")
    assert found["permutation_p"] <= 0.05 and max(sent, default=0) <= len(WORDS)


def test_two_authors_of_many_works(spark):
    """The number of assignments of a large panel is never written out."""
    rows = P.packed_counts(panel(spark).where("author <> 'cyd' and work_id <> 'ann/none'"), T.hyphen_words(F.col("text")), WORDS)
    own = P.Panel(rows, len(WORDS))
    spec = K.CaseSpec("two", ("ann", "bob"), max_exact=252)
    assert K.permutation(own, 1.0, spec) in (1 / 252, 2 / 252)  # all 252 assignments: the labels as they are, and swapped
    assert K.permutation(own, 1.0, K.CaseSpec("two", ("ann", "bob"), max_exact=9, n_random=30)) >= 1 / 31
    own.close()
