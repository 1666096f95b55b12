"""Named analyses on worked values and against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import attribution as A
from quillmark.operators import vocabulary as V
from quillmark.plans import studies as ST


def test_typicality_and_outsiders(spark):
    rows = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 1.0), ("b", "y", 0.0), ("c", "x", 1.0)], "work_id string, label string, p double")
    got = {r.work_id: r for r in ST.typicality(rows).collect()}
    assert got["a"][1:4] == (0.5, 1.0, 0.0) and abs(got["a"].neg_entropy + np.log(2)) < 1e-12
    assert got["b"][1:] == (1.0, 1.0, 1.0, 0.0) and got["c"][1:] == (1.0, 1.0, 1.0, 0.0)
    bits = {r.work_id: r.bits for r in ST.posterior_entropy(rows).collect()}
    assert abs(bits["a"] - 1) < 1e-12 and bits["b"] == 0
    marked = ST.typicality(rows).withColumn("member", F.col("work_id") != "a")
    assert {r.measure: r.auc for r in ST.outsider_auc(marked).collect()} == {"max_prob": 1.0, "top2_mass": 0.5, "margin": 1.0, "neg_entropy": 1.0}
    assert ST.typicality(rows.limit(0)).count() == 0 and [r.auc for r in ST.outsider_auc(marked.limit(0)).collect()] == [None] * 4


def test_identifiability(spark):
    rows = spark.createDataFrame([("a", "p", "1", "u", None), ("a", "p", "2", "v", "x"), ("b", "q", "3", "u", "y")], "author string, period string, edition string, topic string, gap string")
    got = {r.factor: tuple(r)[1:] for r in ST.identifiability(rows, ["period", "edition", "topic", "gap"]).collect()}
    assert got["period"] == (True, True, True, True) and got["edition"] == (True, True, False, False)
    assert got["topic"] == (True, False, False, False) and got["gap"] == (False,) * 4
    assert tuple(ST.identifiability(rows.limit(0), ["period"]).first())[1:] == (False,) * 4


def test_cross_level_against_brute_force(spark):
    rng = np.random.default_rng(3)
    works = [(i, f"a{i % 3}", f"l{i % 2 if i % 3 else 0}") for i in range(18)]  # a0 has works of one level alone
    x = rng.integers(0, 3, size=(18, 6)).astype(float)
    x[:, 0] = 1
    values = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(18) for j in range(6) if x[i, j]], "work_id long, term string, value double")
    table = spark.createDataFrame(works, "work_id long, author string, level string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i, _, level in works:
        for c in ("a0", "a1", "a2"):
            rest = [j for j, a, other in works if a == c and other != level]
            if rest:
                s = unit[rest].sum(axis=0)
                want[i, c] = unit[i] @ s / np.linalg.norm(s)
    scores = ST.cross_level_scores(values, table)
    got = {(r.work_id, r.candidate): r.score for r in scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    right = sum(max((c for k, c in want if k == i), key=lambda c: (want[i, c], c)) == a for i, a, _ in works)
    recall = ST.cross_level_recall(scores).collect()
    assert sum(r.works for r in recall) == 18 and sum(r.right for r in recall) == right


def test_cross_level_from_narrow_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"a{i % 3}", i, f"l{i % 2 if i % 3 else 0}", " ".join(rng.choice(list("abcdefgh"), 12))) for i in range(30)] + [("a1", 90, "l0", "zz"), ("a2", 91, "l1", "...")]
    table = spark.createDataFrame(rows, "author string, work_id long, level string, text string").repartition(3)
    counts = V.counts(table, T.words(F.col("text"))).cache()
    chosen = counts.join(V.most_frequent(counts, 6).select("term"), "term")
    old = ST.cross_level_scores(V.relative(chosen, V.sizes_of(counts)), table.drop("text")).cache()
    want = {(r.work_id, r.author, r.level, r.candidate): r.score for r in old.collect()}
    recall = {tuple(r) for r in ST.cross_level_recall(old.withColumn("score", F.round("score", 6))).collect()}
    monkeypatch.setattr(V, "counts", None)  # no relation of works and terms
    new = ST.cross_level_shares(table, 6)
    got = {(r.work_id, r.author, r.level, r.candidate): r.score for r in ST.long_scores(*new).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert {tuple(r) for r in ST.best_of_scores(*new, 6).collect()} == recall


def test_comparison_of_two_models(spark):
    rows = [(i, f"a{i % 4}", i % 4 < 3, i % 8 < 2) for i in range(40)]
    a = spark.createDataFrame([(w, x, p) for w, x, p, _ in rows], "work_id long, author string, correct boolean")
    b = spark.createDataFrame([(w, x, q) for w, x, _, q in rows], "work_id long, author string, correct boolean")
    r = ST.clustered_comparison(a, b, 200).first()
    assert (r.works, r.accuracy_a, r.accuracy_b, r.only_a, r.only_b) == (40, 0.75, 0.25, 20, 0)
    assert abs(r.mcnemar_p - 2 * 0.5**20) < 1e-12 and r.lo <= r["median"] <= r.hi and 0 <= r.share_at_most_zero <= 1
    same = ST.clustered_comparison(a, a, 50).first()
    assert (same.only_a, same.mcnemar_p, same.lo, same.hi, same.significant, same.share_at_most_zero) == (0, 1.0, 0.0, 0.0, False, 1.0)


def test_held_out_cosine_distance_and_self_rate(spark):
    z = spark.createDataFrame([(w, a, t, v) for w, a, x in ((1, "a", (1, 0)), (2, "a", (1, 1)), (3, "b", (0, 1))) for t, v in zip("pq", map(float, x), strict=True)], "work_id long, author string, term string, z double")
    got = {(r.work_id, r.candidate): r.distance for r in A.held_out_delta(z, "cosine").collect()}
    assert abs(got[1, "a"] - (1 - 1 / np.sqrt(2))) < 1e-12 and abs(got[1, "b"] - 1) < 1e-12
    assert (3, "b") not in got and abs(got[3, "a"] - (1 - 1 / np.sqrt(5))) < 1e-12
    rates = {r.author: tuple(r)[1:] for r in ST.self_rate(A.nearest(A.held_out_delta(z, "cosine")).join(z.select("work_id", "author").distinct(), "work_id")).collect()}
    assert rates["b"] == (0, 1, 0.0) and rates["a"] == (2, 2, 1.0)  # work 2 is as near to both: the first candidate
