"""Weights, vocabularies, distances, folds, classifiers, cases on worked values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import alignment as AL
from quillmark.operators import attribution as A
from quillmark.operators import corpus as C
from quillmark.operators import models as ML
from quillmark.operators import vocabulary as V
from quillmark.plans import analyze as AN
from quillmark.plans import cases as K
from quillmark.plans import registry as R
from quillmark.sources import files as FS


def chunks(spark, rows):
    return spark.createDataFrame(rows, "author string, work_id string, ordinal int, text string")


def test_work_weights(spark):
    rows = chunks(spark, [("a", "w1", 0, "x"), ("a", "w1", 1, "x"), ("a", "w2", 0, "x"), ("b", "w3", 0, "x"), ("b", "w4", 0, "x")])
    got = C.work_weights(rows).groupBy("author").agg(F.sum("weight").alias("s")).collect()
    assert {r.author: r.s for r in got} == {"a": 2.0, "b": 2.0}
    with pytest.raises(Exception, match="several authors"):
        C.work_authors(chunks(spark, [("a", "w", 0, "x"), ("b", "w", 0, "x")])).collect()


def test_train_vocabulary_alone(spark):
    train = chunks(spark, [("a", "w1", 0, "alpha alpha beta"), ("b", "w2", 0, "beta gamma")])
    vocab = V.most_frequent(V.counts(train, T.words(F.col("text"))), 10)
    test = chunks(spark, [("c", "w3", 0, "zzz zzz alpha")])
    got = V.relative(V.selected(V.counts(test, T.words(F.col("text"))), vocab.select("term")), V.events(test, T.words(F.col("text")))).collect()
    assert [(r.term, round(r.value, 6)) for r in got] == [("alpha", round(1 / 3, 6))]


def test_vocabulary_ignores_chunk_cuts_for_words_only(spark):
    whole = chunks(spark, [("a", "w1", 0, "a b c d"), ("b", "w2", 0, "a b c d")])
    cut = chunks(spark, [("a", "w1", 0, "a b"), ("a", "w1", 1, "c d"), ("b", "w2", 0, "a b c d")])
    fit = lambda rows, n: {(r.term, round(r.mean_share, 9)) for r in V.work_vocabulary(V.counts(rows, T.ngrams(T.words(F.col("text")), n)), V.events(rows, T.ngrams(T.words(F.col("text")), n))).collect()}
    assert fit(whole, 1) == fit(cut, 1) and fit(whole, 2) != fit(cut, 2)


def corpus(spark):
    return FS.demo_corpus(spark, works=3, words=400)


def brute_delta(rows, most):
    import re
    from collections import Counter

    toks = {r.work_id: re.findall(r"\w+", r.text.lower()) for r in rows}
    total = Counter(t for ts in toks.values() for t in ts)
    vocab = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]
    works = sorted(toks)
    x = np.array([[toks[w].count(t) / len(toks[w]) for t in vocab] for w in works])
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1e-9, std)
    author = {r.work_id: r.author for r in rows}
    out = {}
    for i, w in enumerate(works):
        for a in set(author.values()):
            own = [j for j, v in enumerate(works) if author[v] == a and v != w]
            if own:
                out[w, a] = np.abs(z[i] - z[own].mean(axis=0)).mean()
    return out


def test_held_out_delta_is_a_refit(spark):
    rows = corpus(spark)
    _, z, _ = A.delta_model(rows, 12)
    got = {(r.work_id, r.candidate): r.distance for r in A.held_out_delta(z).collect()}
    want = brute_delta(rows.collect(), 12)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_held_out_cosine_is_a_refit(spark):
    rng = np.random.default_rng(0)
    x = rng.random((6, 4))
    author = ["a", "a", "a", "b", "b", "c"]
    values = spark.createDataFrame([(f"w{i}", f"t{j}", float(x[i, j])) for i in range(6) for j in range(4)], "work_id string, term string, value double")
    units = spark.createDataFrame([(f"w{i}", a) for i, a in enumerate(author)], "work_id string, author string")
    got = {(r.work_id, r.candidate): r.score for r in A.held_out_cosine(values, units).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(6):
        for a in "abc":
            own = [j for j in range(6) if author[j] == a and j != i]
            if own:
                c = u[own].sum(axis=0)
                assert abs(got[f"w{i}", a] - u[i] @ c / np.linalg.norm(c)) < 1e-9
            else:
                assert (f"w{i}", a) not in got


def test_models_find_the_styles(spark):
    rows = corpus(spark)
    for spec in ("delta:12", "delta_cos:12", "char_cos"):
        r = AN.evaluate(rows, [spec]).collect()
        assert len(r) == 6 and all(x.correct for x in r), spec
    table = AN.sweep_table(AN.evaluate(rows, ["delta:12", "majority"]), "delta:12").collect()
    assert table[0].spec == "delta:12" and table[1].accuracy == 0.5
    out = AN.analyze(rows.withColumn("text", F.concat("text", F.lit(" "), "work_id")), "periodic/work1", "delta:12").collect()
    assert [r.candidate for r in sorted(out, key=lambda r: r.place)] == ["periodic", "fragmented"] and all(r.abstained and r.winner is None for r in out)
    with pytest.raises(AN.CorpusError):
        AN.analyze(rows.unionByName(rows.where("work_id = 'periodic/work1'").withColumn("work_id", F.lit("copy"))), "copy")


def test_ranking_needs_no_grid(spark, monkeypatch):
    rows = corpus(spark)
    chunks = C.chunk_by_words(rows, 60).withColumn("chunk_id", F.concat_ws("#", "work_id", F.col("ordinal").cast("string")))
    panel = rows.where("work_id <> 'periodic/work1'")
    stats, _, centroids = A.delta_model(panel, 12)
    own, terms = chunks.where("work_id = 'periodic/work1'"), T.words(F.col("text"))
    values = V.relative(V.counts(own, terms, "chunk_id").join(stats.select("term"), "term"), V.events(own, terms, "chunk_id"), "chunk_id")
    z = V.zscores(values, stats, own.select("chunk_id"), "chunk_id")
    want = {r.candidate: r.d for r in A.delta_distances(z, centroids, unit="chunk_id").groupBy("candidate").agg(F.avg("distance").alias("d")).collect()}
    monkeypatch.setattr(V, "zscores", None)
    got = {r.candidate: r.distance for r in AN.delta_ranking(chunks, panel, "periodic/work1", 12).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_case(spark):
    rows = C.chunk_by_words(FS.demo_corpus(spark, works=4, words=300), 60).withColumn("chunk_id", F.concat_ws("#", "work_id", F.col("ordinal").cast("string")))
    target = rows.where("work_id = 'periodic/work0'").withColumn("work_id", F.lit("target/work")).withColumn("chunk_id", F.concat(F.lit("t"), "chunk_id"))
    panel = rows.where("work_id <> 'periodic/work0'")
    passport = K.run(spark, panel, K.CaseSpec("demo", ("periodic", "fragmented"), feature_sets=("char3",)), target)
    assert passport["decision"] == "inconclusive" and passport["winner"] is None and passport["abstained"]
    assert passport["diagnostic_ranking"][0][0] == "periodic" and passport["gates"]["char3"]["work_macro_recall"] == 1.0
    assert abs(passport["gates"]["char3"]["permutation_p"] - 1 / 35) < 1e-9 or passport["gates"]["char3"]["permutation_p"] <= 0.06


def test_logistic_minimises_the_stated_loss(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(i, int(k), 1.0 + i % 2, Vectors.dense(v)) for i, (k, v) in enumerate(zip(y, x, strict=True))], ["work_id", "label", "weight", "features"])
    m = ML.logistic(rows, 0.7)
    w, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    p = np.exp(x @ w.T + b)
    p /= p.sum(axis=1, keepdims=True)
    weight = 1.0 + np.arange(60) % 2
    grad = 0.7 * ((p - np.eye(3)[y]) * weight[:, None]).T @ x + w
    assert np.abs(grad).max() < 1e-3


def test_svm_and_assignment():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(-2, 1, (20, 2)), rng.normal(2, 1, (20, 2))])
    y = np.repeat([-1.0, 1.0], 20)
    w = ML.squared_hinge(x, y)
    z = np.hstack([x, np.ones((40, 1))])
    assert np.abs(w - 2 * z.T @ (y * np.maximum(0, 1 - y * (z @ w)))).max() < 1e-4
    assert (np.sign(z @ w) == y).mean() > 0.95


def test_projection_removes_the_edition(spark):
    rng = np.random.default_rng(3)
    rows = [(f"w{i}", d, (rng.normal(size=5) * 0.01 + np.eye(5)[0] * i + np.eye(5)[4] * (3.0 if d == "old" else -3.0)).tolist()) for i in range(6) for d in ("old", "new")]
    df = spark.createDataFrame(rows, "work_id string, domain string, x array<double>")
    directions = ML.residual_projection(df)
    assert directions.shape == (5, 1) and abs(abs(directions[4, 0]) - 1) < 1e-3
    assert all(abs(r.x[4]) < 0.1 for r in ML.residualised(df, directions).collect())


def test_calibration(spark):
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(400, 3))
    y = np.array([rng.choice(3, p=np.exp(v) / np.exp(v).sum()) for v in logits])
    rows = spark.createDataFrame([(i, k, float(3 * logits[i, k]), int(y[i])) for i in range(400) for k in range(3)], "unit int, label int, score double, true_label int")
    assert 2 < ML.temperature(rows) < 4.5
    p = ML.isotonic(rows, 3).groupBy("unit").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in p)


def test_alignment_and_compression(spark):
    common = " ".join(f"слово{i}" for i in range(120))
    pairs = spark.createDataFrame([(1, f"Preface here {common}", f"Міръ {common.upper()}")], "pair_id long, text_a string, text_b string")
    blocks = AL.aligned_blocks(pairs, 80)
    assert [(r.a_start, r.b_start, r.n_words) for r in blocks.collect()] == [(2, 1, 120)]
    assert AL.normal_word("Міръ") == "мир"
    assert AL.aligned_texts(pairs, blocks).first().text_a == common
    ref = spark.createDataFrame([("a", "w1", "the cat sat on the mat " * 30), ("b", "w2", "zq xv jk wp lm 93 71 " * 30)], "candidate_id string, work_id string, text string")
    target = spark.createDataFrame([("t", "the cat sat on the mat and the cat")], "work_id string, text string")
    assert [r.candidate_id for r in AL.compression_ranking(target, ref).orderBy("place").collect()] == ["a", "b"]


def test_registry():
    assert R.resolve("delta:150")[1] == 150 and R.resolve("delta_cos:300")[0].key == "delta_cos"
    for bad in ("delta:0", "delta", "nothing", ""):
        with pytest.raises(ValueError):
            R.resolve(bad)
    with pytest.raises(ValueError):
        R.route("char_cos", "none", deploy=True)
    c = R.Config().set("seed=7", "blocks=length")
    assert c.seed == 7 and c.blocks == ("length",) and c.digest() != R.Config().digest() and R.Config(title="x").digest() == R.Config().digest()
    assert R.Cell(True, True, True).weighting() == "work_balanced" and R.Cell(weights=True).name == "A1"
    with pytest.raises(ValueError):
        R.Cell(weights=True).weighting()
    with pytest.raises(ValueError):
        R.block_registry(R.Config(blocks=()))
