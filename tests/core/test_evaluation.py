"""Metrics, resampling, segments, overlap, quality, benchmarks, sources and streams on worked values."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import benchmark as B
from quillmark.operators import metrics as M
from quillmark.operators import overlap as O
from quillmark.operators import quality as Q
from quillmark.operators import resampling as RS
from quillmark.operators import segments as S
from quillmark.plans import registry as R
from quillmark.sources import files as FS
from quillmark.streaming import scoring as ST


def scores(spark, rows):
    return spark.createDataFrame(rows, "work_id string, true_label int, label int, p double")


def test_ties(spark):
    rows = scores(spark, [("w", 1, 0, 0.5), ("w", 1, 1, 0.5)])
    r = M.worst_tie_rank(rows).first()
    assert (r.pred_label, r["rank"]) == (0, 2)
    assert M.top_candidates(rows, 1).first().candidates[0].label == 0 and M.margin(rows).first().margin == 0
    assert M.violations(scores(spark, [("a", 0, 0, 0.7), ("b", 0, 0, float("nan"))])).count() == 2


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, None)], "true_label int, pred_label int")
    labels = spark.createDataFrame([(0,), (1,), (2,), (3,)], "label int")
    assert M.accuracy(rows).first()[0] == 0.5
    per = {r.label: r for r in M.per_label(rows, labels).collect()}
    assert per[0].recall == 0.5 and per[3].recall is None and per[2].f1 == 0 and round(per[1].f1, 6) == round(2 / 3, 6)
    assert M.confusion(rows.dropna(), labels).agg(F.sum("n"), F.count("n")).first()[:] == (3, 16)
    assert M.accuracy(rows.limit(0)).first()[0] == 0.0
    e = spark.createDataFrame([(1.0, True), (0.9, True), (0.0, False)], "conf double, correct boolean")
    assert abs(M.calibration_error(e).first()[0] - 0.1 / 3) < 1e-9
    a = spark.createDataFrame([(0.1, False), (0.4, False), (0.4, True), (0.8, True), (-3.0, False)], "score double, positive boolean")
    assert abs(M.auc(a).first()[0] - (3 + 2.5) / 6) < 1e-9


def test_exact_tests(spark):
    cases = [(0, 0), (1, 0), (5, 5), (3, 12), (200, 260), (0, 2000)]
    df = spark.createDataFrame(cases, "b long, c long").withColumn("p", M.mcnemar_p(F.col("b"), F.col("c")))
    for r in df.collect():
        n = r.b + r.c
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(r.b, r.c) + 1)) / 2**n) if n else 1.0
        assert abs(r.p - want) <= 1e-9 + 1e-6 * want
    h = {r.name: r.holm for r in M.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")).collect()}
    assert {k: round(v, 9) for k, v in h.items()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    odds, p = M.fisher_p(8, 2, 1, 5)
    assert odds == 20 and abs(p - 0.0349650) < 1e-6


def test_bootstrap_repeats_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(f"a{i % 7}", bool(rng.random() < 0.7)) for i in range(60)]
    got = RS.clustered_ci(spark.createDataFrame(rows, "author string, correct boolean"), "author", 200).first()
    names = sorted({a for a, _ in rows})
    draw = np.random.default_rng(42)
    values = []
    for _ in range(200):
        picked = [names[i] for i in draw.choice(np.arange(7), size=7, replace=True)]
        own = [c for p in picked for a, c in rows if a == p]
        values.append(np.mean(own))
    lo, hi = np.percentile(values, [2.5, 97.5])
    assert abs(got.lo - lo) < 1e-9 and abs(got.hi - hi) < 1e-9 and abs(got.point - np.mean([c for _, c in rows])) < 1e-9


def test_permuted_recall_is_a_refit(spark):
    rng = np.random.default_rng(5)
    x = rng.random((6, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(f"w{i}", f"t{j}", float(u[i, j])) for i in range(6) for j in range(4)], "work_id string, term string, value double")
    sets, exact = RS.label_assignments([f"w{i}" for i in range(6)], 3)
    assert exact and len(sets) == 20
    table = spark.createDataFrame([(k, f"w{i}", "x" if f"w{i}" in s else "y") for k, s in enumerate(sets) for i in range(6)], "perm int, work_id string, label string")
    got = {r.perm: r.recall for r in RS.permuted_recall(vectors, table).collect()}
    for k, s in enumerate(sets):
        side = ["x" if f"w{i}" in s else "y" for i in range(6)]
        hits = {"x": [], "y": []}
        for i in range(6):
            cos = {}
            for c in "xy":
                own = u[[j for j in range(6) if side[j] == c and j != i]].sum(axis=0)
                cos[c] = u[i] @ own / np.linalg.norm(own)
            hits[side[i]].append(min(cos, key=lambda c: (-cos[c], c)) == side[i])
        assert abs(got[k] - np.mean([np.mean(v) for v in hits.values()])) < 1e-9


def spans(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "doc_id string, start int, end int, label string")


def test_segments(spark):
    t, p = spans(spark, [(0, 5, "a"), (5, 10, "b")]), spans(spark, [(0, 6, "a"), (6, 10, "b")])
    r = S.position_accuracy(t, p).first()
    assert r.accuracy == 0.9 and abs(r.macro_f1 - (10 / 11 + 8 / 9) / 2) < 1e-9
    assert abs(S.segment_scores(t, p, 0.7).first().mean_iou - (5 / 6 + 4 / 5) / 2) < 1e-9
    assert abs(S.segment_scores(t, p, 0.3).first().mean_iou - (5 / 6 + 4 / 5) / 2) < 1e-9
    assert S.boundary_scores(t, p).first().f1 == 0 and S.boundary_scores(t, p, 1).first().f1 == 1
    none = spans(spark, [(0, 10, "a")])
    assert S.boundary_scores(t, none).first().precision == 1 and S.boundary_scores(none, none).first().f1 == 1
    assert S.canonical(spans(spark, [(0, 2, "a"), (2, 4, "a"), (5, 6, "a")])).count() == 2
    assert {r.problem for r in S.span_problems(spans(spark, [(0, 2, "a"), (1, 4, "a"), (6, 6, "b"), (7, 9, "a")]), True).collect()} == {"overlap", "empty", "gap"}
    named = S.apply_mapping(spans(spark, [(0, 6, "y"), (6, 10, "x"), (10, 12, "z")]), S.label_mapping(t, spans(spark, [(0, 6, "y"), (6, 10, "x"), (10, 12, "z")])))
    assert {r.label for r in named.collect()} == {"a", "b", "unmatched:z"}
    rng = np.random.default_rng(6)
    for _ in range(30):
        cost = rng.integers(0, 9, size=(rng.integers(1, 5), rng.integers(1, 5))).astype(float)
        got = S.assignment(cost)
        from itertools import permutations

        n, m = cost.shape
        best = min(sum(cost[i, j] for i, j in zip(range(n), q, strict=False)) for q in permutations(range(m), n)) if n <= m else min(sum(cost[i, j] for j, i in zip(range(m), q, strict=False)) for q in permutations(range(n), m))
        assert len(got) == min(n, m) and sum(cost[i, j] for i, j in got) == best


def test_rolling_mean_repeats_edges(spark):
    for n in (1, 2, 3, 6):
        values = np.arange(n) ** 2.0
        df = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate(values)], "unit string, ordinal int, p double")
        for window in (1, 2, 3, 5, 8):
            k = min(window, n)
            k -= k % 2 == 0
            padded = np.pad(values, k // 2, mode="edge") if k > 1 else values
            want = np.convolve(padded, np.ones(k) / k, mode="valid") if k > 1 else values
            assert np.allclose([r.smooth for r in S.rolling_mean(df, window).orderBy("ordinal").collect()], want), (n, window)


def test_runs(spark):
    rows = spark.createDataFrame([("u", i, x, 0.9) for i, x in enumerate("hhxxxhxxh")], "unit string, ordinal int, label string, p double")
    assert [(r.start, r["end"]) for r in S.foreign_runs(rows, "h", 0.6, 3).collect()] == [(2, 4)]
    assert abs(S.foreign_fraction(rows, "h").first().fraction - 5 / 9) < 1e-9


def test_overlap(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.createDataFrame([("a/1", text), ("b/1", text), ("b/2", text + " " + " ".join(f"z{i}" for i in range(400))), ("c/1", " ".join(f"q{i}" for i in range(50))), ("c/2", "short one"), ("c/3", "Short, one!")], "work_id string, text string")
    assert {(r.first, r.copy) for r in O.exact_copies(rows).collect()} == {("a/1", "b/1")}
    near = {(r.a, r.b): r.coverage for r in O.near_duplicates(rows).collect()}
    assert near == {("a/1", "b/2"): 1.0}
    assert {(r.short, r.long) for r in O.containment(rows).collect()} == {("a/1", "b/2")}
    target = O.target_overlap(O.near_duplicates(rows), "b/2", rows.select("work_id"))
    assert [r.other for r in target.collect()] == ["a/1"]


def test_quality(spark):
    rows = spark.createDataFrame([("w1", "plain line\n<b>x</b> &amp; [[link]]\n----------------------------\n"), ("w2", "ISBN 5\n" + "line\n" * 250), ("w3", "")], "work_id string, text string")
    got = {(r.work_id, r.kind, r.line_number) for r in Q.line_findings(rows).collect()}
    assert got == {("w1", "html_tag", 2), ("w1", "html_entity", 2), ("w1", "wiki_link", 2), ("w1", "source_separator", 3), ("w2", "isbn_colophon", 1)}
    assert {r.code for r in Q.work_findings(rows).where("work_id = 'w3'").collect()} == {"empty"} and not Q.gate(Q.work_findings(rows)).first().passed
    half = " ".join(f"u{i}" for i in range(250))
    tails = Q.repeated_tail(spark.createDataFrame([("x", f"{half} {half}"), ("y", half)], "work_id string, text string")).collect()
    assert [(r.work_id, r.second_copy_offset, r.repeated) for r in tails] == [("x", 250, 250)]


def test_benchmark(spark):
    h = lambda c: c * 64
    docs = spark.createDataFrame([("doc_" + "a" * 16, "train", ["spoof"], "s", "1", h("1"), "w1", "p1", []), ("doc_" + "b" * 16, "blind", ["mixed_authorship"], "s", "2", h("1"), "w2", "p2", [(0, 3, "x"), (2, 5, "y")]), ("bad", "validation", ["other"], "s", "3", h("2"), "w1", "p3", [])], B.DOCUMENT)
    found = {(r.doc_id, r.problem) for r in B.manifest_findings(docs, ["spoof", "mixed_authorship", "idio_shift"]).collect()}
    assert ("bad", "doc_id") in found and ("bad", "unknown_task") in found and (None, "unused_task:idio_shift") in found and ("doc_" + "b" * 16, "span_overlap") in found
    assert {(r.by,) for r in B.role_leaks(docs).collect()} == {("sha256",)}
    truth = spark.createDataFrame([("d1", "a", None, [(0, 5, "x"), (5, 9, "y")]), ("d2", "b", None, [(0, 4, "x")])], B.TRUTH)
    sub = spark.createDataFrame([("d1", "a", None, [(0, 5, "x"), (5, 9, "y")]), ("d2", None, None, [(0, 4, "x")])], B.TRUTH)
    work = spark.createDataFrame([("d1", "w1"), ("d2", "w2")], "doc_id string, work_id string")
    got = {(r.endpoint, r.metric): r.value for r in B.score(truth, sub, work).collect()}
    assert got["author_label", "accuracy"] == 0.5 == got["author_label", "coverage"] == got["author_label", "macro_f1"] and got["spans", "accuracy"] == 1 == got["spans", "boundary_f1"]
    assert [r.side for r in B.id_findings(truth, sub.limit(1)).collect()] == ["missing"]
    with pytest.raises(ValueError):
        B.committed(b"x", "0" * 64)


def test_sources(spark, tmp_path):
    for a, w, t in (("x", "one", "text é"), ("x", "two", "more"), ("y", "one", "other")):
        (tmp_path / "raw" / a).mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / a / f"{w}.txt").write_text(t)
    assert sorted((r.author, r.work_id, r.text) for r in FS.raw_corpus(spark, str(tmp_path / "raw")).collect()) == [("x", "x/one", "text é"), ("x", "x/two", "more"), ("y", "y/one", "other")]
    (tmp_path / "raw" / "y" / "bad.txt").write_bytes(b"\xff")
    with pytest.raises(Exception, match="UTF-8"):
        FS.raw_corpus(spark, str(tmp_path / "raw")).collect()
    for a in ("x", "y", "unknown"):
        d = tmp_path / "frag" / a / "w"
        d.mkdir(parents=True)
        for i in range(6):
            (d / f"{i:03}.txt").write_text(f"chunk {i}\n")
    rows = FS.fragments(spark, str(tmp_path / "frag"))
    assert rows.count() == 12 and {(r.author, r.label) for r in rows.collect()} == {("x", 0), ("y", 1)} and FS.unknown_fragments(spark, str(tmp_path / "frag")).count() == 6
    with pytest.raises(Exception, match="too few"):
        FS.fragments(spark, str(tmp_path / "frag"), least_chunks=50).collect()
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "Infinity"):
        with pytest.raises(ValueError):
            FS.strict_json(bad)
    tables = {"m": spark.range(5).toDF("i")}
    token = FS.publish_model(tables, str(tmp_path / "model"))
    assert FS.load_model(spark, str(tmp_path / "model"), ["m"], token)["m"].count() == 5
    with pytest.raises(ValueError):
        FS.load_model(spark, str(tmp_path / "model"), ["m"], "0")
    docs = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h1")], "work_id string, text_sha256 string")
    full, new = FS.cached(docs, spark.createDataFrame([("h1", 1)], "text_sha256 string, rep int"), lambda df: df.select("text_sha256", F.lit(2).alias("rep")))
    assert sorted((r.work_id, r.rep) for r in full.collect()) == [("a", 1), ("b", 2), ("c", 1)] and [r.text_sha256 for r in new.collect()] == ["h2"]


def test_stream_scores_as_a_batch(spark, tmp_path):
    from quillmark.operators import attribution as A

    works = FS.demo_corpus(spark, works=3, words=200).cache()
    stats, _, centroids = A.delta_model(works, 10)
    score = ST.scorer(stats, centroids)
    works.select("work_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("work_id string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ST.score_stream(stream, score, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted((r.work_id, r.candidate, round(r.distance, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.work_id, r.candidate, round(r.distance, 9)) for r in score(works.select("work_id", "text")).collect())


def test_shuffled_rows_give_the_same(spark):
    from quillmark.operators import attribution as A

    works = FS.demo_corpus(spark, works=3, words=200)
    one = lambda df: sorted((r.work_id, r.candidate, round(r.distance, 9)) for r in A.held_out_delta(A.delta_model(df, 10)[1]).collect())
    assert one(works) == one(works.orderBy(F.rand(3)).repartition(7)) and R.MODELS
