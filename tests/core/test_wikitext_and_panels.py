"""Templates of any depth against a scan by hand; permutation gates for panels of two, three and more authors."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import resampling as R
from quillmark.plans import cases as K


def outside(text):
    out, depth = [], 0
    for piece in re.findall(r"\{\{|\}\}|[{}]|[^{}]+", text):
        if piece == "{{":
            depth += 1
        elif piece == "}}":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(piece)
    return "".join(out)


def test_templates(spark):
    rng = random.Random(3)
    texts = ["x {{a {{b {{c}} }} }} y", "{{{x}}}", "a}}b{{c", "{{" * 40 + "in" + "}}" * 40 + "out", "", "{{a}} {{b}} c"]
    texts += ["".join(rng.choices(["{{", "}}", "{", "}", "a", " b"], [3, 3, 1, 1, 3, 3], k=rng.randrange(14))) for _ in range(500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.drop_templates(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: outside(t) for i, t in enumerate(texts)}


def test_links(spark):
    rows = [("[https://a.b/c]x", "x"), ("[https://a.b/c  see this]", "see this"), ("[[p|q|r]]", "q|r"), ("[[p]] [[File:x.png|thumb]]", "p"), ("== T ==\n'''b'''", "T\nb")]
    got = spark.createDataFrame(rows, "t string, want string").select(X.wikitext_plain(F.col("t")).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def panel(spark, authors, works, seed=5):
    rng = random.Random(seed)
    words = {a: [f"{a}{w}" for w in ("alpha", "beta", "gamma", "delta")] for a in authors}
    rows = [(f"{a}/{w}/{c}", f"{a}/{w}", a, " ".join(rng.choices(words[a], k=120))) for a in authors for w in range(works) for c in range(2)]
    return spark.createDataFrame(rows, "chunk_id string, work_id string, author string, text string")


def test_three_authors_pass_and_noise_fails(spark):
    spec = K.CaseSpec("three", ("ann", "bob", "cyd"), feature_sets=("char3",), n_random=200)
    chunks = panel(spark, spec.authors, 4)
    found = K.gate(chunks, spec, "char3")
    assert found["status"] == "pass" and found["work_macro_recall"] == 1.0 and found["permutation_p"] <= 0.05
    mixed = chunks.withColumn("author", F.element_at(F.array(*map(F.lit, spec.authors)), (F.pmod(F.substring("work_id", 5, 1).cast("int"), F.lit(3)) + 1)))
    again = K.gate(mixed.where("substring(work_id, 5, 1) < '3'"), spec, "char3")
    assert again["status"] == "fail" and again["permutation_p"] > 0.05


def test_panel_recalls_agree_with_the_relational_way(spark, monkeypatch):
    rng = np.random.default_rng(2)
    ids = [f"w{i}" for i in range(9)]
    x = np.abs(rng.normal(size=(9, 6)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(ids[i], f"t{j}", float(x[i, j])) for i in range(9) for j in range(6)], "work_id string, term string, value double")
    orders = R.random_orders(list("aaabbbccc"), 12, 1)
    dense = R.panel_recalls(vectors, ids, orders)
    monkeypatch.setattr(R, "MOST_WORKS", 1)
    assert np.allclose(sorted(dense), sorted(R.panel_recalls(vectors, ids, orders)))
    for order, recall in zip(orders, dense, strict=True):
        hits = {}
        for i in range(9):
            cos = {}
            for k in "abc":
                s = sum(x[j] for j in range(9) if order[j] == k and j != i)
                cos[k] = float(x[i] @ s / np.linalg.norm(s))
            hits.setdefault(order[i], []).append(min(cos, key=lambda k: (-cos[k], k)) == order[i])
        assert abs(recall - np.mean([np.mean(h) for h in hits.values()])) < 1e-12
