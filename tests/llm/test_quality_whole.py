"""The threshold comes from every labelled row."""

import inspect

import numpy as np

from quillmark.llm import quality


def test_threshold_of_a_table_is_that_of_its_arrays(spark):
    rng = np.random.default_rng(4)
    for n, keep, shift in ((40, 0.9, 0.3), (3000, 0.998, 0.2), (3000, 0.95, 0.02), (5, 0.998, 0.0)):
        good = rng.random(n) < 0.7
        good[0] = True
        scores = np.round(rng.normal(0.4, 0.1, n) + shift * ~good, 3)  # with ties
        table = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good, strict=True)], "score double, good boolean")
        assert abs(quality.whole_threshold(table, keep) - quality.threshold(scores, good, keep)) < 1e-12
    bad = spark.createDataFrame([(0.5, False)], "score double, good boolean")
    assert quality.whole_threshold(bad, 0.998) == float("inf")


def test_no_labelled_row_is_left_out(spark):
    assert "max_rows" not in inspect.signature(quality.fit).parameters
    words = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    docs = spark.createDataFrame([(i, w + (" #" * i)) for i, w in enumerate(words)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels, trees=3, sample=4)  # the pool of the trees has 12 rows, the threshold all 40
    scores = model.forest.score(quality.features(quality.text_statistics([r.text for r in docs.orderBy("doc_id").collect()]))) if model else []
    assert abs(model.threshold - quality.threshold(scores, np.ones(40, bool), 0.998)) < 1e-12
