"""Verification on two invented styles, unmasking, lossless splits."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillmark.operators import corpus as C
from quillmark.plans import verification as P
from quillmark.sources import files as FS


def test_pairs_and_verifier(spark):
    works = FS.demo_corpus(spark, works=5, words=200).cache()
    pairs = P.pairs(works)
    rows = pairs.collect()
    assert sum(r.same for r in rows) == 8 and all((r.a.split("/")[0] == r.b.split("/")[0]) == bool(r.same) for r in rows) and any(not r.same for r in rows)
    features = P.pair_features(works, pairs).cache()
    p = {(r.a, r.b): r.p for r in P.verify(P.verifier(features), features).collect()}
    assert min(p[r.a, r.b] for r in rows if r.same) > max(p[r.a, r.b] for r in rows if not r.same)


def test_unmasking(spark):
    chunks = C.chunk_by_words(FS.demo_corpus(spark, works=2, words=800), 50, keep_tail=False).withColumn("chunk_id", F.concat_ws("#", "work_id", F.format_string("%03d", "ordinal")))
    curve = P.unmasking(chunks, "periodic/work0", "fragmented/work0", most=30, remove=4)
    assert curve[0] == 1.0 and P.degradation(curve) is not None and P.unmasking(chunks, "periodic/work0", "none") == []
    rng = np.random.default_rng(0)
    same = P.curve(rng.random((40, 30)), np.repeat([1.0, -1.0], 20), 5, 4, 5)
    assert max(same) < 0.9


def test_split_safely(spark):
    rng = random.Random(2)
    texts = ["", "a", "word " * 9, "x" * 25, " a b  c\nd "] + ["".join(rng.choices("ab \n", k=rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (1, 4, 7):
        for r in df.select("t", P.split_safely(F.col("t"), limit).alias("p")).collect():
            assert "".join(r.p) == r.t and all(0 < len(x) <= limit for x in r.p), (r, limit)
            assert all(x.endswith(" ") or " " not in x[1:] or i == len(r.p) - 1 for i, x in enumerate(r.p))
