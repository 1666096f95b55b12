"""Verbatim copies are found whatever their case and punctuation."""

import random
import re

from quillmark.llm import decontamination as X
from tests.llm.test_decontamination import sentence


def test_case_and_punctuation(spark):
    rng = random.Random(21)
    items = [(i, f"{sentence(rng, rng.randrange(4, 20))} Then Anna - or Boris - paid {i + 3} coins, {sentence(rng, 14)}") for i in range(20)] + [(100, "just Six words make this Item"), (101, "It isn’t a straße – of 3,500 well-known houses")]
    forms = [str.upper, str.lower, str.title, lambda t: re.sub(r"[^\w\s]", "", t), lambda t: re.sub(r"[^\w\s]", "", t).upper()]
    docs = [(1000 * k + i, f"{sentence(rng, 30)} {f(q)} {sentence(rng, 30)}") for k, f in enumerate(forms) for i, q in items]
    docs += [(9000 + i, f"{sentence(rng, 30)} {sentence(rng, 30)}".upper()) for i in range(20)] + [(9100, "... - - -"), (9101, "AND"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in X.find_leaks(df, bench).collect()}
    assert set(got) == {(1000 * k + i, i) for k in range(len(forms)) for i, _ in items}
    assert all(kind == "verbatim" and cover > 0.5 for kind, cover in got.values())
    assert {r.doc_id for r in X.drop_leaks(df, bench).collect()} == {*range(9000, 9020), 9100, 9101, None}
