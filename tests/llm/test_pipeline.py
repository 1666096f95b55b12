"""The pipeline over small tables against plain versions of its stages; registration and odd rows."""

import random

import pytest

from quillmark.llm import decontamination, quality, secret_scan, simhash
from tests.llm.test_decontamination import brute as leak
from tests.llm.test_simhash import brute_print

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "dor fin gal hem jos kut lan mer pon rus".split()]


def prose(rng, n):
    return ". ".join(" ".join(rng.choices(WORDS, k=10)).capitalize() for _ in range(n // 10)) + "."


def one_per_component(rows, radius=4):
    """(id, text): for each component of prints within the radius the first row."""
    prints = [brute_print(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        if k not in best or (d is None, d or 0) < (rows[best[k]][0] is None, rows[best[k]][0] or 0):
            best[k] = i
    return {rows[i][0] for i in best.values()}


def test_stages(spark, tmp_path):
    rng = random.Random(31)
    items = [(i, prose(rng, 40)) for i in range(10)]
    texts = [prose(rng, 120) for _ in range(80)]
    rows = list(enumerate(texts))
    rows += [(100 + i, texts[i]) for i in range(10)] + [(200 + i, texts[i + 10].replace(" ", "  ", 2)) for i in range(10)]
    rows += [(300 + i, f"{prose(rng, 60)} {items[i][1]} {prose(rng, 60)}") for i in range(10)]
    rows += [(400, prose(rng, 100) + ' token = "0123456789abcdef0123456789abcdef" end of it.'), (500, None), (501, ""), (502, "short"), (None, prose(rng, 100)), (5, texts[5])]
    rows += [(600 + i, " ".join(w + "###" for w in prose(rng, 100).split())) for i in range(20)]
    full = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(600 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), least_words=5)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns) and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if i == 0:
            verdict = {(r.doc_id, r.n_words): r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), model, 5).collect()}
            kept = [(d, t) for d, t in kept if verdict[d, len((t or "").split())]]
            assert not any(d is not None and d >= 500 for d, _ in kept) and sum(d is not None and d < 500 for d, _ in kept) >= 105
        elif i == 1:
            ids = one_per_component(kept)
            kept = list({(d, t) for d, t in kept if d in ids})
            assert not any(d is not None and 100 <= d < 210 for d, _ in kept)
        elif i == 2:
            kept = [(d, t) for d, t in kept if not any(leak(t, q) for _, q in items)]
            assert not any(d is not None and 300 <= d < 310 for d, _ in kept) and len(kept) >= 75
        else:
            texts_now = dict(got)
            assert texts_now[400].endswith('[ASSIGN]" end of it.')
            kept = [(d, texts_now[400] if d == 400 else t) for d, t in kept]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        assert sorted(got, key=repr) == sorted(kept, key=repr), i
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {r.doc_id: r.doc_tokens for r in final}
    assert set(tokens) == {d for d, _ in kept} and sum(r.length for r in final) == sum(tokens.values())


def test_modules_are_used():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5 and all((decontamination, secret_scan, simhash))


def test_empty_table_long_text_and_clashing_columns(spark, tmp_path):
    rng = random.Random(33)
    names = "doc_id long, text string, lang string, source string, n_chars long, key int, found_items string, score int"
    rows = [(i, t, "en", "s", len(t), i, "x", 2) for i, t in enumerate([prose(rng, 60) for _ in range(20)] + [prose(rng, 400_000)])]
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(rng, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, some in (("none", []), ("all", rows)):
        docs = spark.createDataFrame(some, names)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            assert i == 4 or docs.columns == [c.split()[0] for c in names.split(", ")]
            if i == 3 and some:
                assert sorted(map(tuple, docs.collect())) == rows
        assert docs.select("doc_id").distinct().count() == len(some)
