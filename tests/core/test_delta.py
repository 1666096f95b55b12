"""Delta queries keep one narrow row a work: none builds the grid of works and terms, and all agree with the long relations."""

import pytest

from quillmark.operators import attribution as A
from quillmark.operators import delta as D
from quillmark.operators import vocabulary as V
from quillmark.queries import QUERIES
from quillmark.sources import files as FS

NARROW = [
    "self_attribution",
    "delta_attribution",
    "delta_cosine_held_out",
    "delta_held_out",
    "delta_work_vocabulary",
    "clustered_comparison",
    "delta_cosine",
    "delta_manhattan",
    "delta_selected_mass",
    "delta_softmax",
]


def test_narrow_rows_agree_with_the_long_relations(spark):
    rows = FS.demo_corpus(spark, works=3, words=200)
    for kinds in (("events", "pooled"), ("selected", "pooled"), ("events", "work")):
        space = D.space(rows, 10, *kinds)
        stats, z, centroids = A.delta_model(rows, 10, *kinds)
        assert space.units.count() == 6 and {r.term for r in stats.collect()} == set(space.terms)
        for metric in ("manhattan", "cosine"):
            for held, want in ((False, A.delta_distances(z, centroids, metric)), (True, A.held_out_delta(z, metric))):
                got = {(r.work_id, r.candidate): r.distance for r in D.distances(space, metric, held).collect()}
                want = {(r.work_id, r.candidate): r.distance for r in want.collect()}
                assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_work_in_several_rows_and_one_without_words(spark):
    cut = spark.createDataFrame([("a", 1, "x y"), ("a", 1, "y z"), ("b", 2, "z z x"), ("b", 3, "!!")], "author string, work_id long, text string")
    space = D.space(cut, 3)
    assert sorted((r.work_id, r.events, len(r.cells)) for r in space.units.collect()) == [(1, 4, 3), (2, 3, 2), (3, 0, 0)]


@pytest.mark.parametrize("name", NARROW)
def test_no_grid_of_works_and_terms(spark, tmp_path, monkeypatch, name):
    rows = FS.demo_corpus(spark, works=3, words=60).selectExpr("xxhash64(work_id) AS doc_id", "text", "'en' AS lang", "author AS source", "length(text) AS n_chars")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def grid(*_, **__):
        raise AssertionError("a row for every work and term")

    monkeypatch.setattr(V, "zscores", grid)
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    spark.catalog.clearCache()
