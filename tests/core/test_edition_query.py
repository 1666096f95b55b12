"""The registered alignment takes every work, not one of each author."""

from quillmark.queries import QUERIES


def test_every_work_is_aligned(spark, tmp_path):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)] + ["too short"]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pair_id: r for r in QUERIES["edition_alignment"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(7))
    assert all(got[i].matched == 40 and got[i].coverage_a == 1 for i in range(6)) and got[6].matched == 0
