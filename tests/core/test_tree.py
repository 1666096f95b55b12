"""Trees of files are listed and read by tasks."""

import hashlib
import json

import pytest

from quillmark.sources import files as FS


@pytest.fixture
def root(tmp_path):
    lines = []
    for a in ("x", "y z"):
        for w in ("w1", "w2"):
            d = tmp_path / "t" / a / w
            d.mkdir(parents=True)
            for i in range(3):
                (d / f"{i:03}.txt").write_text(text := f"{a} {w} {i} \u0451")
                lines.append({"work_id": w, "author": a, "span_ordinal": i, "text_sha256": hashlib.sha256(text.encode()).hexdigest(), "path": f"{a}/{w}/{i:03}.txt"})
    (tmp_path / "t" / "x" / "w1" / "_hidden.txt").write_text("no")
    (tmp_path / "t" / "x" / "w1" / "note.md").write_text("no")
    (tmp_path / "t" / "manifest.json").write_text("\n".join(map(json.dumps, lines)))
    return tmp_path / "t"


def test_spark_lists_no_file(spark, root):
    for weighting in ("legacy", "work_balanced"):
        rows = FS.load(spark, f"file://{root}", weighting)
        assert not [f for f in rows.inputFiles() if f.endswith(".txt")]  # the driver holds no status of a text
        assert sorted((r.author, r.work_id.split("/")[-1], r.ordinal, r.text) for r in rows.collect()) == [(a, w, i, f"{a} {w} {i} \u0451") for a in ("x", "y z") for w in ("w1", "w2") for i in range(3)]


def test_manifest_and_files_must_agree(spark, root):
    (root / "x" / "extra.txt").write_text("deeper or higher")
    with pytest.raises(Exception, match="differ"):
        FS.load(spark, str(root), "work_balanced").collect()
    (root / "x" / "extra.txt").unlink()
    (root / "x" / "w1" / "000.txt").write_text("other")
    with pytest.raises(Exception, match="differ"):
        FS.load(spark, str(root), "work_balanced").collect()
    (root / "x" / "w1" / "000.txt").write_text(" ")
    with pytest.raises(Exception, match="empty chunk"):
        FS.load(spark, str(root), "legacy").collect()


def test_raw_corpus_and_unknown_texts_are_listed_by_tasks(spark, tmp_path):
    files = {"a/w1.txt": "one", "a/w 2.txt": "tw\u0451", "b/w1.txt": " three ", "b/_w.txt": "no", "b/note.md": "no", "b/deep/w3.txt": "no", "_c/w1.txt": "no", "top.txt": "no"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    raw = FS.raw_corpus(spark, f"file://{tmp_path}")
    assert not raw.inputFiles()  # the driver holds no status of a text
    assert sorted(map(tuple, raw.collect())) == [("a", "a/w 2", "tw\u0451"), ("a", "a/w1", "one"), ("b", "b/w1", " three ")]
    unknown = FS.unknown_fragments(spark, str(tmp_path), "b")
    assert not unknown.inputFiles() and sorted(map(tuple, unknown.collect())) == [("w1.txt", "three"), ("w3.txt", "no")]
    with pytest.raises(FileNotFoundError):
        FS.unknown_fragments(spark, str(tmp_path), "none")
    for text, said in ((b"  ", "empty"), (b"\xff", "UTF-8")):
        (tmp_path / "a" / "bad.txt").write_bytes(text)
        with pytest.raises(Exception, match=said):
            FS.raw_corpus(spark, str(tmp_path)).collect()
