"""WARC: exact round trips of payloads over chunk sizes, revisits, odd rows."""

import base64
import hashlib
import random

import pytest

from quillmark.llm import warc as X


def test_round_trip(spark):
    rng = random.Random(2)
    big = "".join(rng.choices("abcé\r\n ", k=40_000))
    rows = [(i, f"http://x.example/{i}", rng.choice(["same", "\r\n\r\n", "", None, f"<p>{i}</p>", big, big + str(i), "a" * 64, "a" * 128, "a" * 65]), "z") for i in range(120)]
    rows += [(500, None, "WARC/1.1\r\n\r\n", ""), (501, "http://a b\r\nX: y\n", "own", ""), (None, "u", "nobody else's", ""), (None, "u", "same", ""), (3, "again", rows[3][2], ""), (3, "other", "a second payload", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, chunk string")
    for chunk in (64, 1 << 20):
        files = X.write(X.record_table(df, chunk=chunk), roll_bytes=100_000)
        parts = X.read(files, chunk=chunk).collect()
        assert max(len(r.chunk) for r in parts) <= chunk and files.count() >= 1
        owner = {}
        for p, _, h, _ in rows:
            h = h or ""
            owner[h] = min([x for x in (owner.get(h), p) if x is not None], default=None)
        want = sorted((str(p), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if p == owner[h or ""] else "revisit", None if p == owner[h or ""] else owner[h or ""], "" if p != owner[h or ""] else h or "") for p, _, h, _ in rows)
        bodies = {}
        got = []
        for r in sorted(parts, key=lambda r: 0):
            key = (r.page_id, r.url)
            bodies.setdefault(key, []).append((r.chunk_no, bytes(r.chunk)))
            if r.last:
                body = bodies.pop(key)
                assert [n for n, _ in body] == list(range(len(body)))
                got.append((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, b"".join(c for _, c in body).decode()))
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert "http://a%20b%0D%0AX:%20y%0A" in {r.url for r in parts}
    small = X.read(X.write(X.record_table(df, least_bytes=10))).where("last").collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 10)
    assert X.read(X.write(X.record_table(df.limit(0)))).count() == 0


def test_cut_archives_are_errors(spark, tmp_path):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, f"http://x.example/{i}", "".join(rng.choices("abcdefgh", k=3000))) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path, n = X.write(X.record_table(df)).first()
    store, at = X.open_store(path)
    with store.open_input_file(at) as f:
        whole = f.read()
    starts = [i for i in range(len(whole)) if whole[i : i + 4] == b"\x1f\x8b\x08\x00"]
    for size, known in ((int(len(whole) * 0.55), None), (starts[20], n)):  # within a record, and between two
        (tmp_path / "cut.warc.gz").write_bytes(whole[:size])
        files = spark.createDataFrame([(str(tmp_path / "cut.warc.gz"), known)], "path string, n_records long")
        with pytest.raises(Exception, match="ends within a record|records instead of"):
            X.read(files).collect()
    (tmp_path / "whole.warc.gz").write_bytes(whole)
    assert X.read(spark.createDataFrame([(str(tmp_path / "whole.warc.gz"),)], "path string")).where("last").count() == 40
