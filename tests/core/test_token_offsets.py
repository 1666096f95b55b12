"""Tokens with places come out of a worker some texts at a time."""

import re

from quillmark.operators import alignment as AL


def test_pieces_give_the_same_tokens(spark, monkeypatch):
    texts = [(1, "Ab, ёж 😀x"), (2, None), (3, ""), (4, "word " * 70_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [tuple(t) for t in r.tokens] for r in AL.token_offsets(rows).collect()}
    assert got == {k: [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", t or "")] for k, t in texts}
    assert AL.PIECE <= 1 << 20  # bytes of text whose tokens are held at once
