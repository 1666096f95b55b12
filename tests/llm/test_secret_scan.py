"""Secret scans: patterns against plain matching, model spans on planted keys, odd rows."""

import hashlib
import random
import re

from quillmark.llm import secret_scan as X
from quillmark.llm import spans as S

ORDER = ("assign", "access", "hex")


def brute(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0])))


def test_patterns():
    rng = random.Random(6)
    bits = ["token", "PassWord", "api_key", "APIKEY", "toKen", "ſecret", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "abc.def-", "é", "\n", "x"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randrange(14)))
        assert X.base_spans(t) == brute(t), t


def test_redact():
    assert S.redact("ab secret cd", [("assign", 3, 9), ("hex", 5, 9)]) == "ab [ASSIGN] cd"
    assert S.redact("abc", []) == "abc"


def test_scan(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeioutnrsl", k=rng.randrange(3, 9))) for _ in range(300)]
    prose = lambda: " ".join(rng.choices(words, k=80))
    key = "".join(rng.choices(X.ALPHABET[:62], k=40))
    name = "_".join(words[:4]) + "_2024"
    rows = [(i, prose(), "k") for i in range(100)]
    rows += [(200, f"{prose()} {key} {prose()}", ""), (201, f"use {name} here", ""), (202, None, ""), (203, "", ""), (204, 'token = "' + "ab12" * 10 + '"', ""), (204, 'token = "' + "ab12" * 10 + '"', ""), (None, prose(), ""), (205, prose() * 3000 + f" password: {key}", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = X.fit(df)
    got = X.scan(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t, _ in rows:
        assert by[d].base_sha256 == hashlib.sha256(S.listing(brute(t)).encode()).hexdigest()
    assert by[200].n_random == 1 and by[205].n_assign == 1 and by[204].n_assign == by[204].n_hex == 1
    assert not any(r.n_random for r in got if r.doc_id != 200)
    texts = {r.doc_id: r for r in X.redact_secrets(df, model).collect()}
    assert texts[202].text is None and texts[201].text == rows[101][1] and key not in texts[200].text + texts[205].text
    assert texts[204].text == "[ASSIGN]\"" and texts[0].spans == "k"
    assert X.scan(df.limit(0), X.fit(df.limit(0))).count() == 0


def test_recall_and_false_positives():
    """Labelled tokens that the models never saw and no pattern finds: keys of 20 characters and more, and identifiers."""
    rng = random.Random(17)
    words = sorted({"".join(rng.choice(["ba", "cho", "der", "en", "fi", "gra", "hel", "in", "jo", "ker", "li", "mon", "ter", "tion", "ver", "st"]) for _ in range(rng.randrange(2, 6))) for _ in range(4000)})
    model = X.train([], words[::2])
    keys = [k for k in X.drawn(1000, 99) if len(k) >= 20]
    names = [n for n in X.joined(words[1::2], 4000, 98) if len(n) >= 16]
    hit = lambda t: bool(model.spans(f"see {t} there", []))
    caught, wrong = sum(map(hit, keys)) / len(keys), sum(map(hit, names)) / len(names)
    short = [k for k in X.drawn(1000, 97) if 16 <= len(k) < 20]
    print(f"recall {caught:.3f}, of 16 to 19 characters {sum(map(hit, short)) / len(short):.3f}, false positives {wrong:.4f} of {len(names)}")
    assert caught >= 0.9 and wrong <= 0.005


def test_many_spans_take_linear_time():
    import time

    rng = random.Random(18)
    text = " ".join(f"{k} token={k}" for k in ("".join(rng.choices(X.ALPHABET[:62], k=24)) for _ in range(20_000)))
    model, base = X.train([], ["word", "other"]), X.base_spans(text)
    began = time.time()
    found = model.spans(text, base)
    assert len(base) == 20_000 and len(found) > 18_000 and time.time() - began < 10
