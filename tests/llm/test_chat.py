"""Chat formatting: round trips, forged markers, the machine, and odd rows."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import chat

TRICKY = st.text(alphabet="<|\\im_end>startab\n%0A25", max_size=40)


@settings(max_examples=400, deadline=None)
@given(TRICKY, TRICKY)
def test_turn_round_trip(role, text):
    t = chat.Template()
    pieces = t.segments(role, text)
    assert t.parse("".join(p for p, _ in pieces)) == (role, text)
    assert "<|" not in pieces[1][0] and chat.unescape(pieces[1][0]) == text


def test_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in range(40):
        for i in range(rng.randrange(1, 9)):
            rows.append((c, i, ("user", "assistant")[i % 2], rng.choice([None, "", "hé <|im_end|>\n", "x" * 50_000, "<\\|", "plain"]), "extra"))
    rows += [(50, 0, "user", "a", ""), (50, 1, "user", "b", ""), (50, 2, "assistant", "c", ""), (51, 0, None, "a", ""), (None, 0, "user", "a", ""), (None, 1, "assistant", "b", ""), (52, 0, "user", "q", ""), (52, 0, "user", "q", ""), (52, None, "system", "s", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(p) for a, b in turns for p, _ in chat.Template().segments(a, b))
    assert not got[50].valid and not got[51].valid and got[None].valid and not got[52].valid
    assert all(got[c].valid == (len(by[c]) % 2 == 0) for c in range(40))
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
