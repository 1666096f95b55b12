"""Spans in texts: kind, start and end in code points (end exclusive), their listing, digest and removal."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def listing(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listing(spans).encode()).hexdigest()


def redact(text: str, spans: list[Span], mark: str = "[{kind}]") -> str:
    """Each maximal run of overlapping spans becomes one mark, named after the first of them."""
    out, at = [], 0
    runs: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([kind, a, b])
    for kind, a, b in runs:
        out += [text[at:a], mark.format(kind=kind.upper())]
        at = b
    return "".join(out) + text[at:]
