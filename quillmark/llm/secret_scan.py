"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two second-order models over the characters of a token are trained from labelled samples: one on random strings
(keys found by the patterns, and strings drawn from the usual key alphabets), one on ordinary identifiers (words of
the texts outside the found keys, joined words, numbers). A token of 16 characters or more (the shortest the models are trained on) whose log-likelihood ratio per character exceeds the
threshold is reported as kind `random`, unless a pattern's span overlaps it. The threshold lies above every ordinary
token of the samples that were held out of training.

Scale: the models are fixed tables of some 70^3 numbers, fitted on a bounded sample (see `fit`); scanning is one
narrow pass over whole texts, without a shuffle.

Defined cases: null texts count as empty and have no spans; repeated rows are scanned each; a very long text is scanned whole, in
time and memory in proportion to its length; an empty table gives an empty result (and models of drawn strings only); other columns are ignored by `scan`, kept by `redact_secrets`.
"""

from __future__ import annotations

import base64
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import spans as S
from quillmark.llm.common import map_batches

KINDS = ("assign", "access", "hex", "random")
# Letters of the names in either case, and only those of ASCII.
_either = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: From the shortest trained length on; shorter random strings are not told from words.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
HINTS = ("password", "passwd", "secret", "token", "api")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET)) + 1  # 0 stands before the first character


def base_spans(text: str) -> list[S.Span]:
    """The patterns' spans: leftmost, not overlapping within a kind, failing matches dropped."""
    low = text.lower()
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(h in low for h in HINTS) else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return S.ordered(found, KINDS)


def transitions(tokens: list[str]) -> np.ndarray:
    """Counts [before last, last, next] over the tokens."""
    size = len(ALPHABET) + 1
    counts = np.zeros(size**3, np.int64)
    for t in tokens:
        c = np.concatenate([[0, 0], _CODE[np.frombuffer(t.encode(), np.uint8)]])
        np.add.at(counts, (c[:-2] * size + c[1:-1]) * size + c[2:], 1)
    return counts.reshape(size, size, size)


def log_likelihoods(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Log probabilities, second order backed by first, first by none, none by one of each."""
    level = 1.0 + counts.sum(axis=(0, 1))
    level = level / level.sum()
    first = counts.sum(axis=0) + weight * level
    first = first / first.sum(axis=-1, keepdims=True)
    second = counts + weight * first
    return np.log(second / second.sum(axis=-1, keepdims=True))


@dataclass(frozen=True)
class MarkovPair:
    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        """Log-likelihood ratio of random to ordinary, per character."""
        c = np.concatenate([[0, 0], _CODE[np.frombuffer(token.encode(), np.uint8)]])
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean())

    def spans(self, text: str, taken: list[S.Span]) -> list[S.Span]:
        """The tokens above the threshold that overlap none of `taken`, which is in order of start; both are read once."""
        out, i, reach = [], 0, 0
        for m in TOKEN.finditer(text):
            while i < len(taken) and taken[i][1] < m.end():
                reach = max(reach, taken[i][2])
                i += 1
            if reach <= m.start() and self.score(m[0]) > self.threshold:
                out.append(("random", m.start(), m.end()))
        return out


def drawn(n: int, seed: int) -> list[str]:
    """Random strings of the usual alphabets and lengths."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + "0123456789")
    out = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(16, 64))) for _ in range(n)]
    return out + [base64.b64encode(rng.randbytes(rng.randrange(12, 48))).decode() for _ in range(n // 4)]


def joined(words: list[str], n: int, seed: int) -> list[str]:
    """Identifiers as programs have them: words with joints, capitals and numbers at the end."""
    rng = random.Random(seed)
    out = []
    for _ in range(n if words else 0):
        some = rng.choices(words, k=rng.randrange(2, 6))
        style = rng.randrange(4)
        name = "_".join(some) if style == 0 else "-".join(some) if style == 1 else "".join(w.capitalize() for w in some) if style == 2 else "/".join(some)
        out.append(name + rng.choice(["", "", "1", "42", "2024", "_v2"]))
    return out


def numbered(n: int, seed: int) -> list[str]:
    """Plain numbers, which are no secrets as such: accounts, cards, times."""
    rng = random.Random(seed)
    return ["".join(rng.choices("0123456789", k=rng.randrange(8, 24))) for _ in range(n)]


def train(keys: list[str], words: list[str], seed: int = 11) -> MarkovPair:
    """Nine of ten samples train; the threshold is a margin above the highest score of a held-out ordinary token of the
    scanned length, and no less than zero."""
    positive = keys + drawn(4000, seed)
    negative = words + joined(words, 4000, seed + 1) + numbered(1000, seed + 2)
    hold = [t for t in negative[::10] if len(t) >= 16]
    ratio = log_likelihoods(transitions(positive)) - log_likelihoods(transitions([t for i, t in enumerate(negative) if i % 10]))
    pair = MarkovPair(ratio, 0.0)
    return MarkovPair(ratio, max([0.25, *(pair.score(t) + 0.1 for t in hold)]))


def _sample(docs: DataFrame, max_docs: int, id_col: str, text_col: str) -> DataFrame:
    ids = docs.select(F.col(id_col).alias("id")).dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(max_docs)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # at most max_docs numbers


def fit(docs: DataFrame, max_docs: int = 4000, max_tokens: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> MarkovPair:
    """Trains on the `max_docs` documents of smallest hashed id: the keys the patterns find there, against the words (letters
    only) outside them; at most `max_tokens` of either, by hash."""

    def tokens(b: dict[str, list]) -> dict[str, list]:
        out = {"key": [], "token": []}
        for t in b["text"]:
            text = t or ""
            found = base_spans(text)
            keys = {m[0] for _, a, z in found for m in TOKEN.finditer(text[a:z])}
            words = set(re.findall(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])", S.redact(text, found, " ")))
            out["key"] += [True] * len(keys) + [False] * len(words)
            out["token"] += [*keys, *words]
        return out

    found = map_batches(_sample(docs, max_docs, id_col, text_col), tokens, "key boolean, token string").distinct()
    pick = lambda key: sorted(r[0] for r in found.where("key" if key else "not key").select("token").orderBy(F.xxhash64("token"), "token").limit(max_tokens).collect())
    return train(pick(True), pick(False))


COUNTS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, COUNTS: the counts of each kind, the digest of the patterns' spans, and the list of all spans."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(model), dict(docs.dtypes)[id_col]

    def run(b: dict[str, list]) -> dict[str, list]:
        out = {"id": b["id"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for t in b["text"]:
            base = base_spans(t or "")
            found = S.ordered(base + sent.value.spans(t or "", base), KINDS)
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in found))
            out["base_sha256"].append(S.digest(base))
            out["spans"].append(S.listing(found))
        return out

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, {COUNTS}").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, model: MarkovPair, text_col: str = "text") -> DataFrame:
    """The rows with their secrets replaced by [KIND]; null texts stay null."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(b: dict[str, list]) -> dict[str, list]:
        texts = []
        for t in b[text_col]:
            base = base_spans(t or "")
            found = base + sent.value.spans(t or "", base)
            texts.append(S.redact(t, found) if found else t)
        return b | {text_col: texts}

    return map_batches(docs, run, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)).select(*names)
