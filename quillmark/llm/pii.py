"""Personal data: fixed patterns, and a skip-chain conditional random field over mentions.

Mentions are the stretches of a text that could be personal data at all: words with an @, and groups of seven or more
digits. Everything else is observed to be none of it, so the field has a node for each mention only. A node's label is
one of the kinds or none. Potentials: the node's own features; the labels of the mentions before and after it, when
near (the chain); and the labels of the previous and next mention with the same key anywhere in the document (the skip
links: same last seven digits, or same letters before the @). Links of a repeated mention form a chain of their own, so
a mention repeated a million times has two million links and never all pairs. Loopy belief propagation passes messages
along all links; mentions under a pattern's span are observed and keep its kind; another mention is reported when its
most likely kind is sure enough.

Weights are learned by pseudo-likelihood (multinomial logistic regression on own features and the labels of linked
mentions) from the patterns' labels over a bounded sample, see `fit`. So that the field learns what a mention looks like
when its pattern fails, sampled mentions also appear with their marks removed or changed (plus signs, dots, at signs
written out, domains left out, digits hyphenated).

Scale: one narrow pass over whole texts, without a shuffle; the weights are a fixed table.

Defined cases: null texts count as empty and have no spans; repeated rows are scanned each; a very long text is scanned whole,
its messages a part at a time, so memory is some 800 bytes a mention; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import spans as S
from quillmark.llm.common import map_batches

#: Mentions and links that are weighed at once.
AT_ONCE = 1 << 14
KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "none")
NONE = len(KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run can't be entered in its middle: any match takes it to its end.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
AT = re.compile(r"@|\s?\(at\)\s?")
WORD = re.compile(r"[^\s@]+")


def mentions_of(text: str) -> list[tuple[int, int]]:
    """Words around an @ (or at sign written out), and digit groups outside them, in order. Linear in the text: a word's
    left part is looked up only as far as the mention before it."""
    out, last = [], 0
    if "@" in text or "(at)" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > last and not text[start - 1].isspace() and text[start - 1] != "@":
                start -= 1
            after = WORD.match(text, m.end())
            if start < m.start() and after and m.start() >= last:
                last = after.end()
                out.append((start, last))
    numbers = [m.span() for m in NUMBER.finditer(text)]
    if not out:
        return numbers
    at, free = 0, []
    for a, b in numbers:
        while at < len(out) and out[at][1] <= a:
            at += 1
        if at == len(out) or out[at][0] >= b:
            free.append((a, b))
    return sorted(out + free)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[S.Span]:
    """From @ to @: the match that starts leftmost takes the whole run of name characters before its @."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[S.Span]:
    """The patterns' spans: leftmost, not overlapping within a kind, failing matches dropped without another try."""
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return S.ordered(out, KINDS)


FEATURES = ("one", "at", "at_word", "dot_after_at", "plus", "three_dots", "quads", "digits_7_9", "digits_10_13", "digits_14_19", "digits_more", "luhn", "bracket", "hyphens", "spaces", "bare")


def describe(mention: str) -> np.ndarray:
    digits = "".join(c for c in mention if c.isascii() and c.isdigit())
    n, after = len(digits), mention.partition("@")[2]
    at = "@" in mention or "(at)" in mention
    quads = re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", mention) is not None
    return np.array([1, "@" in mention, "(at)" in mention, at and "." in (after or mention.partition("(at)")[2]), mention.startswith("+"), mention.count(".") == 3, quads, not at and 7 <= n <= 9, not at and 10 <= n <= 13, not at and 14 <= n <= 19, not at and n > 19, not at and 14 <= n <= 19 and luhn(digits), "(" in mention and not at, "-" in mention and not at, " " in mention, not at and mention == digits], float)


def key(mention: str) -> str:
    """What repeated or similar mentions have in common."""
    if "@" in mention or "(at)" in mention:
        return "@" + re.split(r"@|\s?\(at\)", mention)[0].lower()
    return "".join(c for c in mention if c.isdigit())[-7:]


@dataclass(frozen=True)
class Field:
    """own [feature, label], chain and skip [label, label]: log potentials. near: characters between chain neighbours."""

    own: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    sure: float = 0.8
    rounds: int = 12
    near: int = 80

    def marginals(self, mentions: list[tuple[int, int]], text: str, observed: np.ndarray) -> np.ndarray:
        """Loopy belief propagation; observed: the label of each mention, or -1."""
        n, k = len(mentions), len(LABELS)
        words = [text[a:b] for a, b in mentions]
        own = np.concatenate([np.array([describe(w) for w in words[i : i + AT_ONCE]]) @ self.own for i in range(0, n, AT_ONCE)])
        own = np.where(observed[:, None] < 0, own, np.where(np.arange(k) == observed[:, None], 0.0, -50.0))
        pairs, which = [], []
        for i in range(1, n):
            if mentions[i][0] - mentions[i - 1][1] <= self.near:
                pairs.append((i - 1, i))
                which.append(0)
        last: dict[str, int] = {}
        for i, w in enumerate(words):
            w = key(w)
            if w in last:
                pairs.append((last[w], i))
                which.append(1)
            last[w] = i
        belief = own
        if pairs:
            a, b = np.array(pairs, np.int32).T
            del pairs
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            kind = np.array(which * 2, np.int8)
            potential = np.stack([self.chain, self.skip])
            message = np.zeros((len(source), k))
            for _ in range(self.rounds):
                into = np.zeros((n, k))
                np.add.at(into, target, message)
                into += own
                new = np.empty_like(message)
                for i in range(0, len(source), AT_ONCE):
                    part = np.arange(i, min(i + AT_ONCE, len(source)))
                    without = into[source[part]] - message[(part + len(a)) % len(source)]  # less what the target itself said
                    sent = np.logaddexp.reduce(without[:, :, None] + potential[kind[part]], axis=1)
                    new[part] = sent - np.logaddexp.reduce(sent, axis=1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            belief = own.copy()
            np.add.at(belief, target, message)
        belief = belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)
        return np.exp(belief)

    def spans(self, text: str, base: list[S.Span]) -> list[S.Span]:
        """What the field adds to the patterns' spans."""
        mentions = mentions_of(text)
        if not mentions:
            return []
        observed = labels_of(mentions, base)
        if (observed >= 0).all():
            return []
        p = self.marginals(mentions, text, observed)
        best = p.argmax(axis=1)
        return [(LABELS[k], a, b) for (a, b), k, seen, q in zip(mentions, best, observed, p, strict=True) if seen < 0 and k != NONE and q[k] >= self.sure]


def labels_of(mentions: list[tuple[int, int]], base: list[S.Span]) -> np.ndarray:
    """The kind of the first pattern span that overlaps each mention, or -1; both lists are in order of start."""
    out, at = np.full(len(mentions), -1), 0
    for i, (a, b) in enumerate(mentions):
        while at < len(base) and base[at][2] <= a and base[at][1] < a:
            at += 1
        j = at
        while j < len(base) and base[j][1] < b:
            if base[j][2] > a:
                out[i] = KINDS.index(base[j][0])
                break
            j += 1
    return out


def learn(own: np.ndarray, chain: np.ndarray, skip: np.ndarray, label: np.ndarray, steps: int = 5000, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: each label given its own features and its neighbours' labels; full-batch gradient steps."""
    x = np.concatenate([own, chain, skip], axis=1)
    w, y = np.zeros((x.shape[1], len(LABELS))), np.eye(len(LABELS))[label]
    speed = 1.0 / (0.5 * max((x**2).sum(axis=1).mean(), 1e-9))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= speed * (x.T @ (p - y) / max(len(x), 1) + decay * w)
    k, n = len(LABELS), own.shape[1]
    even = lambda m: (m + m.T) / 2
    return Field(w[:n], even(w[n : n + k]), even(w[n + k :]))


def examples(text: str) -> list[tuple[list[float], list[float], list[float], int]]:
    """Own features, neighbours' label counts over chain and skip links, label; each mention also with its marks changed,
    next to its true self as a skip neighbour. Mentions without a pattern's label count as none, but for those
    with a skip link to a labelled one: what they are is not known, so they are no examples."""
    mentions = mentions_of(text)
    if not mentions:
        return []
    label = labels_of(mentions, base_spans(text))
    label = np.where(label < 0, NONE, label)
    n, k = len(mentions), len(LABELS)
    chain, skip, last = np.zeros((n, k)), np.zeros((n, k)), {}
    for i, (a, b) in enumerate(mentions):
        if i and a - mentions[i - 1][1] <= Field.near:
            chain[i, label[i - 1]] += 1
            chain[i - 1, label[i]] += 1
        w = key(text[a:b])
        if w in last:
            skip[i, label[last[w]]] += 1
            skip[last[w], label[i]] += 1
        last[w] = i
    out = []
    for i, (a, b) in enumerate(mentions):
        own = text[a:b]
        if label[i] == NONE and skip[i, :NONE].any():
            continue
        out.append((describe(own).tolist(), chain[i].tolist(), skip[i].tolist(), int(label[i])))
        if label[i] != NONE:
            changed = own.replace("@", " (at) ") if label[i] == 0 else own.lstrip("+").replace("-", " ") if label[i] == 3 else own.replace("-", " ").replace(".", "-")
            out.append((describe(changed).tolist(), chain[i].tolist(), (skip[i] + np.eye(k)[label[i]]).tolist(), int(label[i])))
            out.append((describe(changed).tolist(), chain[i].tolist(), [0.0] * k, NONE if label[i] else 0))
            # Only beside their full form: the name at a host without a domain, digits joined by hyphens.
            bare = "@".join((own.partition("@")[0], own.partition("@")[2].partition(".")[0])) if label[i] == 0 else re.sub("[^0-9]+", "-", own).strip("-")
            out.append((describe(bare).tolist(), chain[i].tolist(), (skip[i] + np.eye(k)[label[i]]).tolist(), int(label[i])))
            out.append((describe(bare).tolist(), chain[i].tolist(), [0.0] * k, NONE))
    return out


def fit(docs: DataFrame, max_docs: int = 4000, max_examples: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Learns on the mentions of the `max_docs` documents of smallest hashed id, at most `max_examples` of them by hash."""
    ids = docs.select(F.col(id_col).alias("id")).dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(max_docs)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # at most max_docs numbers

    def run(b: dict[str, list]) -> dict[str, list]:
        rows = [e for t in b["text"] for e in examples(t or "")]
        return {c: [r[i] for r in rows] for i, c in enumerate(("own", "chain", "skip", "label"))}

    found = map_batches(some, run, "own array<double>, chain array<double>, skip array<double>, label int")
    rows = sorted(found.orderBy(F.xxhash64("own", "chain", "skip", "label"), "label").limit(max_examples).collect())
    if not rows:
        return Field(np.tile(np.eye(len(LABELS))[NONE] * 9, (len(FEATURES), 1)), *np.zeros((2, len(LABELS), len(LABELS))))
    return learn(*(np.array([r[i] for r in rows], float) for i in range(3)), np.array([r[3] for r in rows]))


COUNTS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, COUNTS: the patterns' counts and digest, the list of all spans, and how many of them the field added."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(field), dict(docs.dtypes)[id_col]

    def run(b: dict[str, list]) -> dict[str, list]:
        out = {"id": b["id"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": [], "n_added": []}
        for t in b["text"]:
            base = base_spans(t or "")
            added = sent.value.spans(t or "", base)
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(S.digest(base))
            out["spans"].append(S.listing(S.ordered(base + added, KINDS)))
            out["n_added"].append(len(added))
        return out

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, {COUNTS}").withColumnRenamed("id", id_col)
