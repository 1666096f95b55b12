"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units and names turn into typed placeholders, other words lose case and outer
punctuation. Windows of a document's template are hash-joined with the windows of the items' templates. Where they meet,
the slots decide: within one document and item, equal values of the item must stand for equal values of the document and
different for different; windows that break this are dropped. What share of an item's words the remaining windows cover
says whether the document holds the item, and whether any slot changed says if it holds it re-parameterised.

Capitals and sentence ends decide what a name is, so a copy in capitals, in title case or without punctuation has another
template. Where the template's windows do not report an item, windows of its words without case and punctuation are added: equal
ones are verbatim, whatever the words' classes. A copy that differs in case and whose slots changed too is found as far as its
windows of either kind reach.

Most windows look for items that have them. Windows with fewer literal words than half fit too much: they add to a pair that
has a window with more (of an item without such windows, those with most literals stand in, be it one), and windows without
any literal word are not looked at, so an item of numbers alone is found verbatim only. Windows that more than `SHARED` items
have (a common instruction) are not listed by item: where they cover too little of an item to report it, a pair that is reported
has another window, so they are looked up for pairs found by rarer ones. An item whose shared windows would do to report it
keeps them; there the pairs are results.

Scale: documents are read once for every block of items, without a shuffle. A block has at most `block_words` words of
items (hashes and words, some 100 MB at most), so what is broadcast is bounded whatever the number of items; one block
holds a few million items' windows.

Defined cases: null and empty texts match nothing; items of fewer than `least_words` words (too short to tell from chance
amid other words) are found where a whole line has their words and no others, without case and punctuation; items shorter than a
window are one window of their own length; repeated rows of documents or items are reported each; a very long text takes memory
in proportion to its length; empty tables give an empty result; other columns, whatever their names, are ignored by
`find_leaks`, kept by `drop_leaks`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import fresh, map_batches, split_words

# Units in their written forms.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar k c f usd eur gbp meter meters metre metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms ton tons pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split())
LITERAL, NUMBER, UNIT, CAPITAL, NAME = range(5)
_PLACEHOLDER = {NUMBER: b"\x00number", UNIT: b"\x00unit", NAME: b"\x00name"}
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?(?:st|nd|rd|th)?")
_MARKS = re.compile(r"\W+")
_EDGE = re.compile(r"^[^\w$€£+%-]+|[^\w%]+$")
#: Words a Python worker keeps; beyond that it starts anew.
CACHED_WORDS = 200_000
#: Items that may share a window before it is looked up for candidates only.
SHARED = 16


def word_class(raw: str) -> tuple[int, str, bool]:
    """Class, bare word in lower case, and whether the word ends a sentence."""
    bare = _EDGE.sub("", raw)
    ends = raw.rstrip("\"')]»”").endswith((".", "!", "?", ":", "…"))
    low = bare.lower()
    if _NUMBER.fullmatch(bare):
        return NUMBER, low, ends
    if low in UNITS:
        return UNIT, low, ends
    return (CAPITAL if bare[:1].isupper() else LITERAL), low, ends


class Lexicon:
    """Numbers for raw words, with their literal hash, class and sentence end, as arrays to index with; `plain` is the hash without
    case and punctuation, 0 where nothing is left."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash, self.kind, self.ends, self.bare = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), []
        self.plain = np.zeros(0, np.uint64)

    def codes(self, distinct: list[bytes]) -> np.ndarray:
        """The number of each of some distinct words."""
        new = [w for w in distinct if w not in self.number]
        if len(self.number) + len(new) > CACHED_WORDS and self.number:
            self.__init__()
            new = distinct
        if new:
            found = [word_class(w.decode("utf-8", "replace")) for w in new]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.hash = np.concatenate([self.hash, np.array([xxhash.xxh64_intdigest(low.encode()) for _, low, _ in found], np.uint64)])
            self.kind = np.concatenate([self.kind, np.array([k for k, _, _ in found], np.int8)])
            self.ends = np.concatenate([self.ends, np.array([e for _, _, e in found], bool)])
            self.bare += [low for _, low, _ in found]
            plain = [_MARKS.sub("", w.decode("utf-8", "replace").casefold()) for w in new]
            self.plain = np.concatenate([self.plain, np.array([xxhash.xxh64_intdigest(p.encode()) if p else 0 for p in plain], np.uint64)])
        return np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))

    def template(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and class of each word in its place; `first` marks the words that start a text. A capital makes a name
        unless its word starts a sentence."""
        kind = self.kind[codes]
        start = np.concatenate([[True], self.ends[codes][:-1]]) | first
        kind = np.where(kind == CAPITAL, np.where(start, LITERAL, NAME), kind)
        value = self.hash[codes]
        for k, name in _PLACEHOLDER.items():
            value[kind == k] = xxhash.xxh64_intdigest(name)
        return value, kind


def windows(value: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of `width` words."""
    n = len(value) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + value[j : j + n]
    return out ^ (out >> np.uint64(29))


def literals(kind: np.ndarray, width: int) -> np.ndarray:
    """Literal words in every window."""
    total = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    return total[width:] - total[:-width]


@dataclass(frozen=True)
class Item:
    item_id: int
    kinds: list[int]
    bare: list[str]


def plain_words(text: str) -> tuple[str, ...]:
    """The words without case and punctuation."""
    return tuple(w for w in (_MARKS.sub("", raw.decode("utf-8", "replace").casefold()) for raw in text.encode().split()) if w)


TEMPLATE, PLAIN = 0, 1


class Block:
    """Items with their window hashes, sorted, for each kind and width that occurs among them. `tables` has the windows that find
    items, `shared` the hashes of those looked up for candidates only, by item in `later`."""

    def __init__(self, items: list[tuple[int, str]], width: int, least_words: int, least_cover: float) -> None:
        self.items: list[Item] = []
        #: The places of each item's words that are more than punctuation.
        self.worded: list[list[int]] = []
        #: For each item the places of its template's windows that say enough.
        self.anchors: list[set[int]] = []
        self.lines: dict[tuple[str, ...], list[int]] = {}
        rows: list[list[tuple[int, int, int, int, int]]] = []  # by item: kind, width, hash, first and last place covered
        lexicon = Lexicon()
        for item_id, text in items:
            words = text.encode().split()
            if len(words) < least_words:
                if bare := plain_words(text):
                    self.lines.setdefault(bare, []).append(item_id)
                continue
            distinct = list(dict.fromkeys(words))
            numbers = dict(zip(distinct, lexicon.codes(distinct).tolist(), strict=True))
            codes = np.array([numbers[w] for w in words], np.int64)
            value, kind = lexicon.template(codes, np.arange(len(words)) == 0)
            w = min(width, len(words))
            literal = literals(kind, w)
            least = min(-(-w // 2), int(literal.max()))
            self.items.append(Item(item_id, kind.tolist(), [lexicon.bare[c] for c in codes]))
            self.anchors.append(set(np.flatnonzero((literal >= least) & (literal > 0)).tolist()))
            own = [(TEMPLATE, w, int(h), i, i + w - 1) for i, (h, n) in enumerate(zip(windows(value, w), literal, strict=True)) if n]
            plain = lexicon.plain[codes]
            worded = np.flatnonzero(plain)
            self.worded.append(worded.tolist())
            if len(worded) >= least_words:
                w = min(width, len(worded))
                own += [(PLAIN, w, int(h), i, int(worded[i + w - 1])) for i, h in enumerate(windows(plain[worded], w))]
            rows.append(own)
        users = Counter(x for own in rows for x in {r[:3] for r in own})
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        shared: dict[tuple[int, int], set[int]] = {}
        #: For each item: (kind, width, hash) -> places of its shared windows.
        self.later: list[dict[tuple[int, int, int], list[int]]] = []
        for number, own in enumerate(rows):
            common = [r for r in own if users[r[:3]] > SHARED]
            reach = set()
            for kind, _, _, i, end in common:
                reach.update(range(self.worded[number][i] if kind == PLAIN else i, end + 1))
            later: dict[tuple[int, int, int], list[int]] = {}
            if len(reach) < least_cover * len(self.items[number].kinds):
                for r in common:
                    later.setdefault(r[:3], []).append(r[3])
                    shared.setdefault(r[:2], set()).add(r[2])
            self.later.append(later)
            for kind, w, h, i, _ in own:
                if (kind, w, h) not in later:
                    found.setdefault((kind, w), []).append((h, number, i))
        self.tables = {k: self._sorted(sorted(v)) for k, v in found.items()}
        self.shared = {k: self._sorted([(h, 0, 0) for h in sorted(v)]) for k, v in shared.items()}

    @staticmethod
    def _sorted(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashes = np.array([r[0] for r in rows], np.uint64)
        sieve = np.zeros(1 << 22, bool)
        sieve[hashes & np.uint64((1 << 22) - 1)] = True
        return hashes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.packbits(sieve)

    @staticmethod
    def hits(value: np.ndarray, first: np.ndarray, tables: dict, kind: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """width, then position, hash, item and place in it of every pair of equal windows; none reaches over the start of a text."""
        starts = np.flatnonzero(first)
        for (k, w), (hashes, item, place, sieve) in tables.items():
            if k != kind:
                continue
            h = windows(value, w)
            low = (h & np.uint64((1 << 22) - 1)).astype(np.int64)
            at = np.flatnonzero(sieve[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            at = at[np.searchsorted(starts, at, "right") == np.searchsorted(starts, at + w - 1, "right")]
            a, z = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = z - a
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            yield w, np.repeat(at, n), hashes[inner], item[inner], place[inner]


def consistent(item: Item, hits: list[tuple[int, int, int]], words: list[str]) -> tuple[set[int], int, int, int]:
    """The covered places of the item, the windows that remain, the slots they have, and how many of those changed."""
    covered, kept, slots = remaining(item, hits, words)
    return covered, len(kept), len(slots), sum(slots.values())


def remaining(item: Item, hits: list[tuple[int, int, int]], words: list[str]) -> tuple[set[int], list[tuple[int, int]], dict[int, bool]]:
    """hits: width, position in the document, place in the item. The covered places of the item, position and place of the windows
    that remain, and of each of their slots whether it changed. Diagonals (same shift) with most windows bind their slots first."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for h in hits:
        by.setdefault(h[1] - h[2], []).append(h)
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    covered: set[int] = set()
    slots: dict[int, bool] = {}
    kept: list[tuple[int, int]] = []
    for shift in sorted(by, key=lambda s: (-len(by[s]), s)):
        for w, at, place in sorted(by[shift], key=lambda h: h[2]):
            found = [(p, (item.kinds[p], item.bare[p]), (item.kinds[p], words[p + shift])) for p in range(place, place + w) if item.kinds[p] != LITERAL]
            if any(there.get(a, b[1]) != b[1] or back.get(b, a[1]) != a[1] for _, a, b in found):
                continue
            for p, a, b in found:
                there[a], back[b] = b[1], a[1]
                slots[p] = slots.get(p, False) or a != b
            covered.update(range(place, place + w))
            kept.append((at, place))
    return covered, kept, slots


def leaks(texts: list[str | None] | pa.Array, block: Block, lexicon: Lexicon, least_cover: float) -> list[list[dict]]:
    """For each text the items it holds."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    inner, distinct, offsets = split_words(texts)
    if not len(inner):
        return out
    if block.lines:
        longest = max(map(len, block.lines))
        for d, text in enumerate(texts):
            held = {words for line in (text or "").split("\n") if len(line.split(maxsplit=2 * longest)) <= 2 * longest and (words := plain_words(line)) in block.lines}
            out[d] += [{"item_id": i, "coverage": 1.0, "n_windows": 1, "n_slots": 0, "n_changed": 0} for words in sorted(held) for i in block.lines[words]]
    if not block.tables:
        return out
    codes = lexicon.codes(distinct)[inner]
    ends, sizes = offsets[1:], np.diff(offsets)
    first = np.zeros(len(inner), bool)
    first[(ends - sizes)[sizes > 0]] = True
    value, _ = lexicon.template(codes, first)
    own = lexicon.plain[codes]
    worded = np.flatnonzero(own)
    owners = np.searchsorted(ends, worded, "right")
    bare_first = np.diff(owners, prepend=-1) > 0
    by: list[dict[tuple[int, int], list[tuple[int, int, int]]]] = [{}, {}]
    streams = ((TEMPLATE, value, first, np.arange(len(inner))), (PLAIN, own[worded], bare_first, worded))
    for kind, stream, starts, position in streams:
        for w, at, _, item, place in block.hits(stream, starts, block.tables, kind):
            where = position[at]
            owner = np.searchsorted(ends, where, "right")
            for d, i, p, q in zip(owner.tolist(), item.tolist(), (where - (ends - sizes)[owner]).tolist(), place.tolist(), strict=True):
                by[kind].setdefault((d, i), []).append((w, p, q))
    pairs = sorted(by[TEMPLATE].keys() | by[PLAIN].keys())
    late = [(d, i) for d, i in pairs if block.later[i]]
    if late:
        asked = {d for d, _ in late}
        places: dict[tuple[int, int, int, int], list[int]] = {}
        for kind, stream, starts, position in streams:
            for w, at, hashes, _, _ in block.hits(stream, starts, block.shared, kind):
                where = position[at]
                owner = np.searchsorted(ends, where, "right")
                for d, h, p in zip(owner.tolist(), hashes.tolist(), (where - (ends - sizes)[owner]).tolist(), strict=True):
                    if d in asked:
                        places.setdefault((d, kind, w, h), []).append(p)
        for d, i in late:
            for (kind, w, h), at in block.later[i].items():
                for p in places.get((d, kind, w, h), ()):
                    by[kind].setdefault((d, i), []).extend((w, p, q) for q in at)
    for d, i in pairs:
        item, a, hits = block.items[i], int(ends[d] - sizes[d]), by[TEMPLATE].get((d, i), [])
        if not any(q in block.anchors[i] for _, _, q in hits):
            hits = []
        used = {p + j for w, p, _ in hits for j in range(w)}
        covered, kept, slots = remaining(item, hits, {p: lexicon.bare[codes[a + p]] for p in used})
        if len(covered) < least_cover * len(item.kinds):
            known, places_of = set(kept), block.worded[i]
            for w, p, q in by[PLAIN].get((d, i), []):
                own_places = range(places_of[q], places_of[q + w - 1] + 1)
                covered.update(own_places)
                known.add((p, places_of[q]))
                for x in own_places:
                    if item.kinds[x] != LITERAL:
                        slots.setdefault(x, False)
            kept = list(known)
        if len(covered) >= least_cover * len(item.kinds):
            out[d].append({"item_id": item.item_id, "coverage": len(covered) / len(item.kinds), "n_windows": len(kept), "n_slots": len(slots), "n_changed": sum(slots.values())})
    return out


FOUND = "array<struct<item_id: long, coverage: double, n_windows: long, n_slots: long, n_changed: long>>"


def blocks(items: DataFrame, width: int, least_words: int, least_cover: float, block_words: int) -> Iterator[Block]:
    """The items in blocks; each is fetched by its own range of ids, so the driver holds one block at a time."""
    sizes = items.select("item_id", F.size(F.split(F.col("text"), "[ \\t\\n\\x0b\\f\\r]+")).alias("n")).where("n > 0")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // (block_words // 2)))  # twice as many as needed: hashed parts vary in size
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        yield Block(sorted((r[0], r[1]) for r in own.select("item_id", "text").dropna().collect()), width, least_words, least_cover)


def _marked(docs: DataFrame, block: Block, least_cover: float, text_col: str, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    lexicons: list[Lexicon] = []  # one for each Python worker's copy of the task

    def run(b: dict[str, list]) -> dict[str, list]:
        lexicons.extend([Lexicon()] if not lexicons else [])
        return b | {name: leaks(b[text_col], sent.value, lexicons[0], least_cover)}

    return map_batches(docs, run, ", ".join([*(f"`{n}` {k}" for n, k in docs.dtypes), f"`{name}` {FOUND}"]))


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 8, least_words: int = 5, least_cover: float = 0.5, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, coverage, n_windows, n_slots, n_changed, kind: a row for each document and item it holds."""
    own, out, name = docs.select(id_col, text_col), None, fresh("found_items", [id_col, text_col])
    for block in blocks(items, width, least_words, least_cover, block_words):
        part = _marked(own, block, least_cover, text_col, name).select(id_col, F.inline(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("kind", F.when(F.col("n_changed") > 0, "re-parameterised").otherwise("verbatim"))


def drop_leaks(docs: DataFrame, items: DataFrame, width: int = 8, least_words: int = 5, least_cover: float = 0.5, block_words: int = 2_000_000, text_col: str = "text") -> DataFrame:
    """The rows that hold no item."""
    names = docs.columns
    name = fresh("found_items", names)
    for block in blocks(items, width, least_words, least_cover, block_words):
        docs = _marked(docs, block, least_cover, text_col, name).where(F.size(name) == 0).select(*names)
    return docs
