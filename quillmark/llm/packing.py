"""Packing: token sequences of one capacity out of documents, shortest pack first over the length histogram.

Each document is tokenised, ended, and cut at multiples of the capacity. The histogram of piece lengths (at most
`capacity` numbers) is packed on the driver: lengths are placed longest first, each into the packs with the most room
left, and what is kept is how often each packing pattern occurs, not single packs. Pieces find their place by rank:
the r-th piece of a length takes the r-th slot that the patterns have for that length.

Scale: tokenising and placing are narrow passes. Ranks come from row numbers within (length, hash bucket) plus the
counts of the buckets before it, so one length that a third of all pieces share is spread over the buckets, whose number
follows the number of pieces, and so are pieces of one length that share an id, or have none. The slots are broadcast: there are at most 2 x capacity patterns, each of at most
sqrt(2 x capacity) distinct lengths. Pieces (numbers, no texts) are checkpointed once; nothing is tokenised twice.

Defined cases: null and empty texts are documents of their end token alone; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import _arrow_schema, _slices, cut, map_batches, split_words

#: Words whose ids a Python worker keeps, in each of two generations.
CACHED_WORDS = 400_000
#: Pieces that share one (length, bucket) at most, by expectation.
BUCKET_ROWS = 500_000
# Words of these characters alone are split, lowered and mapped to bytes here as the vocabulary's own rules do it: composed
# Latin letters (their lower case depends on nothing around them), single digits, and other ASCII signs but the apostrophe.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]|[!-&(-/:-@\[-`{{-~]+")
# Of words by line: those with another character, or with what may be a special token.
_ODD = re.compile(rf"^(?:[{_LETTERS}!-&(-~]*[^{_LETTERS}!-&(-~\n].*|.*<\|.*)$", re.M)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generations:
    """A cache that forgets in two steps: when the newer half is full, the older one goes; what is asked for stays."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def ask(self, keys: list) -> list:
        """The keys (distinct ones) to compute; all others are in `new` afterwards."""
        missing = list(filterfalse(self.new.__contains__, keys))
        if len(self.new) + len(missing) > self.most:
            self.new, self.old = {}, self.new
            missing = keys
        if not self.old:
            return missing
        known = list(filter(self.old.__contains__, missing))
        self.new.update(zip(known, map(self.old.__getitem__, known), strict=True))
        return list(filterfalse(self.old.__contains__, missing))


class WordTokenizer:
    """Ids of whole texts, word by word: the vocabulary's pre-tokeniser never joins characters across the white space
    that words are split on here, so ids of equal words are equal and can be kept. Simple words go piece by piece to the
    model alone, which spares them the general normaliser; the rest to the whole tokeniser."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words, self.pieces, self.letters = Generations(CACHED_WORDS), Generations(CACHED_WORDS), byte_letters() | {32: " "}

    def ids(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (with the end of the last)."""
        codes, words, offsets = split_words(texts)
        new = self.words.ask(words)
        known = self.words.new
        lines = b"\n".join(new).decode().split("\n") if new else []
        odd = set(_ODD.findall("\n".join(lines)))
        simple = [(w, x) for w, x in zip(new, lines, strict=True) if x not in odd] if odd else list(zip(new, lines, strict=True))
        if simple:
            known.update(zip((w for w, _ in simple), self._by_piece([x for _, x in simple]), strict=True))
        other = [(w, x) for w, x in zip(new, lines, strict=True) if x in odd] if odd else []
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            for (w, _), e in zip(part, self.whole.encode_batch([x for _, x in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        found = list(map(known.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], each)
        return flat[at], ends[offsets]

    def _by_piece(self, words: list[str]) -> Iterator[bytes]:
        """The ids of simple words: all are cut in one pass, and each piece is looked up once."""
        spaced = _PIECE.sub(r"\g<0> ", "\n".join(words).lower())
        pieces = spaced.split()
        raw = np.frombuffer(spaced.encode(), np.uint8)
        upto = np.append(np.searchsorted(np.flatnonzero(raw == 32), np.flatnonzero(raw == 10)), len(pieces))
        self._learn(pieces)
        ids = list(map(self.pieces.new.__getitem__, pieces))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])[upto].tolist()
        flat = b"".join(ids)
        return (flat[a:z] for a, z in zip([0, *ends], ends, strict=False))

    def _learn(self, pieces: list[str]) -> None:
        new = self.pieces.ask(list(set(pieces)))
        for own, plain in ((list(filter(str.isascii, new)), True), (list(filterfalse(str.isascii, new)), False)):
            for i in range(0, len(own), 1000):
                part = own[i : i + 1000]
                text = " ".join(part)
                e = self.model.encode(text if plain else text.encode().decode("latin-1").translate(self.letters), add_special_tokens=False)
                ends = np.searchsorted(np.array(e.word_ids), np.arange(len(part)), "right") * 4
                ids = np.array(e.ids, "<u4").tobytes()
                self.pieces.new.update(zip(part, (ids[a:z] for a, z in zip([0, *ends.tolist()], ends.tolist(), strict=False)), strict=True))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for."""
    schema = f"id {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long{', ids binary' if with_ids else ''}"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                out: dict[str, list] = {f.name: [] for f in arrow}
                ids, ends = tokenizer_of(tokenizer_path).ids(b.column(1))
                for doc, a, z in zip(b.column(0).to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
                    n = z - a + 1
                    own = ids[a:z].tobytes() + struct.pack("<I", end_id)
                    for at in range(0, n, capacity):
                        part = own[4 * at : 4 * (at + capacity)]
                        for c, v in zip(out, (doc, at, len(part) // 4, zlib.crc32(part), n, part), strict=False):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass
class Pattern:
    """`count` packs, each with `copies` of each length."""

    count: int
    copies: Counter
    room: int


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Lengths longest first, each piece into a pack with the most room; packs of one pattern move together."""
    heap: list[tuple[int, int, Pattern]] = []
    made = 0

    def put(count: int, copies: Counter, room: int) -> None:
        nonlocal made
        if count:
            made += 1
            heapq.heappush(heap, (-room, made, Pattern(count, copies, room)))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0][0] < length:
                each = capacity // length
                put(left // each, Counter({length: each}), capacity - each * length)
                put(int(left % each > 0), Counter({length: left % each}), capacity - left % each * length)
                break
            _, _, top = heapq.heappop(heap)
            next_room = -heap[0][0] if heap else 0
            # copies that go in before another pack has more room
            each = min(top.room // length, max(0, top.room - next_room) // length + 1)
            if left < each * top.count:
                each = max(1, left // top.count)
            filled = min(top.count, left // each)
            put(filled, top.copies + Counter({length: each}), top.room - each * length)
            put(top.count - filled, top.copies, top.room)
            left -= filled * each
    return [p for _, _, p in sorted(heap, key=lambda x: x[1])]


@dataclass(frozen=True)
class Slots:
    """Runs of slots by (length, first rank): the sequence and offset of the first, and how many a pack has."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    copies: np.ndarray

    SHIFT = 40  # a key is length << SHIFT | rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << self.SHIFT) | rank, "right") - 1
        nth = rank - (self.key[at] & ((1 << self.SHIFT) - 1))
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def slots_of(patterns: list[Pattern]) -> Slots:
    rows, ranks, sequence = [], Counter(), 0
    for p in patterns:
        offset = 0
        for length in sorted(p.copies, reverse=True):
            rows.append(((length << Slots.SHIFT) | ranks[length], sequence, offset, p.copies[length]))
            ranks[length] += p.count * p.copies[length]
            offset += length * p.copies[length]
        sequence += p.count
    return Slots(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def ranked(parts: DataFrame, order: list[str], rows: int) -> DataFrame:
    """`parts`, read alike each time, with `rank`, from 0 without gaps among those of the same length. A bucket of more than
    BUCKET_ROWS, which only rows equal in `order` can make, is dealt out by the rows' numbers."""
    buckets = math.ceil(rows / BUCKET_ROWS) * 8
    parts = parts.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    hot = parts.groupBy("length", "bucket").count().where(F.col("count") > BUCKET_ROWS).withColumn("shares", F.ceil(F.col("count") / BUCKET_ROWS) * 8).drop("count")
    # at most rows / BUCKET_ROWS rows of three numbers
    parts = parts.join(F.broadcast(hot), ["length", "bucket"], "left").withColumn("share", F.coalesce(F.pmod("row", "shares"), F.lit(0))).drop("shares")
    key = ["length", "bucket", "share"]
    before = Window.partitionBy("length").orderBy("bucket", "share").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order, "row"))
    return parts.withColumn("nth", nth).join(counts, key).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("bucket", "share", "row", "nth", "before")


def pack(parts: DataFrame, capacity: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """`parts` (of `pieces`) with sequence_id and offset; the pieces of a sequence follow each other without gaps."""
    parts = cut(parts)
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = parts.sparkSession.sparkContext.broadcast(slots_of(shortest_pack_first(histogram, capacity)))
    placed = ranked(parts, [id_col, "start"], sum(histogram.values()))

    def run(b: dict[str, list]) -> dict[str, list]:
        sequence, offset = slots.value.place(np.array(b["length"], np.int64), np.array(b.pop("rank"), np.int64))
        return b | {"sequence_id": sequence, "offset": offset}

    kinds = [(n, k) for n, k in placed.dtypes if n != "rank"]
    return map_batches(placed, run, ", ".join(f"`{n}` {k}" for n, k in [*kinds, ("sequence_id", "long"), ("offset", "long")]))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed ids themselves, for pieces made with_ids. A sequence has at most `capacity` ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(b: dict[str, list]) -> dict[str, list]:
        return {"sequence_id": b["sequence_id"], "ids": [np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").astype(np.int32) for ps in b["parts"]]}

    return map_batches(parts, run, "sequence_id long, ids array<int>")
