"""Suffix-array dedup: bytes that a repeated string of `length` bytes covers, by merged Burrows-Wheeler transforms.

No machine can merge the transforms of a whole corpus, nor need it: a window of `length` bytes is told by its key, the
smallest hash among its runs of `key_bytes` bytes, and equal windows have equal keys. Neighbouring windows with the same
smallest run form a segment. Segments whose key occurs once hold no repeat and go nowhere. The others meet by key, and there
the transforms of shards of segments are merged (`bwt`) down to `length` bytes: blocks that are still whole then are the
repeated intervals, and in each the smallest (document, place) stays.

Copies cost little: of equal documents only the one with the smallest id takes part, the others are repeats from end to end;
equal segments of a block are sent once, and a key's equal segments from several blocks enter the merge once. A group that more
than `HOT_SEGMENTS` segments share (a line that a third of all documents have, with as many contexts) is split by a longer
key: its segments are cut into their windows, and the key of a window is a hash of all its bytes. They are dealt out by it, and
meet and merge like other strings do.

Flow: texts are packed into compressed blocks, written once to the shared folder; later steps move their names. Every step is
either a pass over blocks or an exchange by hash range: a block asks in a certain order, the range answers in that order, and
the block, which can tell its segments again, applies the answer. Keys are mixed after the minimum is taken, so that ranges are
of one size. There are as many ranges as blocks (the next power of two); messages grow with the square of the blocks, their
bytes in proportion to the input, so beyond some 30 GB raise `block_bytes` with the square root of the input.

Defined cases: null texts count as empty; texts shorter than `length` lose nothing; ids are integers, a null id comes before
all others; rows of equal id are ordered by their place in the table as read; a very long text is cut into segments a piece at a
time; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import bwt
from quillmark.llm.common import _arrow_schema, block_parts, cut, dealt, hash_ranges, pack_blocks, planes, unplaned

BLOCK_BYTES = 16 << 20
#: Segments of one key that meet in one place; beyond, the key is split.
HOT_SEGMENTS = 4096
#: Windows of a text that are keyed at once.
PIECE = 1 << 20
#: Bytes of segments whose transforms are merged at once, but for a key that has more.
MERGE_BYTES = 1 << 18
FIRST = np.iinfo(np.int64).min
ONCE, REPEATED, HOT = range(3)
ALL = np.uint64(2**64 - 1)


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` bytes."""
    h, c, n = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while 2 * n <= size:
        h = h[:-n] * np.uint64(c) + h[n:]
        c = c * c % 2**64
        n *= 2
    if n < size:
        h = h[: n - size] * np.uint64(c) + h[size - n :]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    m, n = h, 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(m) - (width - n)], m[width - n :]) if n < width else m


def segments(text: bytes, length: int, key_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first window and end of windows of each segment: a new one starts where the smallest run of the window changes,
    be it to another run of the same bytes, and where a piece of the text does."""
    keys, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    windows = max(0, len(text) - length + 1)
    for a in range(0, windows, PIECE):
        n = min(PIECE, windows - a)
        h = run_hashes(np.frombuffer(text, np.uint8, n - 1 + length, a), key_bytes)
        m = window_minima(h, length - key_bytes + 1)
        start = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])]))
        keys.append(_mixed(m[start]))  # minima are small numbers
        starts.append(start + a)
    start = np.concatenate(starts)
    return np.concatenate(keys), start, np.append(start[1:], windows) if len(start) else start


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Block:
    """The texts of a block: ids (nulls first), whether the row owns its text, bytes; and the owners in order of id."""

    ids: list[int]
    texts: list[bytes]
    owners: list[int]

    @staticmethod
    def of(place: dict, owners: list[int] | None = None) -> Block:
        ids, texts = [], []
        for b in block_parts(place["path"], place["start"], place["size"]):
            ids += [FIRST if i is None else i for i in b.column(0).to_pylist()]
            texts += b.column(1).to_pylist()
        return Block(ids, texts, sorted(owners or [], key=lambda i: (ids[i], i)))

    def cut(self, length: int, key_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """key, row, first window, end of windows of all segments of the owners."""
        parts = [(*segments(self.texts[i], length, key_bytes), i) for i in self.owners]
        row = np.repeat(np.array([p[3] for p in parts], np.int64), [len(p[0]) for p in parts])
        join = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)
        return join(0, np.uint64), row, join(1, np.int64), join(2, np.int64)


@dataclass
class Entries:
    """Distinct strings that a block asks about: segments that repeat, or windows of segments whose key is split. For each, in the
    order of its key, where it occurs; the first occurrence is the smallest. copies: row, place and number of windows of segments
    that are repeats as a whole."""

    kind: int
    hash: np.ndarray
    strings: list
    places: list[list[tuple[int, int]]]
    windows: np.ndarray
    copies: list[tuple[int, int, int]]


def entries(block: Block, cut: tuple, state: np.ndarray, length: int) -> tuple[Entries, Entries]:
    """state: ONCE, REPEATED or HOT for each segment."""
    key, row, start, end = cut

    def distinct(kind: int) -> tuple[dict[bytes, list[tuple[int, int]]], list[int], list[int]]:
        found: dict[bytes, list[tuple[int, int]]] = {}
        keys: list[int] = []
        sizes: list[int] = []
        at = np.flatnonzero(state == kind)
        for k, r, a, z in zip(key[at].tolist(), row[at].tolist(), start[at].tolist(), end[at].tolist(), strict=True):
            s = block.texts[r][a : z - 1 + length]
            if s in found:
                found[s].append((r, a))
            else:
                found[s] = [(r, a)]
                keys.append(k)
                sizes.append(z - a)
        return found, keys, sizes

    found, keys, sizes = distinct(REPEATED)
    hot, _, widths = distinct(HOT)
    single: dict[bytes, list[tuple[int, int]]] = {}
    for (s, places), n in zip(hot.items(), widths, strict=True):
        r, a = places[0]
        for p in range(n):
            single.setdefault(s[p : p + length], []).append((r, a + p))
    copies = [(r, a, n) for places, n in zip(hot.values(), widths, strict=True) for r, a in places[1:]]
    whole = np.fromiter((int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little") for s in single), np.uint64, len(single))
    out = []
    for kind, hashes, asked, windows, more in ((REPEATED, np.array(keys, np.uint64), found, np.array(sizes, np.int64), []), (HOT, whole, single, np.ones(len(single), np.int64), copies)):
        order = np.argsort(hashes, kind="stable")
        strings, places = list(asked), list(asked.values())
        out.append(Entries(kind, hashes[order], [strings[i] for i in order], [places[i] for i in order], windows[order], more))
    return out[0], out[1]


def _packed(value: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def _unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def decide(asked: list[tuple], length: int, shards: int = 4) -> list[np.ndarray]:
    """asked: for each block hashes, strings, number of windows, and id, row and place of the first occurrence. For each of its
    strings a mask of the windows of that occurrence that also start earlier; all of them if the string does."""
    sizes = np.cumsum([len(a[0]) for a in asked])
    key, windows, ids, row, place = (np.concatenate([np.asarray(a[k]) for a in asked]) for k in (0, 2, 3, 4, 5))
    strings = [s for a in asked for s in a[1]]
    source = np.repeat(np.arange(len(asked)), [len(a[0]) for a in asked])
    order = np.lexsort((place, row, source, ids))  # `asked` is in the order of blocks
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    mask = np.full(len(key), ALL)
    owner: dict[bytes, int] = {}
    for i in order.tolist():
        owner.setdefault(strings[i], i)
    own = np.array(list(owner.values()), np.int64)
    mask[own] = 0
    own = own[np.argsort(key[own], kind="stable")]
    alone = np.concatenate([[True], key[own][1:] != key[own][:-1]]) & np.concatenate([key[own][1:] != key[own][:-1], [True]])
    own = own[~alone]  # one string of a key: its windows are distinct, and what repeats it is a copy
    for part in _groups(own, key[own], np.array([len(strings[i]) for i in own], np.int64)):
        interval, string, at = bwt.repeated([strings[i] for i in part], length, shards)
        whole = at < windows[part][string]
        interval, string, at = interval[whole], string[whole], at[whole]
        if not len(at):
            continue
        i = part[string]
        # the order of windows: id, block, row, then where they start
        by = np.lexsort((place[i] + at, row[i], source[i], ids[i], interval))
        later = np.concatenate([[False], interval[by][1:] == interval[by][:-1]])
        np.bitwise_or.at(mask, i[by][later], np.uint64(1) << at[by][later].astype(np.uint64))
    return np.split(mask, sizes[:-1])


def _groups(own: np.ndarray, key: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Strings in parts of about MERGE_BYTES, cut between keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    for z in np.append(first[1:], len(own)).tolist():
        if z and total[z] - total[a] >= MERGE_BYTES:
            yield own[a:z]
            a = z
    if a < len(own):
        yield own[a:]


ASKED = "kind int, range int, block long, payload binary"
TOLD = "block long, kind int, range int, payload binary"


def _blocks_with(blocks: DataFrame, count: int, *notes: DataFrame) -> DataFrame:
    """BLOCK, notes: what was told to the block, by kind and range."""
    told = notes[0]
    for n in notes[1:]:
        told = told.unionByName(n)
    return dealt(blocks, count).join(dealt(told, count).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "range", "payload"))).alias("notes")), "block", "left")


OWNERS, STATES, MASKS = 10, 11, 12


def _read(batch: pa.RecordBatch, length: int, key_bytes: int) -> Iterator[tuple[int, Block, tuple, list[dict]]]:
    for r in range(batch.num_rows):
        place = batch.slice(r, 1).to_pylist()[0]
        notes = place["notes"] or []
        owners = [i for n in notes if n["kind"] == OWNERS for i in np.frombuffer(n["payload"], np.int32).tolist()]
        block = Block.of(place, owners)
        yield place["block"], block, block.cut(length, key_bytes), notes


def _states(cut: tuple, notes: list[dict]) -> np.ndarray:
    told = [unplaned(n["payload"], np.uint8) for n in notes if n["kind"] == STATES]
    if not told:
        return np.zeros(0, np.uint8)
    return np.concatenate(told)[np.unique(cut[0], return_inverse=True)[1]]


def remove_repeats(docs: DataFrame, length: int = 100, key_bytes: int = 64, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, block_bytes: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start and end of the removed runs, in bytes), and the
    remaining bytes if asked for. length - key_bytes must be below 64: so many windows has a segment at most."""
    assert 0 < key_bytes <= length < key_bytes + 64
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    blocks = pack_blocks(rows, block_bytes or BLOCK_BYTES)
    count = blocks.count()
    bits = max(0, (count - 1).bit_length())

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                block = Block.of(b.slice(r, 1).to_pylist()[0])
                n = len(block.ids)
                yield pa.RecordBatch.from_pydict({"id": pa.array(block.ids, pa.int64()), "block": pa.array([b.column(0)[r].as_py()] * n, pa.int64()), "row": pa.array(range(n), pa.int32()), "digest": pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in block.texts], pa.binary())})

    own = blocks.mapInArrow(digests, "id long, block long, row int, digest binary").groupBy("digest").agg(F.min(F.struct("id", "block", "row")).alias("own"))

    def listed(t: pa.Table) -> pa.Table:
        return pa.table({"block": t.column("block")[:1], "kind": pa.array([OWNERS], pa.int32()), "range": pa.array([0], pa.int32()), "payload": pa.array([np.sort(t.column("row").to_numpy()).astype(np.int32).tobytes()], pa.binary())})

    owners = cut(own.select("own.block", "own.row").groupBy("block").applyInArrow(listed, TOLD))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, _, pieces, _ in _read(b, length, key_bytes):
                distinct, n = np.unique(pieces[0], return_counts=True)
                out = [(r, _packed((planes(np.diff(distinct[a:z], prepend=np.uint64(0))), planes(np.minimum(n[a:z], HOT_SEGMENTS).astype(np.uint16))))) for r, a, z in hash_ranges(distinct, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([STATES] * len(out), pa.int32()), pa.array([r for r, _ in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([p for _, p in out], pa.binary())], schema=_arrow_asked())

    def states(t: pa.Table) -> pa.Table:
        asked = t.to_pylist()
        parts = [_unpacked(r["payload"]) for r in asked]
        keys = [np.cumsum(unplaned(p[0], np.uint64), dtype=np.uint64) for p in parts]
        inverse = np.unique(np.concatenate(keys), return_inverse=True)[1]
        total = np.bincount(inverse, np.concatenate([unplaned(p[1], np.uint16) for p in parts]))
        state = np.where(total >= HOT_SEGMENTS, HOT, np.where(total > 1, REPEATED, ONCE)).astype(np.uint8)[inverse]
        return _told(asked, STATES, [planes(s) for s in np.split(state, np.cumsum([len(k) for k in keys])[:-1])])

    told_states = cut(_blocks_with(blocks, count, owners).mapInArrow(counts, ASKED).groupBy("range").applyInArrow(states, TOLD))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, block, pieces, notes in _read(b, length, key_bytes):
                for e in entries(block, pieces, _states(pieces, notes), length):
                    out = []
                    for r, a, z in hash_ranges(e.hash, bits):
                        first = [p[0] for p in e.places[a:z]]
                        out.append((r, _packed((e.hash[a:z], e.strings[a:z], e.windows[a:z], np.array([block.ids[i] for i, _ in first], np.int64), np.array([i for i, _ in first], np.int64), np.array([p for _, p in first], np.int64)))))
                    yield pa.RecordBatch.from_arrays([pa.array([e.kind] * len(out), pa.int32()), pa.array([r for r, _ in out], pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([p for _, p in out], pa.binary())], schema=_arrow_asked())

    def masks(t: pa.Table) -> pa.Table:
        asked = sorted(t.to_pylist(), key=lambda r: r["block"])
        found = decide([_unpacked(r["payload"]) for r in asked], length)
        return _told(asked, MASKS + asked[0]["kind"], [planes(m) for m in found])

    told_masks = cut(_blocks_with(blocks, count, owners, told_states).mapInArrow(ask, ASKED).groupBy("kind", "range").applyInArrow(masks, TOLD))
    more = ", kept binary" if with_kept else ""
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>{more}"
    arrow = _arrow_schema(spark, schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, block, pieces, notes in _read(b, length, key_bytes):
                runs = covered(block, entries(block, pieces, _states(pieces, notes), length), notes, length)
                for i in range(0, len(block.ids), 1000):
                    yield pa.RecordBatch.from_pylist([_row(block, j, runs[j], with_kept) for j in range(i, min(i + 1000, len(block.ids)))], schema=arrow)

    return _blocks_with(blocks, count, owners, told_states, told_masks).mapInArrow(finish, schema).withColumnRenamed("id", id_col)


def _arrow_asked() -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def _told(asked: list[dict], kind: int, payloads: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array([r["block"] for r in asked], pa.int64()), "kind": pa.array([kind] * len(asked), pa.int32()), "range": pa.array([r["range"] for r in asked], pa.int32()), "payload": pa.array(payloads, pa.binary())})


def covered(block: Block, asked: tuple[Entries, Entries], notes: list[dict], length: int) -> list[list[tuple[int, int]]]:
    """The removed runs of each row, maximal and in order."""
    found: list[list[tuple[int, int]]] = [[] for _ in block.ids]
    for e in asked:
        for row, place, windows in e.copies:
            found[row].append((place, place + windows - 1 + length))
        told = [unplaned(n["payload"], np.uint64) for n in notes if n["kind"] == MASKS + e.kind]
        for places, windows, mask in zip(e.places, e.windows.tolist(), np.concatenate(told).tolist() if told else [], strict=True):
            for row, place in places[1:]:
                found[row].append((place, place + windows - 1 + length))
            row, place = places[0]
            if mask == 2**64 - 1:
                found[row].append((place, place + windows - 1 + length))
            else:
                while mask:
                    low = (mask & -mask).bit_length() - 1
                    ones = (~(mask >> low) & -(~(mask >> low))).bit_length() - 1
                    found[row].append((place + low, place + low + ones - 1 + length))
                    mask &= ~(((1 << ones) - 1) << low)
    own = set(block.owners)
    out = []
    for i, runs in enumerate(found):
        if i not in own:
            out.append([(0, len(block.texts[i]))] if len(block.texts[i]) >= length else [])
            continue
        merged: list[list[int]] = []
        for a, z in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out.append([(a, z) for a, z in merged])
    return out


def _row(block: Block, i: int, runs: list[tuple[int, int]], with_kept: bool) -> dict:
    text, at, kept = block.texts[i], 0, []
    for a, z in runs:
        kept.append(text[at:a])
        at = z
    rest = b"".join([*kept, text[at:]])
    row = {"id": None if block.ids[i] == FIRST else block.ids[i], "n_bytes": len(text), "n_removed": len(text) - len(rest), "n_spans": len(runs), "kept_sha256": hashlib.sha256(rest).hexdigest(), "removed": [{"start": a, "end": z} for a, z in runs]}
    return row | ({"kept": rest} if with_kept else {})
