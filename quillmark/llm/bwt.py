"""Burrows-Wheeler transforms of string sets, merged by iterative interleave refinement.

A shard is a set of strings; its transform lists, in the order of its suffixes, the symbol before each suffix. The merged
order of all shards' suffixes is kept as an interleave: which shard the next suffix is from. Refinement starts from the
interleave by the first few bytes and, in each round, deals the suffixes' preceding symbols into stable buckets: what comes
out is the interleave by one symbol more. A place where the symbol or the block changes starts a new block, and the round in
which that happens tells the length of the common prefix there. No suffixes are compared or sorted again. Symbols are 8
bytes wide, so a depth of 100 takes a start by 4 bytes and 12 rounds.

Every string is followed by 8 rows for the empty suffix, which come first and stay in place; bytes beyond a string count as
zero. So suffixes shorter than the depth may seem equal to others that end in zeros; those who ask about windows that lie
within strings are not affected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 8


@dataclass(frozen=True)
class Strings:
    """Strings one after the other, each followed by STEP zeros. stop: for each byte, where its string ends."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    stop: np.ndarray
    symbol: np.ndarray

    @staticmethod
    def of(strings: list[bytes]) -> Strings:
        length = np.fromiter(map(len, strings), np.int64, len(strings))
        data = np.frombuffer((b"\0" * STEP).join([*strings, b""]), np.uint8)
        start = np.cumsum(length + STEP) - (length + STEP)
        word = np.concatenate([data, np.zeros(STEP, np.uint8)]).astype(np.uint64)
        for n in (1, 2, 4):
            word = word[:-n] << np.uint64(8 * n) | word[n:]
        return Strings(data, start, length, np.repeat(start + length, length + STEP), word[: len(data)])


@dataclass(frozen=True)
class Shard:
    """Rows (places in the data) in suffix order, the empty suffixes first; before: the symbol ahead of each row's suffix, as
    its number among all symbols, or -1 where fewer than STEP bytes are ahead."""

    rows: np.ndarray
    before: np.ndarray


def suffix_order(text: Strings, low: int, high: int) -> np.ndarray:
    """Places low..high by suffix, by prefix doubling; equal suffixes by place."""
    place = np.arange(low, high)
    stop = text.stop[low:high]
    full = np.flatnonzero(place < stop)
    rank = np.zeros(len(place), np.int64)
    distinct, number = np.unique(text.symbol[low:high][full], return_inverse=True)
    rank[full] = number + 1
    width, longest = STEP, int((stop - place).max(initial=0))
    while width < longest and len(distinct) < len(full):
        ahead = rank[np.minimum(place[full] + width, stop[full]) - low]
        distinct, number = np.unique(rank[full] * (len(place) + 1) + ahead, return_inverse=True)
        rank[full] = number + 1
        width *= 2
    return low + np.argsort(rank, kind="stable")


def transforms(text: Strings, shards: int) -> list[Shard]:
    """The transforms of `shards` sets of neighbouring strings."""
    distinct, number = np.unique(text.symbol, return_inverse=True)
    string = np.searchsorted(text.start, np.arange(len(text.data)), "right") - 1
    inside = np.arange(len(text.data)) - text.start[string]
    cuts = np.append(text.start, len(text.data))[np.linspace(0, len(text.start), shards + 1).astype(int)]
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            rows = suffix_order(text, int(low), int(high))
            out.append(Shard(rows, np.where(inside[rows] >= STEP, number[np.maximum(rows - STEP, 0)], -1)))
    return out


def stable_order(key: np.ndarray) -> np.ndarray:
    """A stable order of non-negative numbers below 2^32, by 16 bits at a time."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    if len(key) and key.max() > 0xFFFF:
        order = order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def merge(text: Strings, shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows by their first `depth` bytes, and for each the length of the prefix it has in common with the row before it, as
    the refinement shows it: exact to the symbol, and `depth` where at least so much is in common."""
    rows, before = np.concatenate([s.rows for s in shards]), np.concatenate([s.before for s in shards])
    own = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), [len(s.rows) for s in shards])
    head = depth % STEP or STEP
    empty = rows >= text.stop[rows]
    first = np.where(empty, np.uint64(0), (text.symbol[rows] >> np.uint64(8 * (STEP - head))) + np.uint64(1) if head < STEP else text.symbol[rows])
    order = np.lexsort((first, ~empty))
    n_empty = int(empty.sum())
    interleave = own[order]
    change = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    if n_empty < len(rows):
        change[n_empty] = True
    common = np.where(change, 0, depth)
    fixed = interleave[:n_empty].copy()
    for known in range(head, depth, STEP):
        at = np.empty(len(rows), np.int64)
        at[np.argsort(interleave, kind="stable")] = np.arange(len(rows))  # the j-th mark of a shard is its j-th row
        symbol = before[at]
        block = np.cumsum(change)
        sends = np.flatnonzero(symbol >= 0)
        sends = sends[stable_order(symbol[sends])]
        interleave = np.concatenate([fixed, interleave[sends]])
        symbol, block = symbol[sends], block[sends]
        later = change[n_empty + 1 :]
        later |= (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        common[change & (common == depth)] = known
    at = np.empty(len(rows), np.int64)
    at[np.argsort(interleave, kind="stable")] = np.arange(len(rows))
    return rows[at], common


def repeated(strings: list[bytes], depth: int, shards: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `depth` bytes that occur more than once: interval number (rows of one adjoin), string, place in it."""
    text = Strings.of(strings)
    if not len(text.data):
        return (np.zeros(0, np.int64),) * 3
    rows, common = merge(text, transforms(text, min(shards, len(strings))), depth)
    whole = np.flatnonzero(text.stop[rows] - rows >= depth)  # only these are windows within their string
    interval = np.cumsum(common < depth)[whole]
    rows = rows[whole]
    if not len(rows):
        return interval, rows, rows
    alone = np.concatenate([[True], interval[1:] != interval[:-1]]) & np.concatenate([interval[1:] != interval[:-1], [True]])
    rows, interval = rows[~alone], interval[~alone]
    string = np.searchsorted(text.start, rows, "right") - 1
    return interval, string, rows - text.start[string]
