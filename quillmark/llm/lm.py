"""Language-model scoring with a weighted backoff automaton.

The model: n-grams of lower-cased words (A-Z only) and an end token, which also stands before a text. Unigrams are smoothed by
adding a half; every higher order adds its `strength` tokens, shared out as the lower order says. So an n-gram that occurs is
an arc, its weight the whole smoothed probability; a state is a context that occurs, and where it has no arc for the next
word it is left over its failure arc: weight strength / (count of the state + strength), to the state of one word less.

`Automaton` is that machine, for what a block of texts can reach: states, arcs in a hash table by (state, word), failure arcs.
A text is traversed once from left to right; what is carried is the state, what is accumulated are log weights. Many texts
walk side by side, each in a lane; a long text walks in pieces, each led in by the few words before it, after which its state is
what it would be (it depends on no more words than a state has).

Scale: texts are packed into compressed blocks of bounded size, written once to the shared folder; later steps move their
names. Each block counts its own distinct n-grams and sends them, sorted and packed, to hash ranges, one message for each
range; a range adds up the counts of all blocks and answers each block in the order in which it asked. So a block gets exactly
the part of the model it can reach, what is shuffled are distinct n-grams by block and not tokens, and no table of n-grams is
ever whole in one place. There are as many ranges as blocks (the next power of two), each with some 3M n-grams. Messages grow
with the square of the blocks, their bytes in proportion to the input: at 30 GB of Parquet a message still has hundreds of
n-grams; beyond, raise `block_bytes` with the square root of the input (a block takes some 25 times its bytes of memory).
Words are told apart by 64-bit hashes, longer n-grams by as many bits as `key_bits` says.

Defined cases: null and empty texts are an end token alone; a null id counts as the empty text for the fold; repeated rows
count and are scored each; a very long text is a block of its own, so memory grows with the longest text; an empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import block_parts, cut, dealt, hash_ranges, pack_blocks, planes, split_words, unplaned

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
#: Words that a lane of the traversal has at most.
LANE = 512
#: For each order above one, the tokens that the lower order is given: the best of a few for held-out texts that occur once.
STRENGTH = (300.0, 10.0)
CACHED_WORDS = 250_000
END = xxhash.xxh64_intdigest(b" end")  # no word has a space


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


class Words:
    """Hashes of lower-cased words, kept for the words of late."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, distinct: list[bytes]) -> np.ndarray:
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, new = {}, distinct
        digest = xxhash.xxh64_intdigest
        self.known.update((w, digest(w.lower())) for w in new)  # bytes.lower() is lower case of ASCII alone
        return np.fromiter(map(self.known.__getitem__, distinct), np.uint64, len(distinct))


@dataclass(frozen=True)
class Tokens:
    """Tokens of a block's texts, each text with its end; `first` is where the texts start."""

    word: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[str | None] | pa.Array, hashes: Words) -> Tokens:
        codes, distinct, offsets = split_words(texts)
        sizes = np.diff(offsets) + 1
        word = np.full(sizes.sum(), END, np.uint64)
        inner = np.ones(len(word), bool)
        inner[np.cumsum(sizes) - 1] = False
        word[inner] = hashes(distinct)[codes]
        return Tokens(word, np.cumsum(sizes) - sizes)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)

    def keys(self, order: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order the positions at which an n-gram ends, and its key: the upper `bits` of a hash, but for words, which
        have all of it. Before a text stands one end token."""
        at = np.arange(len(self.word))
        yield at, self.word
        mask, key = np.uint64((1 << 64) - (1 << (64 - bits))), self.word
        since = at - np.repeat(self.first, np.diff(np.append(self.first, len(at))))
        for n in range(2, order + 1):
            before = np.concatenate([key[:1], key[:-1]])
            if n == 2:
                before[self.first] = END
            key = mixed(before, self.word, n)
            keep = np.flatnonzero(since >= n - 2)
            yield keep, key[keep] & mask


def key_bits(blocks: int, block_bytes: int) -> int:
    """Bits of an n-gram's key: 24 more than the corpus can have words (a word in four bytes), so that one n-gram in 2^24 has its
    key in common with another, whatever the size of the corpus."""
    return min(64, 24 + max(1, blocks * block_bytes // 4).bit_length())


def mixed(before: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    x = (before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) ^ (before >> np.uint64(29))
    x = (x + word) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Grams:
    """The n-grams of one order in a block: `of` each position the number of the n-gram that ends there (-1: none), and for each
    n-gram the last position at which it ends and its training count."""

    of: np.ndarray
    at: np.ndarray
    count: np.ndarray


@dataclass(frozen=True)
class Automaton:
    """State 0 knows no word. fail, leave: the failure arc of each state and its log weight (of state 0: the log weight of a
    word without an arc, which ends there). key, to, weight: (state, word), next state and log weight of each arc; table: a hash
    table of their numbers (-1: free)."""

    words: int
    first: int
    fail: np.ndarray
    leave: np.ndarray
    key: np.ndarray
    to: np.ndarray
    weight: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(grams: list[Grams], first: np.ndarray, tokens: int, types: int, strength: tuple[float, ...]) -> Automaton:
        """grams: by order; first: where texts start; tokens, types: sums over all training texts."""
        order, words = len(grams), len(grams[0].count)
        starts = np.zeros(len(grams[0].of), bool)
        starts[first] = True
        end = grams[0].of[first[0] - 1]  # the last position has an end, which also stands before a text
        state = [np.zeros(0, np.int32)] * order
        fail, leave = [np.zeros(1, np.int32)], [np.log10([0.5 / (tokens + 0.5 * (types + 1))])]
        keys, to, weight = [], [], []
        n_states = 1
        lower = np.zeros(0)
        for n, g in enumerate(grams, 1):
            seen = np.flatnonzero(g.count > 0)
            at, count = g.at[seen], g.count[seen]
            p = np.zeros(len(g.count))
            if n == 1:
                p[seen] = (count + 0.5) / (tokens + 0.5 * (types + 1))
                source = shorter = np.zeros(len(seen), np.int32)
            else:
                below = grams[n - 2]
                context = np.where(starts[at], end, below.of[at - 1]) if n == 2 else below.of[at - 1]
                source, suffix = state[n - 2][context], below.of[at]
                p[seen] = (count + strength[n - 2] * lower[suffix]) / (below.count[context] + strength[n - 2])
                shorter = state[n - 2][suffix]
            target = shorter
            if n < order:
                state[n - 1] = np.full(len(g.count), -1, np.int32)
                target = state[n - 1][seen] = n_states + np.arange(len(seen), dtype=np.int32)
                n_states += len(seen)
                fail.append(shorter)
                leave.append(np.log10(strength[n - 1] / (count + strength[n - 1])))
            keys.append(source.astype(np.int64) * words + grams[0].of[at])
            to.append(target.astype(np.int32))
            weight.append(np.log10(p[seen]))
            lower = p
        key, to, weight = (np.concatenate(x) for x in (keys, to, weight))
        del keys, lower, p
        slot = _slots(key, len(key))
        by = np.argsort(slot)
        slot = slot[by]
        i = np.arange(len(key), dtype=np.int32)
        place = np.maximum.accumulate(slot - i) + i
        table = np.full(2 * len(key) + 2 + (max(0, int(place[-1]) - 2 * len(key)) if len(key) else 0), -1, np.int32)
        table[place] = by
        begin = state[0][end] if order > 1 and grams[0].count[end] else 0
        return Automaton(words, int(begin), np.concatenate(fail), np.concatenate(leave), key, to, weight, table)

    def arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The number of each arc, or -1."""
        key = state * self.words + word
        if not len(self.key):
            return np.full(len(key), -1)
        place = _slots(key, len(self.key))
        there = self.table[place]
        todo = np.flatnonzero((self.key[there] != key) & (there >= 0))
        while len(todo):
            place[todo] += 1
            there[todo] = now = self.table[place[todo]]
            todo = todo[(self.key[now] != key[todo]) & (now >= 0)]
        return there

    def traverse(self, word: np.ndarray, start: np.ndarray, length: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """The log weight of each lane's words word[start : start + length], less that of the first `lead` of them. Lanes that
        are led in start at state 0, others where texts start."""
        by = np.argsort(-length, kind="stable")
        start, length, lead = start[by], length[by], lead[by]
        state = np.where(lead > 0, 0, self.first).astype(np.int64)
        total = np.zeros(len(by))
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, "left"))
            w = word[start[:live] + t]
            cost, now, todo = np.zeros(live), state[:live], np.arange(live)
            while len(todo):
                found = self.arc(now[todo], w[todo])
                has = found >= 0
                stay, arc = todo[has], found[has]
                cost[stay] += self.weight[arc]
                left = todo[~has]
                cost[left] += self.leave[now[left]]
                todo = left[now[left] > 0]
                now[left] = self.fail[now[left]]
                now[stay] = self.to[arc]
            total[:live] += np.where(lead[:live] > t, 0.0, cost)
        out = np.empty(len(by))
        out[by] = total
        return out


def _slots(key: np.ndarray, arcs: int) -> np.ndarray:
    """Where the search for a key starts, in a table of twice the number of arcs."""
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(max(1, 2 * arcs))).astype(np.int32)


def lanes(first: np.ndarray, total: int, order: int, most: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, length and lead of each lane, and the first lane of each text."""
    sizes = np.diff(np.append(first, total))
    n = -(-sizes // most)
    ahead = np.cumsum(n) - n
    nth = np.arange(n.sum()) - np.repeat(ahead, n)
    start = np.repeat(first, n) + nth * most
    length = np.minimum(np.repeat(first + sizes, n) - start, most)
    lead = np.where(nth > 0, order - 1, 0)
    return start - lead, length + lead, lead, ahead


def _block(block: dict, hashes: Words) -> tuple[list, np.ndarray, Tokens]:
    """ids, held_out and tokens of a block, a part of it at a time."""
    ids, held, word, first, n = [], [], [], [], 0
    for b in block_parts(block["path"], block["start"], block["size"]):
        t = Tokens.of(b.column(2), hashes)
        ids += b.column(0).to_pylist()
        held += b.column(1).to_pylist()
        word.append(t.word)
        first.append(t.first + n)
        n += len(t.word)
    return ids, np.array(held, bool), Tokens(np.concatenate(word), np.concatenate(first))


ASKED = "range int, block long, payload binary"


def asked(blocks: DataFrame, order: int, bits: int, wide: int = 64) -> DataFrame:
    """ASKED: a block's distinct n-grams of each order in each of 2^bits hash ranges, sorted, with training counts; wide: the bits of
    keys."""
    schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for b in batches:
            for block in b.to_pylist():
                _, held, tokens = _block(block, hashes)
                train = ~np.repeat(held, np.diff(np.append(tokens.first, len(tokens.word))))
                parts: dict[int, list[tuple[int, bytes, bytes]]] = {}
                for n, (at, key) in enumerate(tokens.keys(order, wide), 1):
                    distinct, inverse = np.unique(key, return_inverse=True)
                    counts = np.bincount(inverse[train[at]], minlength=len(distinct)).astype(np.uint32)
                    for r, a, z in hash_ranges(distinct, bits):
                        parts.setdefault(r, []).append((n, planes(np.diff(distinct[a:z], prepend=np.uint64(0))), planes(counts[a:z])))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([block["block"]] * len(parts), pa.int64()), pa.array(map(pickle.dumps, parts.values()), pa.binary())], schema=schema)
            pa.default_memory_pool().release_unused()

    return blocks.mapInArrow(run, ASKED)


def answered(requests: DataFrame, order: int) -> DataFrame:
    """block, range, payload: the counts over all blocks, by order, in the order asked; tokens and types: what the range adds to
    the training tokens and to the distinct ones, on one row of each range."""

    def answer(t: pa.Table) -> pa.Table:
        rows = [pickle.loads(p) for p in t.column("payload").to_pylist()]
        out: list[list[tuple[int, bytes]]] = [[] for _ in rows]
        tokens = types = 0
        for n in range(1, order + 1):
            own = [(i, k, c) for i, parts in enumerate(rows) for m, k, c in parts if m == n]
            if not own:
                continue
            keys = [np.cumsum(unplaned(k, np.uint64), dtype=np.uint64) for _, k, _ in own]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([unplaned(c, np.uint32) for _, _, c in own]), len(distinct)).astype(np.int64)
            if n == 1:
                tokens, types = int(total.sum()), int((total > 0).sum())
            for (i, _, _), part in zip(own, np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                out[i].append((n, planes(total[part].astype(np.int64))))
        nothing = [0] * (len(rows) - 1)
        return pa.table({"block": t.column("block"), "range": t.column("range"), "payload": pa.array(map(pickle.dumps, out), pa.binary()), "tokens": [tokens, *nothing], "types": [types, *nothing]})

    return requests.groupBy("range").applyInArrow(answer, "block long, range int, payload binary, tokens long, types long")


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = 3, strength: float | tuple[float, ...] = STRENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """id, SCORES: log10 probabilities of whole texts under the smoothed unigrams and under the automaton."""
    kind = dict(docs.dtypes)[id_col]
    strength = tuple(strength) if isinstance(strength, tuple) else (float(strength),) * (order - 1)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    blocks = pack_blocks(rows, block_bytes or BLOCK_BYTES)
    count = blocks.count()
    bits, wide = max(0, (count - 1).bit_length()), key_bits(count, block_bytes or BLOCK_BYTES)
    answers = cut(answered(asked(blocks, order, bits, wide), order))
    tokens, types = answers.agg(F.sum("tokens"), F.sum("types")).first()
    gathered = dealt(answers, count).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "payload"))).alias("answers"))
    arrow = pa.schema([("id", _arrow_type(docs, id_col)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for b in batches:
            for r in range(b.num_rows):
                block = b.slice(r, 1).to_pylist()[0]
                ids, held, own = _block(block, hashes)
                told: dict[int, list[np.ndarray]] = {}
                for a in block.pop("answers"):
                    for n, total in pickle.loads(a["payload"]):
                        told.setdefault(n, []).append(unplaned(total, np.int64))
                grams = []
                for n, (at, key) in enumerate(own.keys(order, wide), 1):
                    distinct, inverse = np.unique(key, return_inverse=True)
                    of, last = np.full(len(own.word), -1, np.int32), np.zeros(len(distinct), np.int32)
                    of[at], last[inverse] = inverse, at
                    del distinct, inverse, at, key
                    grams.append(Grams(of, last, np.concatenate(told.pop(n)) if n in told else np.zeros(0, np.int64)))
                automaton = Automaton.of(grams, own.first, tokens, types, strength)
                known = grams[0].count[grams[0].of]
                word = grams[0].of
                del grams
                start, length, lead, ahead = lanes(own.first, len(own.word), order)
                full = np.add.reduceat(automaton.traverse(word, start, length, lead), ahead)
                base = own.per_text(np.log10((known + 0.5) / (tokens + 0.5 * (types + 1))))
                sizes = np.diff(np.append(own.first, len(own.word)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow.field("id").type), pa.array(held), pa.array(sizes), pa.array(own.per_text((known > 0).astype(np.int64))), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(full)], schema=arrow)
            pa.default_memory_pool().release_unused()

    return dealt(blocks, count).join(gathered, "block").select("block", "path", "start", "size", "answers").mapInArrow(run, f"id {kind}, {SCORES}").withColumnRenamed("id", id_col)


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)
