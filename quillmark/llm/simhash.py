"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a value in common that differs from either in at most r/2 bits
(r even). So every fingerprint emits all variants within r/2 bits; rows meet by variant; all that meet in one
variant are within r bits of each other, so linking each to the smallest of them loses no connection and needs no
pairs within a group. Links are verified by counting bits, deduplicated, and joined into components.

What is shuffled: copies collapse to distinct fingerprints first, so a variant has at most as many rows as there
are variants of one value (2,081 for r = 4), whatever the groups of copies. Fingerprints that provably have no
partner emit nothing: two values within r bits agree in at least b - r of b blocks, so one that shares no choice of
b - r blocks with another value is alone. Both exchanges move packed arrays (a row for each batch and bucket), not a
row for each variant; the number of buckets follows the number of fingerprints. Components come from alternating
star steps on a checkpointed edge table, never on the driver.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows are copies; a null
id takes part but is never the smallest id, unless a component has no other; an empty table gives an empty result;
a very long text is hashed whole, in memory of some ten times its size; other columns, whatever their names, are ignored
by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import cut, fresh, map_batches

WIDTH = 64
#: Entries that one bucket of an exchange should hold at most: 1M of 10 bytes, sorted in some 40 MB.
BUCKET_ENTRIES = 1_000_000


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 values of the word shingles in order, repeats included; of all words where they are fewer than a shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the XXH64 values of the word shingles, repeats included."""
    hashes = shingle_hashes(text, shingle, seed)
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long)."""
    kind = dict(docs.dtypes)[id_col]

    def run(b: dict[str, list]) -> dict[str, list]:
        return {"id": b["id"], "fp": np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


def ball(radius: int) -> np.ndarray:
    """All masks of at most `radius` bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(WIDTH), r)], np.uint64)


def block_masks(radius: int, blocks: int = 8) -> np.ndarray:
    """Masks of every choice of `blocks` - `radius` blocks: values within `radius` bits agree under one of them at least."""
    block = [((1 << (WIDTH // blocks)) - 1) << (i * WIDTH // blocks) for i in range(blocks)]
    return np.array([sum(c) for c in combinations(block, blocks - radius)], np.uint64)


def _bucket(key: np.ndarray, salt: np.ndarray | int, buckets: int) -> np.ndarray:
    x = (key ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(salt, np.uint64) + np.uint64(1)))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)) % np.uint64(buckets)


def _scatter(nodes: DataFrame, masks: np.ndarray, by_xor: bool, buckets: int) -> DataFrame:
    """bucket, payload: for every value and mask one entry (value, mask's number) in the bucket of value ^ mask, or value & mask."""
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
    step = max(1, BUCKET_ENTRIES // len(masks))

    def run(batches):
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), step):
                part = values[i : i + step]
                value, number = np.repeat(part, len(masks)), np.tile(np.arange(len(masks), dtype=np.uint16), len(part))
                at = _bucket(value ^ masks[number], 0, buckets) if by_xor else _bucket(value & masks[number], number, buckets)
                order = np.argsort(at, kind="stable")
                value, number, at = value[order], number[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                ends = np.append(first[1:], len(at))
                yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array([value[a:z].tobytes() + number[a:z].tobytes() for a, z in zip(first, ends, strict=True)], pa.binary())], schema=schema)

    return nodes.select("fp").mapInArrow(run, "bucket int, payload binary")


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    payloads = [p for p in t.column("payload").to_pylist()]
    sizes = [len(p) // 10 for p in payloads]
    value = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes, strict=True)])
    return value, np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n) for p, n in zip(payloads, sizes, strict=True)])


def _runs(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys adjoin, and where each run of them starts."""
    order = np.lexsort((key, *more)) if more else np.argsort(key)
    change = key[order][1:] != key[order][:-1]
    for m in more:
        change |= m[order][1:] != m[order][:-1]
    return order, np.flatnonzero(np.concatenate([[True], change]))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links a-b as connect what they connect together: each a with the smallest reached."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    used = np.zeros(len(a), bool)
    while True:
        lu, lv = label[u], label[v]
        live = np.flatnonzero(lu != lv)
        if not len(live):
            return a[used], b[used]
        high, low = np.maximum(lu[live], lv[live]), np.minimum(lu[live], lv[live])
        order = np.lexsort((low, high))
        chosen = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]  # each root hooks on a smaller one: no cycle
        used[live[chosen]] = True
        label[high[chosen]] = low[chosen]
        while not np.array_equal(label, label[label]):
            label = label[label]


def partnered(nodes: DataFrame, count: int, radius: int) -> DataFrame:
    """The values that share a choice of blocks with another value; all others have no partner within the radius."""
    masks = block_masks(radius)
    buckets = max(1, -(-count * len(masks) // BUCKET_ENTRIES))

    def meet(t: pa.Table) -> pa.Table:
        value, number = _entries(t)
        order, first = _runs(value & masks[number], number)
        sizes = np.diff(np.append(first, len(value)))
        return pa.table({"fp": np.unique(value[order][np.repeat(sizes > 1, sizes)]).view(np.int64)})

    return _scatter(nodes, masks, False, buckets).groupBy("bucket").applyInArrow(meet, "fp long").distinct()


def links(nodes: DataFrame, count: int, radius: int) -> DataFrame:
    """u, v with u > v: links that connect all values within the radius."""
    masks = ball(radius // 2)
    buckets = max(1, -(-count * len(masks) // BUCKET_ENTRIES))

    def meet(t: pa.Table) -> pa.Table:
        value, number = _entries(t)
        order, first = _runs(value ^ masks[number])
        value = value[order]
        sizes = np.diff(np.append(first, len(value)))
        least = np.repeat(np.minimum.reduceat(value, first), sizes)
        other = value != least
        a, b = value[other], least[other]
        close = np.bitwise_count(a ^ b) <= radius
        a, b = spanning(a[close], b[close])
        return pa.table({"u": np.maximum(a, b).view(np.int64), "v": np.minimum(a, b).view(np.int64)})

    met = _scatter(nodes, masks, True, buckets).groupBy("bucket").applyInArrow(meet, "u long, v long").distinct()
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """u, root: every node above the smallest of its component, by alternating large-star and small-star steps.
    Each round is checkpointed; rounds grow with the logarithm of a component's length."""
    edges, mark = cut(edges), None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = small.select("v", "m").union(small.select("u", "m")).where("v > m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(step)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return edges.select("u", F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """id, fp, component_id (the smallest id reachable over links of at most `radius` differing bits, and over the links `more`
    of fingerprints u > v)."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    some = cut(partnered(nodes, nodes.count(), radius))
    found = links(some, some.count(), radius)
    stars = components(found if more is None else found.union(more).distinct())
    # Fingerprints with links alone; a component's rows are spread by a salt, its one row repeated for each.
    salts = 16
    members = stars.select(F.col("u").alias("fp"), "root").union(stars.select(F.col("root").alias("fp"), "root")).distinct()
    known = members.join(nodes, "fp")
    smallest = known.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    linked = known.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(smallest, ["root", "salt"]).select("fp", "component_id")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of each component, the first by id, then by a hash of the text; rows without an id come last. Linked are texts
    within the radius, and texts whose sets of shingles have at least the Jaccard similarity (see shingles). Texts are shuffled
    by that key, once to fetch those to be compared and once to drop."""
    from quillmark.llm import shingles

    names = docs.columns
    own, number = fresh("key", names), fresh("nth", names)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("hash"))
    keyed = docs.withColumn(own, key)
    groups = near_duplicates(keyed, shingle, radius, own, text_col, shingles.similar(keyed, shingle, similarity, own, text_col))
    chosen = groups.where(F.col(own) == F.col("component_id")).select(own).distinct()
    nth = F.row_number().over(Window.partitionBy(own).orderBy(text_col))
    return keyed.join(chosen, own, "left_semi").withColumn(number, nth).where(F.col(number) == 1).select(*names)


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
