"""Links of texts by the Jaccard similarity of their word shingles: candidates by banded MinHash, each verified exactly.

A text has BANDS keys of ROWS minima of its shingles' hashes each; texts meet where a key is equal. Two texts of similarity s
meet with probability 1 - (1 - s^ROWS)^BANDS: 0.999995 at 0.8, more above. Texts that meet are compared by their whole sets of
shingle hashes, so no link is made below the similarity.

What is shuffled: texts that are equal but for case and white space collapse first; keys move in packed arrays; whole sets move
only for texts that meet another, once for each different group they meet in (copies that meet in many bands in the same
company meet once). In a group every two texts that are not yet connected are compared: a group of texts alike costs one
comparison a text, only one of texts that share keys but are not alike costs the square of its size.

Defined cases: null and empty texts are alike; a text of fewer words than a shingle is one shingle; repeated rows are one text;
an empty table gives no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, map_batches
from quillmark.llm.simhash import BUCKET_ENTRIES, _bucket, _runs, fingerprint, shingle_hashes

BANDS, ROWS = 40, 6
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
#: Shingles that are hashed at once: the arrays stay in the cache.
AT_ONCE = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def unit(text: str | None) -> int:
    """A hash of the words, alike for texts that differ in case of ASCII and white space only."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 7)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    found = np.unique(shingle_hashes(text, shingle))
    return found if len(found) else np.zeros(1, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set."""
    out, i = np.zeros((len(sets), BANDS), np.uint64), 0
    while i < len(sets):
        z, size = i, 0
        while z < len(sets) and (z == i or size + len(sets[z]) <= AT_ONCE):
            size, z = size + len(sets[z]), z + 1
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : z - 1]], dtype=np.int64)]).astype(np.int64)
        hashes = _mixed(np.concatenate(sets[i:z]))
        for band in range(BANDS):
            key = np.full(z - i, band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], starts))
            out[i:z, band] = key
        i = z
    return out


def meetings(units: DataFrame, count: int) -> DataFrame:
    """meeting, unit: the groups of two or more units that share a key; groups of the same units are one. units: unit, bands."""
    buckets = max(1, -(-count * BANDS // BUCKET_ENTRIES))
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        step = BUCKET_ENTRIES // BANDS
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                own = np.repeat(part.column("unit").to_numpy(zero_copy_only=False).view(np.uint64), BANDS)
                key = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.uint64)
                at = _bucket(key, 0, buckets)
                order = np.argsort(at, kind="stable")
                own, key, at = own[order], key[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                ends = np.append(first[1:], len(at))
                yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array([key[a:z].tobytes() + own[a:z].tobytes() for a, z in zip(first, ends, strict=True)], pa.binary())], schema=schema)

    def meet(t: pa.Table) -> pa.Table:
        halves = [np.frombuffer(p, np.uint64).reshape(2, -1) for p in t.column("payload").to_pylist()]
        key, own = np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
        order, first = _runs(key)
        own = own[order]
        sizes = np.diff(np.append(first, len(own)))
        group = np.repeat(np.add.reduceat(_mixed(own), first), sizes)
        met = np.repeat(sizes > 1, sizes)
        return pa.table({"meeting": group[met].view(np.int64), "unit": own[met].view(np.int64)})

    return units.select("unit", "bands").mapInArrow(run, "bucket int, payload binary").groupBy("bucket").applyInArrow(meet, "meeting long, unit long").distinct()


def connected(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links i-j of sets of at least the similarity that connect all such pairs. Who is not in the largest component is compared
    with all of other components, so every two sets that end up apart have been compared."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    label, members, waiting = np.arange(len(sets)), np.ones(len(sets), np.int64), np.ones(len(sets), bool)
    mark, out = np.zeros(len(names), np.int32), []
    while True:
        todo = np.flatnonzero(waiting & (label != members.argmax()))
        if not len(todo):
            return out
        i = int(todo[0])
        waiting[i] = False
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        alike = (both >= similarity * (sizes[i] + sizes - both) - 1e-9) & (label != label[i])
        for other in np.unique(label[alike]).tolist():
            out.append((i, int(np.flatnonzero(alike & (label == other))[0])))
            members[label[i]] += members[other]
            members[other] = 0
            label[label == other] = label[i]


def similar(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """u, v with u > v: links between the fingerprints (see simhash) of texts of at least the similarity, enough to connect all
    such texts that meet. The ids must tell texts apart."""
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keys(b: dict[str, list]) -> dict[str, list]:
        bands = band_keys([shingle_set(t, shingle) for t in b["text"]])
        return {"id": b["id"], "unit": np.array([unit(t) for t in b["text"]], np.uint64).view(np.int64), "bands": [k.tobytes() for k in bands]}

    def whole(b: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t, shingle).tobytes() for t in b["text"]]
        return {"unit": b["unit"], "fp": np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64), "shingles": sets}

    def verify(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy()
        pairs = np.array(connected([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()], similarity), np.int64).reshape(-1, 2)
        a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
        return pa.table({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    units = cut(map_batches(own, keys, f"id {kind}, unit long, bands binary").groupBy("unit").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")))
    met = cut(meetings(units, units.count()))
    some = units.join(met.select("unit").distinct(), "unit", "left_semi").select("id", "unit")
    sets = cut(map_batches(own.join(some, "id").select("unit", "text"), whole, "unit long, fp long, shingles binary").dropDuplicates(["unit"]))
    return met.join(sets, "unit").groupBy("meeting").applyInArrow(verify, "u long, v long").where("u > v").distinct()
