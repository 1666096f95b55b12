"""A panel's unit vectors in one narrow row a work, and label permutations over them.

A row has its terms' places and their values. A pass over the rows makes pieces of them dense in the worker; what meets are
sums of vectors by label, so no relation of pairs of works, or of works and assignments, is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import delta as D
from quillmark.operators import vocabulary as V

#: Works that a worker makes dense at once; bytes of labels sent, and of sums fetched, in one pass.
PIECE, SENT, FETCHED = 1024, 1 << 24, 1 << 24


def packed_counts(chunks: DataFrame, words: Column, vocabulary: list[str]) -> DataFrame:
    """work_id, author, places, values of unit length: the mean of a work's chunk rows of word counts. Chunks are counted where they
    are, and a chunk is one array when a work's chunks meet. chunks: work_id, author, text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind, size = dict(chunks.dtypes)["work_id"], len(vocabulary)

    def count(batches):
        known = pa.array(vocabulary, pa.string())
        for b in batches:
            w = b.column("w")
            at = pc.index_in(w.flatten(), known)
            owner = np.repeat(np.arange(len(w)), pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False))
            has = pc.is_valid(at).to_numpy(zero_copy_only=False)
            keys, n = np.unique(owner[has].astype(np.int64) * size + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(w) + 1) * size)
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((keys % size << D.PLACE) + n, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("work_id"), b.column("author"), cells], ["work_id", "author", "cells"])

    def pack(batches):
        for b in batches:
            for k in range(0, b.num_rows, PIECE):
                part = b.slice(k, PIECE)
                cells = part.column("cells").flatten()
                own = D.unit_rows(D.dense(cells, pa.array(np.ones(len(cells))), size))
                x = np.zeros((part.num_rows, size))
                np.add.at(x, np.repeat(np.arange(part.num_rows), part.column("cells").value_lengths().to_numpy(zero_copy_only=False)), own)
                x = D.unit_rows(x)
                row, col = np.nonzero(x)
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("work_id"), part.column("author"), pa.ListArray.from_arrays(ends, pa.array(col, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(x[row, col]))], ["work_id", "author", "places", "values"])

    own = chunks.select("work_id", "author", words.alias("w")).mapInArrow(count, f"work_id {kind}, author string, cells array<long>")
    return own.groupBy("work_id", "author").agg(F.collect_list("cells").alias("cells")).mapInArrow(pack, f"work_id {kind}, author string, places array<int>, values array<double>")


def packed(vectors: DataFrame, works: DataFrame, vocabulary: list[str]) -> DataFrame:
    """As `packed_counts`, of a long relation (work_id, term, value) of unit rows; works without terms are rows of zeros."""
    places = vectors.sparkSession.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "term string, place int")
    rows = vectors.join(F.broadcast(places), "term").groupBy("work_id").agg(F.collect_list(F.struct("place", "value")).alias("c"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return works.select("work_id", "author").distinct().join(rows, "work_id", "left").select("work_id", "author", none(F.col("c.place"), "int").alias("places"), none(F.col("c.value"), "double").alias("values"))


class Panel:
    """Kept unit rows with their numbers; the driver has each work's id and author once, in Arrow, until they are numbered by id."""

    def __init__(self, rows: DataFrame, size: int):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.size, self.spark = size, rows.sparkSession
        # sorted, so that a part that is lost is numbered the same when it is made again; few parts, as each sends its sums in each pass
        self.rows = V.hoisted(rows.coalesce(2 * self.spark.sparkContext.defaultParallelism).sortWithinPartitions("work_id").withColumn("at", F.monotonically_increasing_id()))
        table = self.rows.select("at", F.col("work_id").cast("string").alias("work_id"), "author").toArrow().sort_by("at")
        at = table["at"].to_numpy()
        parts, counts = np.unique(at >> 33, return_counts=True)
        self.starts = dict(zip(parts.tolist(), np.cumsum([0, *counts[:-1]]).tolist(), strict=True)) if len(parts) else {}
        self.authors = sorted(set(table["author"].unique().to_pylist()))
        own = pc.index_in(table["author"], pa.array(self.authors, pa.string())).to_numpy().astype(np.min_scalar_type(max(len(self.authors) - 1, 1)))
        order = pc.sort_indices(table, sort_keys=[("work_id", "ascending"), ("author", "ascending")]).to_numpy()
        #: Labels in the order of the works' ids, and each kept row's place in that order.
        self.labels, self.place = own[order], np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.works = np.bincount(own, minlength=len(self.authors)).astype(float)

    def vectors(self):
        """For a task: batches to (part, numbers of its rows, dense rows)."""
        starts, size = self.starts, self.size

        def run(batches):
            for b in batches:
                for k in range(0, b.num_rows, PIECE):
                    part = b.slice(k, PIECE)
                    lists, x = part.column("places"), np.zeros((part.num_rows, size))
                    owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                    x[owner, lists.flatten().to_numpy(zero_copy_only=False)] = part.column("values").flatten().to_numpy(zero_copy_only=False)
                    at = part.column("at").to_numpy(zero_copy_only=False)
                    yield part, np.array([starts[p] for p in (at >> 33).tolist()], np.int64) + (at & ((1 << 33) - 1)), x

        return run

    def held_out(self) -> DataFrame:
        """work_id, author, candidate, score, as `attribution.held_out_cosine`."""
        names, rows = {a: k for k, a in enumerate(self.authors)}, self.vectors()

        def vectors(batches):
            for part, _, x in rows(batches):
                yield part, np.array([names[a] for a in part.column("author").to_pylist()], int), x

        return D.cosines(self.rows, vectors, self.authors, self.works, self.size)

    def random_orders(self, n: int, seed: int) -> Iterator[np.ndarray]:
        """`resampling.random_orders` one by one, as places of labels."""
        rng = np.random.default_rng(seed)
        return (rng.permutation(self.labels) for _ in range(n))

    def recalls(self, orders: Iterator[np.ndarray]) -> list[float]:
        """Leave-one-work-out nearest-centroid recall, averaged over labels, of each order of labels (by the works' ids)."""
        k = len(self.authors)
        tasks = max(1, self.rows.rdd.getNumPartitions())
        most = max(1, min(128, SENT // max(len(self.place), 1), FETCHED // max(1, tasks * k * self.size * 8)))
        out, batch = [], []
        for order in orders:
            batch.append(order[self.place])
            if len(batch) == most:
                out += self._recalls(np.array(batch), k)
                batch = []
        return out + (self._recalls(np.array(batch), k) if batch else [])

    def _recalls(self, codes: np.ndarray, k: int) -> list[float]:
        import pyarrow as pa

        n, size, vectors, sc = len(codes), self.size, self.vectors(), self.spark.sparkContext
        sent = sc.broadcast(codes)

        def sums(batches):
            total = np.zeros((n * k, size))
            for _, at, x in vectors(batches):
                total += (sent.value[:, None, at] == np.arange(k)[:, None]).astype(float).reshape(n * k, -1) @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        s = np.zeros((n * k, size))
        for r in self.rows.mapInArrow(sums, "s binary").collect():
            s += np.frombuffer(r.s).reshape(s.shape)
        square = (s * s).sum(axis=1)
        length = np.sqrt(square)
        table = sc.broadcast((np.divide(s, length[:, None], out=np.zeros_like(s), where=square[:, None] > 1e-18).T.copy(), square, length))

        def hits(batches):
            to, square, length = table.value
            empty, first = np.where(square > 1e-18, 0.0, -1.0), np.arange(n) * k
            found = np.zeros(n * k, np.int64)
            for _, at, x in vectors(batches):
                d = x @ to
                if empty.any():
                    d += empty
                own = sent.value[:, at].T + first  # each row's place by order
                self_ = (x * x).sum(axis=1)[:, None]
                dot = np.take_along_axis(d, own, 1) * length[own]
                left = square[own] - 2 * dot + self_
                np.put_along_axis(d, own, np.where(left > 1e-18, (dot - self_) / np.sqrt(np.maximum(left, 1e-18)), -1.0), 1)
                found += np.bincount(own[d.reshape(len(x), n, k).argmax(axis=2) + first == own], minlength=n * k)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["n"])

        found = sum((np.frombuffer(r.n, np.int64) for r in self.rows.mapInArrow(hits, "n binary").collect()), np.zeros(n * k, np.int64))
        for b in (sent, table):
            b.destroy()
        return (found.reshape(n, k) / self.works).mean(axis=1).tolist()

    def close(self) -> None:
        self.rows.unpersist()
