"""Verification: are two works by one author? Pair features with a logistic model, and unmasking of two works."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import chars as CH
from quillmark.operators import features as FT
from quillmark.operators import models as ML
from quillmark.operators import vocabulary as V

PAIR = ("cos_words", "cos_char3", "cos_char4", "d_sentence", "d_ttr", "d_punct")


def pairs(works: DataFrame, different: int = 1, seed: int = 42) -> DataFrame:
    """a, b, same: each work with the next one of its author (in the order of a hash), and with `different` works of others, drawn by
    a hash: pairs grow with the works and not with their square. works: author, work_id."""
    own = works.select("author", "work_id").distinct().withColumn("h", F.xxhash64("work_id", F.lit(seed)))
    nxt = F.lead("work_id").over(Window.partitionBy("author").orderBy("h", "work_id"))
    same = own.select(F.col("work_id").alias("a"), nxt.alias("b"), F.lit(1).alias("same")).where("b is not null")
    slots = max(1, own.count() // max(1, 2 * different))
    left = own.select("author", "work_id", F.explode(F.sequence(F.lit(1), F.lit(different))).alias("k")).select(F.col("author").alias("aa"), F.col("work_id").alias("a"), F.pmod(F.xxhash64("work_id", "k", F.lit(seed)), F.lit(slots)).alias("slot"))
    right = own.select(F.col("author").alias("ab"), F.col("work_id").alias("b"), F.pmod(F.xxhash64("work_id", F.lit(seed + 1)), F.lit(slots)).alias("slot"))
    met = left.join(right, "slot").where("aa <> ab").withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))).where(F.col("n") <= different)
    return same.unionByName(met.select("a", "b", F.lit(0).alias("same")))


def _cosine(pairs_: DataFrame, values: DataFrame, name: str) -> DataFrame:
    unit = values.select("work_id", "term", (F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("work_id")))).alias("value"))
    j = pairs_.join(unit.select(F.col("work_id").alias("a"), "term", F.col("value").alias("x")), "a").join(unit.select(F.col("work_id").alias("b"), "term", F.col("value").alias("y")), ["b", "term"])
    return j.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias(name))


def _char_cosines(pairs_: DataFrame, fit: DataFrame, works: DataFrame, most: int) -> DataFrame:
    """a, b, cos_char3, cos_char4 (null without a shared gram). A work is one row of packed counts, so what meets are pairs of works."""
    import zlib

    import pyarrow as pa

    text = CH.folded(F.lower(F.col("text")))
    known = [(n, CH.most_frequent(fit.select(text.alias("text")), n, most)) for n in (3, 4)]
    ends = np.cumsum([0, *(len(v) for _, v in known)])

    def pack(batches):
        for part, points, owner in CH.pieces(batches):
            x = np.concatenate([CH.counted(points, owner, part.num_rows, v, n) for n, v in known], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], ["work_id", "x"])

    def meet(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x, y = (np.stack([np.sum([np.frombuffer(zlib.decompress(r), np.int32) for r in rows], axis=0, dtype=float) for rows in part.column(c).to_pylist()]) for c in "xy")
                out = []
                for i, j in zip(ends, ends[1:], strict=False):
                    u, v = x[:, i:j], y[:, i:j]
                    dot, below = (u * v).sum(axis=1), np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
                    out.append(pa.array(np.divide(dot, below, out=np.zeros(len(dot)), where=below > 0), pa.float64(), mask=dot == 0))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *out], ["a", "b", "cos_char3", "cos_char4"])

    kind = dict(works.dtypes)["work_id"]
    rows = works.select("work_id", text.alias("text")).mapInArrow(pack, f"work_id {kind}, x binary").groupBy("work_id").agg(F.collect_list("x").alias("x"))
    met = pairs_.select("a", "b").distinct().join(rows.withColumnRenamed("work_id", "a"), "a").join(rows.select(F.col("work_id").alias("b"), F.col("x").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(meet, f"a {kind}, b {kind}, cos_char3 double, cos_char4 double")


def pair_features(works: DataFrame, pairs_: DataFrame, most: int = 500, fit_on: DataFrame | None = None) -> DataFrame:
    """a, b, same and PAIR: cosines of word and character profiles over vocabularies of `fit_on`, differences of mean sentence length,
    type-token ratio and punctuation."""
    fit = works if fit_on is None else fit_on
    out = pairs_
    terms = T.words(F.col("text"))
    vocab = V.most_frequent(V.counts(fit, terms, []), most).select("term")
    values = V.counts(works, terms).join(F.broadcast(vocab), "term").select("work_id", "term", F.col("n").cast("double").alias("value"))
    out = out.join(_cosine(pairs_, values, "cos_words"), ["a", "b"], "left")
    out = out.join(_char_cosines(pairs_, fit, works, most), ["a", "b"], "left")
    t = F.col("text")
    scalars = works.select("work_id", FT.mean_lengths(t)["avg_sent"].alias("s"), F.coalesce(F.try_divide(F.size(F.array_distinct(T.words(t))), F.size(T.words(t))), F.lit(0.0)).alias("t"), FT.punctuation_rates(t)["punct_ratio"].alias("p"))
    for side in "ab":
        out = out.join(scalars.select(F.col("work_id").alias(side), *(F.col(c).alias(f"{side}{c}") for c in "stp")), side)
    gap = lambda c: F.abs(F.col(f"a{c}") - F.col(f"b{c}"))
    return out.select("a", "b", "same", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in PAIR[:3]), gap("s").alias("d_sentence"), gap("t").alias("d_ttr"), gap("p").alias("d_punct"))


def verifier(features: DataFrame):
    """A logistic model of `same` on PAIR."""
    rows = VectorAssembler(inputCols=list(PAIR), outputCol="features").transform(features).select(F.col("same").alias("label"), "features", F.lit(1.0).alias("weight"))
    return ML.logistic(rows)


def verify(model, features: DataFrame) -> DataFrame:
    """a, b, p that both are by one author."""
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(PAIR), outputCol="features").transform(features)
    return model.transform(rows).select("a", "b", vector_to_array("probability")[1].alias("p"))


def unmasking(chunks: DataFrame, a: str, b: str, most: int = 250, rounds: int = 14, remove: int = 20, least: int = 5) -> list[float]:
    """Cross-validated accuracy of telling the chunks of two works apart, while each round takes away the features that weigh most on
    either side: it falls fast for one author. Only two works' chunks over `most` words come to the driver. Empty with too few chunks.
    chunks: work_id, chunk_id, text."""
    own = chunks.where(F.col("work_id").isin(a, b))
    table = V.counts(own, T.words(F.col("text")), "chunk_id")
    vocab = V.most_frequent(table, most).select("term", "rank")
    values = V.relative(table.join(F.broadcast(vocab.select("term")), "term"), V.events(own, T.words(F.col("text")), "chunk_id"), "chunk_id")
    where = {r.chunk_id: r.work_id for r in own.select("chunk_id", "work_id").collect()}
    rank = {r.term: r["rank"] - 1 for r in vocab.collect()}
    ids = sorted(where, key=lambda c: (where[c] != a, c))
    x = np.zeros((len(ids), len(rank)))
    at = {c: i for i, c in enumerate(ids)}
    for r in values.collect():
        x[at[r.chunk_id], rank[r.term]] = r.value
    y = np.array([1.0 if where[c] == a else -1.0 for c in ids])
    return curve(x, y, rounds, remove, least)


def curve(x: np.ndarray, y: np.ndarray, rounds: int, remove: int, least: int) -> list[float]:
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    if min(map(len, sides)) < least:
        return []
    folds = min(5, *map(len, sides))
    fold = np.empty(len(y), int)
    for side in sides:
        fold[side] = np.arange(len(side)) * folds // len(side)
    alive, out = np.arange(x.shape[1]), []
    for _ in range(rounds):
        if len(alive) < remove + 2:
            break
        own, hits = x[:, alive], []
        for f in range(folds):
            w = ML.squared_hinge(own[fold != f], y[fold != f])
            hits.append(np.mean(np.sign(own[fold == f] @ w[:-1] + w[-1]) == y[fold == f]))
        out.append(round(float(np.mean(hits)), 3))
        order = np.argsort(ML.squared_hinge(own, y)[:-1], kind="stable")
        alive = np.delete(alive, np.concatenate([order[: remove // 2], order[-(remove // 2) :]]))
    return out


def degradation(values: list[float]) -> float | None:
    """Mean accuracy of the last three rounds; lower speaks for one author."""
    return float(np.mean(values[-3:])) if values else None


def split_safely(text: Column, limit: int) -> Column:
    """Pieces of at most `limit` characters that join to the text, cut after a space where a piece has one."""
    piece = f"(?s).{{1,{limit - 1}}} (?=.)|.{{1,{limit}}}" if limit > 1 else "(?s)."
    whole = f"(?s)\\A.{{0,{limit}}}\\z"
    return F.when(text.rlike(whole), F.filter(F.array(text), lambda t: t != "")).otherwise(F.regexp_extract_all(text, F.lit(piece), F.lit(0)))
