"""Attribution over long relations: frequency distances, centroids, baselines, their folds.

A closed panel is small: centroids and statistics have authors x vocabulary rows. Test units are many, so they are never
copied per author before their terms are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import vocabulary as V


def unit_means(values: DataFrame, units: DataFrame, group: str) -> DataFrame:
    """group, term, value: the mean over a group's units, absent values being zeros. units: unit and group of every unit."""
    n = units.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    unit = next(c for c in units.columns if c != group)
    return values.join(units, unit).groupBy(group, "term").agg(F.sum("value").alias("_s")).join(n, group).select(group, "term", (F.col("_s") / F.col("_n")).alias("value"))


def unit_length(values: DataFrame, unit: str) -> DataFrame:
    """Rows of length one; rows of zeros stay."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(unit)))
    return values.select(unit, "term", F.when(norm > 0, F.col("value") / norm).otherwise(F.col("value")).alias("value"))


def delta_model(rows: DataFrame, most: int = 150, denominator: str = "events", vocabulary: str = "pooled") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statistics (term, mean, std), work z-scores (work_id, author, term, z) and centroids (author, term, z). rows: author, work_id,
    text. denominator: `events` (all tokens) or `selected` (tokens of the vocabulary); vocabulary: `pooled` or `work`."""
    terms = T.words(F.col("text"))
    table = V.hoisted(V.counts(rows, terms))
    sizes = V.hoisted(V.sizes_of(table)) if denominator == "events" or vocabulary == "work" else None
    vocab = V.most_frequent(table, most) if vocabulary == "pooled" else V.work_vocabulary(table, sizes, most)
    chosen = table.join(F.broadcast(vocab.select("term")), "term")  # `most` rows
    values = V.relative(chosen, sizes) if denominator == "events" else V.selected_share(chosen)
    units = V.hoisted(rows.select("work_id", "author").distinct())
    stats = V.statistics(values, units)
    z = V.hoisted(V.zscores(values, stats, units).join(units, "work_id"))
    return stats, z, z.groupBy("author", "term").agg(F.avg("z").alias("c"))


def delta_distances(z: DataFrame, centroids: DataFrame, metric: str = "manhattan", unit: str = "work_id") -> DataFrame:
    """unit, candidate, distance; the mean absolute difference over the vocabulary, or 1 - cosine."""
    pairs = z.join(F.broadcast(centroids.withColumnRenamed("author", "candidate")), "term")  # authors x vocabulary rows
    if metric == "manhattan":
        return pairs.groupBy(unit, "candidate").agg(F.avg(F.abs(F.col("z") - F.col("c"))).alias("distance"))
    dot = F.sum(F.col("z") * F.col("c")) / (F.sqrt(F.sum(F.col("z") * F.col("z"))) * F.sqrt(F.sum(F.col("c") * F.col("c"))))
    return pairs.groupBy(unit, "candidate").agg((1 - F.coalesce(dot, F.lit(0.0))).alias("distance"))


def held_out_delta(z: DataFrame, metric: str = "manhattan") -> DataFrame:
    """work_id, author, candidate, distance (as in `delta_distances`), each work against centroids without it: the author's sum less its
    own row, so folds cost nothing. Works that are an author's only one have no own candidate."""
    sums = z.groupBy("author", "term").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n")).withColumnRenamed("author", "candidate")
    pairs = z.join(F.broadcast(sums), "term")
    own = F.col("author") == F.col("candidate")
    c = F.when(own & (F.col("n") > 1), (F.col("s") - F.col("z")) / (F.col("n") - 1)).when(~own, F.col("s") / F.col("n"))
    rows = pairs.where(~own | (F.col("n") > 1)).withColumn("c", c)
    if metric == "manhattan":
        return rows.groupBy("work_id", "author", "candidate").agg(F.avg(F.abs(F.col("z") - F.col("c"))).alias("distance"))
    dot = F.sum(F.col("z") * F.col("c")) / (F.sqrt(F.sum(F.col("z") * F.col("z"))) * F.sqrt(F.sum(F.col("c") * F.col("c"))))
    return rows.groupBy("work_id", "author", "candidate").agg((1 - F.coalesce(dot, F.lit(0.0))).alias("distance"))


def softmax(scores: DataFrame, unit: str, value: str, sign: float = -1.0) -> DataFrame:
    """p: exp of the shifted (negative) value over its sum, with 1e-12 below the line."""
    w = Window.partitionBy(unit)
    e = F.exp(sign * F.col(value) - F.max(sign * F.col(value)).over(w))
    return scores.withColumn("_e", e).withColumn("p", F.col("_e") / (F.sum("_e").over(w) + 1e-12)).drop("_e")


def nearest(distances: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, candidate, distance of the smallest distance; a tie goes to the first candidate."""
    return distances.groupBy(unit).agg(F.min(F.struct("distance", "candidate")).alias("b")).select(unit, "b.candidate", "b.distance")


def cosine_centroids(values: DataFrame, units: DataFrame, balanced: bool = True, unit: str = "work_id") -> DataFrame:
    """author, term, value: of length one; of unit work means if balanced, else of all units alike."""
    own = units.select(F.col(unit), "author").distinct()
    rows = unit_length(values, unit) if balanced else values
    return unit_length(unit_means(rows, own, "author"), "author")


def cosine_scores(values: DataFrame, centroids: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, candidate, score: dot products over shared terms; units and candidates without one do not appear."""
    return unit_length(values, unit).join(centroids.select(F.col("author").alias("candidate"), "term", F.col("value").alias("c")), "term").groupBy(unit, "candidate").agg(F.sum(F.col("value") * F.col("c")).alias("score"))


def held_out_cosine(values: DataFrame, units: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, author, candidate, score against centroids without the unit: of unit rows, sums and squared lengths less the own part."""
    rows = unit_length(values, unit).join(units.select(unit, "author"), unit)
    sums = rows.groupBy("author", "term").agg(F.sum("value").alias("s"))
    lengths = sums.groupBy("author").agg(F.sum(F.col("s") * F.col("s")).alias("q")).withColumnRenamed("author", "candidate")
    dots = rows.join(sums.withColumnRenamed("author", "candidate"), "term").groupBy(unit, "author", "candidate").agg(F.sum(F.col("value") * F.col("s")).alias("d"))
    n = units.groupBy("author").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("author", "candidate")
    own = F.col("author") == F.col("candidate")
    # |s - x|^2 = |s|^2 - 2 s.x + 1 for a row of length one
    score = F.when(own, (F.col("d") - 1) / F.sqrt(F.greatest(F.col("q") - 2 * F.col("d") + 1, F.lit(1e-18)))).otherwise(F.col("d") / F.sqrt("q"))
    return dots.join(lengths, "candidate").join(n, "candidate").where(~own | (F.col("n") > 1)).select(unit, "author", "candidate", score.alias("score"))


def best(scores: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, candidate, score of the largest score; a tie goes to the first candidate."""
    return scores.groupBy(unit).agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("candidate"))).alias("b")).select(unit, "b.candidate", (-F.col("b.neg")).alias("score"))


def majority(rows: DataFrame, label: str = "author") -> DataFrame:
    """The most frequent label, the smallest on a tie."""
    return rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(1)


def tail_presence(table: DataFrame, ranks: DataFrame, low: int, high: int, units: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, share: how much of a band of ranks the unit has."""
    band = ranks.where(F.col("rank").between(low, high)).select("term")
    have = table.join(F.broadcast(band), "term").groupBy(unit).agg(F.count_distinct("term").alias("k"))
    return units.select(unit).join(have, unit, "left").select(unit, (F.coalesce("k", F.lit(0)) / F.lit(high - low + 1)).alias("share"))


def whole_works(chunks: DataFrame) -> DataFrame:
    """author, work_id, text of chunks in order."""
    return chunks.groupBy("author", "work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), " ").alias("text"))


def impostors(profiles: DataFrame, target: str, author: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """One row: the share of rounds in which the author is nearer the target than every impostor, each round on a random half of the
    features (a hash of round and feature decides). profiles: author, term, value."""
    masks = profiles.select("term").distinct().crossJoin(profiles.sparkSession.range(rounds).withColumnRenamed("id", "round")).where(F.pmod(F.xxhash64("round", "term", F.lit(seed)), F.lit(2)) == 0)
    own = profiles.where(F.col("author") == target).select("term", F.col("value").alias("t"))
    rest = profiles.where(F.col("author") != target)
    length = masks.join(own, "term").groupBy("round").agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    sums = masks.join(rest, "term").join(own, "term", "left").groupBy("round", "author").agg(F.sum(F.col("value") * F.coalesce("t", F.lit(0.0))).alias("d"), F.sum(F.col("value") * F.col("value")).alias("vv"))
    cos = sums.join(length, "round").withColumn("cos", F.col("d") / F.sqrt(F.col("tt") * F.col("vv")))
    per = cos.groupBy("round").agg(F.max(F.when(F.col("author") == author, F.col("cos"))).alias("a"), F.max(F.when(F.col("author") != author, F.col("cos"))).alias("b"))
    return per.agg(F.avg((F.col("a") > F.col("b")).cast("double")).alias("share"))
