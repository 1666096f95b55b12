"""Bootstrap and permutation inference as relations.

Draws are made with a seeded generator on the driver, from the number of units (works or authors: hundreds) alone, and
become a table (draw, unit, times) that joins with per-unit sums. So a statistic is a ratio of weighted sums, and no chunk is
ever resampled.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that a draw table may have: it is units x draws rows.
MOST_UNITS = 20_000


def draw_table(spark, units: list, draws: int, seed: int = 42, by_choice: bool = False) -> DataFrame:
    """draw, unit, times."""
    if len(units) > MOST_UNITS:
        raise ValueError(f"{len(units)} units: resample groups of them instead")
    rng, rows = np.random.default_rng(seed), []
    n = len(units)
    for d in range(draws if n else 0):
        picked = rng.choice(np.arange(n), size=n, replace=True) if by_choice else rng.integers(0, n, size=n)
        times = np.bincount(picked, minlength=n)
        rows += [(d, units[i], int(times[i])) for i in np.flatnonzero(times)]
    kind = "long" if units and isinstance(units[0], int) else "string"
    return spark.createDataFrame(rows, f"draw int, unit {kind}, times int")


def bootstrap(sums: DataFrame, draws: DataFrame, level: float = 0.95) -> DataFrame:
    """point, lo, hi of sum(num) / sum(den) over units; sums: unit, num, den. Linear percentiles; all zeros without units."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = sums.join(draws, "unit").groupBy("draw").agg(ratio(F.sum(F.col("num") * F.col("times")), F.sum(F.col("den") * F.col("times"))).alias("v"))
    a = (1 - level) / 2
    ends = per.agg(F.percentile("v", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    point = sums.agg(ratio(F.sum("num"), F.sum("den")).alias("point"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return point.crossJoin(ends).select(zero(F.col("point")).alias("point"), zero(F.col("q")[0]).alias("lo"), zero(F.col("q")[1]).alias("hi"))


def paired_difference(sums: DataFrame, draws: DataFrame, level: float = 0.95) -> DataFrame:
    """diff, lo, hi, significant of two ratios on the same draws; sums: unit, num_a, num_b, den."""
    d = bootstrap(sums.select("unit", (F.col("num_a") - F.col("num_b")).alias("num"), "den"), draws, level)
    return d.select(F.col("point").alias("diff"), "lo", "hi", (~((F.col("lo") <= 0) & (F.col("hi") >= 0))).alias("significant"))


def accuracy_sums(rows: DataFrame, group: str, correct: str = "correct") -> DataFrame:
    """unit, num, den of right answers by group."""
    return rows.groupBy(F.col(group).alias("unit")).agg(F.sum(F.col(correct).cast("double")).alias("num"), F.count(F.lit(1)).cast("double").alias("den"))


def units_of(sums: DataFrame) -> list:
    """The groups, sorted: as many as authors or works, checked against MOST_UNITS."""
    rows = sums.select("unit").distinct().orderBy("unit").limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError("too many units to resample one by one")
    return [r[0] for r in rows]


def clustered_ci(rows: DataFrame, group: str = "author", draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    sums = accuracy_sums(rows, group)
    return bootstrap(sums, draw_table(rows.sparkSession, units_of(sums), draws, seed, by_choice=True), level)


def flip_interval(lo: Column, hi: Column) -> tuple[Column, Column]:
    """The interval of the negated difference."""
    return -hi, -lo


def label_assignments(works: list[str], n_first: int, most_exact: int = 5000, n_random: int = 1000, seed: int = 42) -> tuple[list[set[str]], bool]:
    """Sets of works that carry the first label: all of them if they are few enough, else random ones."""
    if comb(len(works), n_first) <= most_exact:
        return [set(c) for c in combinations(works, n_first)], True
    rng = np.random.default_rng(seed)
    return [set(rng.permutation(works)[:n_first].tolist()) for _ in range(n_random)], False


def permutation_p(observed: float, values: list[float], exact: bool) -> float:
    """Share of assignments at least as good (with one added on both sides if they are random)."""
    hits = sum(v >= observed - 1e-12 for v in values)
    return hits / len(values) if exact else (hits + 1) / (len(values) + 1)


def random_orders(labels: list[str], n_random: int, seed: int) -> list[list[str]]:
    """The same labels in random orders: every author keeps the number of works."""
    rng = np.random.default_rng(seed)
    return [rng.permutation(labels).tolist() for _ in range(n_random)]


#: Works of a panel whose Gram matrix is sent to all tasks at most: 128 MB.
MOST_WORKS = 4000


def panel_recalls(vectors: DataFrame, ids: list[str], orders: list[list[str]]) -> list[float]:
    """What `permuted_recall` says of each order of labels (for the works `ids`), for any number of labels. The Gram matrix of a
    panel of at most MOST_WORKS works goes to every task, which turns an assignment into one product with it; a larger panel
    takes the relational way."""
    spark = vectors.sparkSession
    if len(ids) > MOST_WORKS:
        table = spark.createDataFrame([(i, w, x) for i, order in enumerate(orders) for w, x in zip(ids, order, strict=True)], "perm int, work_id string, label string")
        return [r.recall for r in permuted_recall(vectors, table).collect()]
    place = {w: i for i, w in enumerate(ids)}
    gram = np.zeros((len(ids), len(ids)))
    pairs = vectors.alias("a").join(vectors.alias("b"), "term").groupBy(F.col("a.work_id").alias("w"), F.col("b.work_id").alias("o")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("g"))
    for w, o, g in pairs.toLocalIterator():
        if w in place and o in place:
            gram[place[w], place[o]] = g
    names = sorted(set(orders[0]))
    codes = np.array([[names.index(x) for x in order] for order in orders])
    sent = spark.sparkContext.broadcast((gram, codes, len(names)))

    def run(batches):
        gram, codes, k = sent.value
        self_ = np.diag(gram)
        for b in batches:
            out = []
            for perm in b["id"]:
                own = np.eye(k)[codes[perm]]
                dot = gram @ own
                square = (own * dot).sum(axis=0)
                dot -= self_[:, None] * own  # a label's sum without the work itself
                left = square - own * (2 * dot + self_[:, None])
                cos = np.where(left > 1e-18, dot / np.sqrt(np.maximum(left, 1e-18)), -1.0)
                hit = cos.argmax(axis=1) == codes[perm]
                out.append(float(((own * hit[:, None]).sum(axis=0) / own.sum(axis=0)).mean()))
            yield b.assign(recall=out)

    rows = spark.range(len(orders), numPartitions=max(1, min(len(orders) // 50, 64))).mapInPandas(run, "id long, recall double")
    return [r.recall for r in rows.orderBy("id").collect()]


def permuted_recall(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """perm, recall: leave-one-work-out nearest-centroid recall, averaged over two labels, for every assignment at once. vectors:
    work_id, term, value (unit rows); assignments: perm, work_id, label. Centroids without a work are sums less its own row; cosines
    come from the works' Gram matrix, which has works x works rows, whatever the vocabulary."""
    gram = vectors.alias("a").join(vectors.alias("b"), "term").groupBy(F.col("a.work_id").alias("w"), F.col("b.work_id").alias("o")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("g"))
    la = assignments.select("perm", F.col("work_id").alias("w"), F.col("label").alias("lw"))
    lo = assignments.select("perm", F.col("work_id").alias("o"), F.col("label").alias("lo"))
    # for each work and candidate label: w.s and |s|^2 of the label's sum s without w
    pair = la.join(lo, "perm")
    dots = pair.where("w <> o").join(gram, ["w", "o"], "left").groupBy("perm", "w", "lw", "lo").agg(F.sum(F.coalesce("g", F.lit(0.0))).alias("dot"))
    la2 = lo.select("perm", F.col("o").alias("x"), F.col("lo").alias("lx")).join(lo.select("perm", F.col("o").alias("y"), F.col("lo").alias("ly")), "perm").where("lx = ly")
    square = la2.join(gram.select(F.col("w").alias("x"), F.col("o").alias("y"), "g"), ["x", "y"], "left").groupBy("perm", F.col("lx").alias("lo")).agg(F.sum(F.coalesce("g", F.lit(0.0))).alias("ss"))
    own = gram.where("w = o").select("w", F.col("g").alias("self"))
    j = dots.join(square, ["perm", "lo"]).join(own, "w")
    left = F.when(F.col("lw") == F.col("lo"), F.col("ss") - 2 * F.col("dot") - F.col("self")).otherwise(F.col("ss"))
    cos = F.when(left > 1e-18, F.col("dot") / F.sqrt(left)).otherwise(F.lit(-1.0))
    best = j.withColumn("cos", cos).groupBy("perm", "w", "lw").agg(F.min(F.struct((-F.col("cos")).alias("n"), "lo"))["lo"].alias("pred"))
    per = best.groupBy("perm", "lw").agg(F.avg((F.col("pred") == F.col("lw")).cast("double")).alias("r"))
    return per.groupBy("perm").agg(F.avg("r").alias("recall"))


def block_permutation_p(series: DataFrame, starts: int, window: int, seed: int = 42) -> DataFrame:
    """p that the mean of one side of a timeline differs from the other's by more than between random blocks. series: side (a or b),
    ordinal, value."""
    totals = series.groupBy("side").agg(F.avg("value").alias("m"))
    observed = F.abs(F.max(F.when(F.col("side") == "a", F.col("m"))) - F.max(F.when(F.col("side") == "b", F.col("m"))))
    obs = totals.agg(observed.alias("obs"))
    n = series.count()
    rng = np.random.default_rng(seed)
    picks = [(d, s, int(x)) for d in range(starts) for s, x in zip("ab", rng.integers(0, max(n - window, 0) + 1, size=2), strict=True)]
    table = series.sparkSession.createDataFrame(picks, "draw int, which string, start long")
    means = series.join(F.broadcast(table), (F.col("ordinal") >= F.col("start")) & (F.col("ordinal") < F.col("start") + window)).groupBy("draw", "which").agg(F.avg("value").alias("m"))
    diff = means.groupBy("draw").agg(F.abs(F.max(F.when(F.col("which") == "a", F.col("m"))) - F.max(F.when(F.col("which") == "b", F.col("m")))).alias("d"))
    return diff.crossJoin(obs).agg(((1 + F.sum((F.col("d") >= F.col("obs")).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"))
