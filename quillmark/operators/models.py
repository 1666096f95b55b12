"""Learned classifiers on long feature relations: logistic regression, squared-hinge SVM, calibration, fusion, projection.

Sparse vectors are made at the edge of the learner only. Folds of a closed panel are a driver loop; within one, training
is distributed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indexed(terms: DataFrame) -> DataFrame:
    """term, idx in order of term; a vocabulary that is capped before."""
    return terms.select("term").distinct().withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)


def vectors(values: DataFrame, index: DataFrame, size: int, units: DataFrame, unit: str = "work_id") -> DataFrame:
    """units with a sparse `features` column; unknown terms go, units without any term have an empty vector."""
    pairs = values.join(index, "term").groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("p"))

    @F.udf(VectorUDT())
    def sparse(p):
        return Vectors.sparse(size, [x[0] for x in p or []], [x[1] for x in p or []])

    return units.join(pairs, unit, "left").withColumn("features", sparse("p")).drop("p")


def logistic(rows: DataFrame, c: float = 1.0, weight: str = "weight", iterations: int = 200):
    """Multinomial logistic regression that minimises c x weighted loss + half the squared length, no scaling."""
    total = rows.agg(F.sum(weight)).first()[0]
    return LogisticRegression(labelCol="label", featuresCol="features", weightCol=weight, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-8).fit(rows)


def equal_mass(c: float, rows: int, works: int) -> float:
    """The c with which weights that sum to the works regularise as weights that sum to the rows."""
    return c * rows / works


def probabilities(model, rows: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, label, p."""
    return model.transform(rows).select(unit, F.posexplode(vector_to_array("probability")).alias("label", "p"))


def held_out_logistic(rows: DataFrame, folds: list, fold_col: str = "fold", unit: str = "work_id", c: float = 1.0) -> DataFrame:
    """unit, label, p, each fold by a model of the others."""
    out = None
    for f in folds:
        part = probabilities(logistic(rows.where(F.col(fold_col) != f), c), rows.where(F.col(fold_col) == f), unit)
        out = part if out is None else out.unionByName(part)
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 500) -> np.ndarray:
    """Weights (with intercept last, regularised) of a linear SVM with squared hinge: conjugate steps of a smooth convex problem."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ w))
        grad = w - 2 * c * z.T @ (y * slack)
        if np.linalg.norm(grad) < 1e-8 * max(1.0, len(x)):
            break
        live = slack > 0
        hess = np.eye(len(w)) + 2 * c * z[live].T @ z[live]
        step = np.linalg.solve(hess, grad)
        size, now = 1.0, 0.5 * w @ w + c * (slack**2).sum()
        while size > 1e-10 and 0.5 * (v := w - size * step) @ v + c * (np.maximum(0, 1 - y * (z @ v)) ** 2).sum() > now:
            size /= 2
        w = w - size * step
    return w


def one_vs_rest(x: np.ndarray, label: np.ndarray, classes: int, c: float = 1.0) -> np.ndarray:
    return np.stack([squared_hinge(x, np.where(label == k, 1.0, -1.0), c) for k in range(classes)])


def svm_scores(train: DataFrame, test: DataFrame, classes: int, c: float = 1.0, by: str = "fold") -> DataFrame:
    """by, unit, label, score of linear one-vs-rest SVMs, a model for each value of `by`: its training rows (unit, label, x array) must
    fit in a task, which works of a closed panel do."""

    def run(a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame(columns=[by, "unit", "label", "score"])
        w = one_vs_rest(np.stack(a["x"]), a["label"].to_numpy(), classes, c)
        x = np.stack(b["x"])
        s = x @ w[:, :-1].T + w[:, -1]
        return pd.DataFrame({by: np.repeat(b[by].to_numpy(), classes), "unit": np.repeat(b["unit"].to_numpy(), classes), "label": np.tile(np.arange(classes), len(b)), "score": s.ravel()})

    kind = dict(train.dtypes)
    return train.groupBy(by).cogroup(test.groupBy(by)).applyInPandas(run, f"{by} {kind[by]}, unit {kind['unit']}, label int, score double")


def nll(rows: DataFrame, group: str | None = None) -> DataFrame:
    """nll: mean of -ln p of the true label (p at least 1e-12), of works first if a group is given. rows: p of the true label."""
    loss = -F.log(F.greatest(F.col("p"), F.lit(1e-12)))
    if group:
        return rows.groupBy(group).agg(F.avg(loss).alias("l")).agg(F.avg("l").alias("nll"))
    return rows.agg(F.avg(loss).alias("nll"))


def temperature(scores: DataFrame, unit: str = "unit", low: float = -4.0, high: float = 4.0, steps: int = 4, grid: int = 17) -> float:
    """The temperature with the smallest NLL: a grid of ln T, refined around its best point; each round is one query over the scores.
    scores: unit, label, score, true_label."""
    for _ in range(steps):
        points = [low + (high - low) * i / (grid - 1) for i in range(grid)]
        ts = scores.sparkSession.createDataFrame([(p,) for p in points], "lt double")
        scaled = scores.crossJoin(F.broadcast(ts)).withColumn("z", F.col("score") / F.exp("lt"))
        top = scaled.groupBy("lt", unit).agg(F.max("z").alias("m"))
        per = scaled.join(top, ["lt", unit]).groupBy("lt", unit, "m").agg(F.sum(F.exp(F.col("z") - F.col("m"))).alias("s"), F.max(F.when(F.col("label") == F.col("true_label"), F.col("z"))).alias("t"))
        best = per.groupBy("lt").agg(F.avg(F.col("m") + F.log("s") - F.col("t")).alias("nll")).orderBy("nll", "lt").first().lt
        width = (high - low) / (grid - 1)
        low, high = best - width, best + width
    return math.exp(best)


def isotonic(scores: DataFrame, classes: int, unit: str = "unit") -> DataFrame:
    """unit, label, p: one isotonic fit a class, clipped and summing to one. scores: unit, label, score, true_label."""
    out = None
    for k in range(classes):
        own = scores.where(F.col("label") == k).select(unit, "label", "score", (F.col("true_label") == k).cast("double").alias("hit"))
        model = IsotonicRegression(featuresCol="score", labelCol="hit").fit(own)
        part = model.transform(own).select(unit, "label", F.greatest(F.least("prediction", F.lit(1.0)), F.lit(1e-12)).alias("raw"))
        out = part if out is None else out.unionByName(part)
    return out.select(unit, "label", (F.col("raw") / F.sum("raw").over(Window.partitionBy(unit))).alias("p"))


def platt(rows: DataFrame, c: float = 1.0):
    """Logistic regression on score vectors (label, features, weight)."""
    return logistic(rows, c)


def choose_calibrator(losses: DataFrame, least_works: int, works_per_class: int) -> str:
    """The method with the smallest held-out loss (ties by name); none with too few works. losses: method, nll."""
    return "identity" if works_per_class < least_works else losses.orderBy("nll", "method").first().method


def softmax_scores(scores: DataFrame, unit: list[str]) -> DataFrame:
    w = Window.partitionBy(*unit)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def mean_channels(channels: DataFrame, unit: str = "unit") -> DataFrame:
    """unit, label, p: the mean over channels (channel, unit, label, p)."""
    return channels.groupBy(unit, "label").agg(F.avg("p").alias("p"))


def reliable_channels(channels: DataFrame, accuracy: DataFrame, chance: float, power: float = 6.0, unit: str = "unit") -> DataFrame:
    """unit, label, p weighted by (accuracy - chance)^power of the channel; alike if none is better than chance."""
    raw = accuracy.withColumn("w", F.pow(F.greatest(F.col("accuracy") - chance, F.lit(0.0)), F.lit(power)))
    total = raw.agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("k"))
    w = raw.crossJoin(total).select("channel", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(1 / F.col("k")).alias("w"))
    return channels.join(F.broadcast(w), "channel").groupBy(unit, "label").agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def stacked(equal_top1: float, stacked_top1: float) -> str:
    """Stacking only where it is strictly better than the equal mean."""
    return "stacked" if stacked_top1 > equal_top1 else "equal"


def split_report(rows: DataFrame, splits: DataFrame, classes: int) -> DataFrame:
    """split, role, n, n_classes, complete: whether every class is in training and validation of every split. splits: split, work_id, role."""
    return splits.join(rows.select("work_id", "label").distinct(), "work_id").groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("n_classes")).withColumn("complete", F.col("n_classes") == classes)


def kmeans(rows: DataFrame, k: int = 2, seed: int = 42, restarts: int = 10) -> DataFrame:
    """rows (unit, features) with `cluster`: the cheapest of several starts."""
    fits = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(rows) for i in range(restarts)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(rows)


def silhouette(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """silhouette: Euclidean, exact over pairs of units (works of one author: a few hundred). rows: unit, x (array), cluster."""
    d = F.sqrt(F.aggregate(F.zip_with("a.x", "b.x", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    pairs = rows.alias("a").join(rows.alias("b"), F.col(f"a.{unit}") != F.col(f"b.{unit}")).select(F.col(f"a.{unit}").alias("u"), F.col("a.cluster").alias("ca"), F.col("b.cluster").alias("cb"), d.alias("d"))
    mean = pairs.groupBy("u", "ca", "cb").agg(F.avg("d").alias("m"))
    per = mean.groupBy("u", "ca").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("m"))).alias("a"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.avg(s).alias("silhouette"))


def residual_projection(rows: DataFrame, share: float = 0.9, most: int = 16) -> np.ndarray:
    """Directions in which editions of one work differ: (domain mean - work mean) / sqrt(domains) of works with several domains, their
    leading singular vectors up to a share of variance. rows: work_id, domain, x. The D x D scatter is summed on executors."""
    mean = lambda df, *by: df.groupBy(*by).agg(F.array(*(F.avg(F.element_at("x", i + 1)) for i in range(size))).alias("x"))
    size = len(rows.select("x").first().x)
    domains = mean(rows, "work_id", "domain")
    works = domains.groupBy("work_id").agg(F.count(F.lit(1)).alias("k"), F.array(*(F.avg(F.element_at("x", i + 1)) for i in range(size))).alias("c")).where("k > 1")
    diff = domains.join(works, "work_id").select(F.transform(F.zip_with("x", "c", lambda a, b: a - b), lambda v: v / F.sqrt("k")).alias("d"))
    scatter = diff.select(F.posexplode("d").alias("i", "v"), "d").select("i", "v", F.posexplode("d").alias("j", "u")).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("s"))
    m = np.zeros((size, size))
    for r in scatter.collect():  # D x D numbers
        m[r.i, r.j] = r.s
    power, vecs = np.linalg.eigh(m)
    power, vecs = np.maximum(power[::-1], 0), vecs[:, ::-1]
    if power.sum() <= 0:
        return np.zeros((size, 0))
    rank = int(np.searchsorted(np.cumsum(power) / power.sum(), share) + 1)
    return vecs[:, : min(rank, most)]


def residualised(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """rows with x less its part along the directions."""
    sent = rows.sparkSession.sparkContext.broadcast(directions)

    @F.pandas_udf("array<double>")
    def project(x):
        import pandas as pd

        m = np.stack(x) if len(x) else np.zeros((0, sent.value.shape[0]))
        return pd.Series(list(m - m @ sent.value @ sent.value.T))

    return rows.withColumn("x", project("x"))
