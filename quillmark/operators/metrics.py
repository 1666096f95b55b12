"""Ranking, classification metrics, tests and contracts over prediction relations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def soft_vote(scores: DataFrame, labels: DataFrame, unit: str = "work_id", n_chunks: str = "chunk") -> DataFrame:
    """unit, label, p: the mean over the unit's chunks, zero where a class has no score. scores: unit, chunk, label, p."""
    size = scores.groupBy(unit).agg(F.count_distinct(n_chunks).alias("_n"))
    sums = scores.groupBy(unit, "label").agg(F.sum("p").alias("_s"))
    return size.crossJoin(labels.select("label")).join(sums, [unit, "label"], "left").select(unit, "label", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("p"))


def stable_top(scores: DataFrame, k: int = 1, unit: str = "work_id") -> DataFrame:
    """The k best labels by (p descending, label), with their place."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc("p"), "label"))).where(F.col("place") <= k)


def worst_tie_rank(scores: DataFrame, unit: str = "work_id", true_label: str = "true_label") -> DataFrame:
    """unit, true_label, pred_label, rank: labels that score as high as the true one count against it."""
    own = F.max(F.when(F.col("label") == F.col(true_label), F.col("p"))).over(Window.partitionBy(unit))
    marked = scores.withColumn("_own", own)
    return marked.groupBy(unit, true_label).agg(F.min(F.struct((-F.col("p")).alias("p"), F.col("label"))).getField("label").alias("pred_label"), F.sum((F.col("p") >= F.col("_own")).cast("long")).alias("rank"))


def top_candidates(scores: DataFrame, k: int, unit: str = "work_id") -> DataFrame:
    """unit, candidates: an array of (label, p), best first. Panels are small."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "label"))), lambda s: F.struct(s["label"].alias("label"), (-s["n"]).alias("p")))
    return scores.groupBy(unit).agg(F.slice(ordered, 1, k).alias("candidates"))


def margin(scores: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, margin: best less second, zero for a single label."""
    two = stable_top(scores, 2, unit)
    return two.groupBy(unit).agg((F.max(F.when(F.col("place") == 1, F.col("p"))) - F.max(F.when(F.col("place") == 2, F.col("p")))).alias("m")).select(unit, F.coalesce("m", F.lit(0.0)).alias("margin"))


def majority_vote(predictions: DataFrame, unit: str = "work_id", label: str = "label", order: str = "ordinal") -> DataFrame:
    """unit, label: the most frequent, the one seen first on a tie."""
    per = predictions.groupBy(unit, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return per.groupBy(unit).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", label)).alias("b")).select(unit, F.col(f"b.{label}").alias(label))


def accuracy(rows: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.col(true).eqNullSafe(F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"))


def per_label(rows: DataFrame, labels: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """label, tp, n_true, n_pred, precision, recall, f1 over a frozen label list; a ratio without denominator is zero, the recall of
    an untested label null. A null prediction misses and belongs to no class."""
    t = rows.groupBy(F.col(true).alias("label")).agg(F.count(F.lit(1)).alias("n_true"), F.sum(F.col(true).eqNullSafe(F.col(pred)).cast("long")).alias("tp"))
    p = rows.where(F.col(pred).isNotNull()).groupBy(F.col(pred).alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = labels.select("label").join(t, "label", "left").join(p, "label", "left").select("label", zero("tp").alias("tp"), zero("n_true").alias("n_true"), zero("n_pred").alias("n_pred"))
    return out.select("*", F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0)).alias("precision"), F.try_divide("tp", "n_true").alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(0.0)).alias("f1"))


def macro_f1(rows: DataFrame, labels: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return per_label(rows, labels, true, pred).agg(F.avg("f1").alias("macro_f1"))


def top_k_accuracy(rows: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    return rows.agg(F.coalesce(F.avg((F.col(rank) <= k).cast("double")), F.lit(0.0)).alias("top_k"))


def confusion(rows: DataFrame, labels: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """true_label, pred_label, n for all pairs of the label list, zeros included."""
    n = rows.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    grid = labels.select(F.col("label").alias("true_label")).crossJoin(F.broadcast(labels.select(F.col("label").alias("pred_label"))))
    return grid.join(n, ["true_label", "pred_label"], "left").na.fill(0, ["n"])


def calibration_error(rows: DataFrame, bins: int = 10, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """ece over bins (low, high]; a confidence of exactly zero is in no bin but counts as a row."""
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    per = rows.where(F.col(conf) > 0).groupBy(F.ceil(F.col(conf) * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(conf).alias("c"))
    return per.crossJoin(total).agg(F.coalesce(F.sum(F.col("n") / F.col("_all") * F.abs(F.col("acc") - F.col("c"))), F.lit(0.0)).alias("ece"))


def abstaining(rows: DataFrame, labels: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """accuracy, coverage, macro_f1 where null is an abstention: a miss, but no class."""
    one = rows.agg(F.avg(F.col(true).eqNullSafe(F.col(pred)).cast("double")).alias("accuracy"), F.avg(F.col(pred).isNotNull().cast("double")).alias("coverage"))
    return one.crossJoin(macro_f1(rows, labels, true, pred))


def recalls(rows: DataFrame, author: str = "author", work: str = "work_id", correct: str = "correct") -> DataFrame:
    """author, work_recall (works whose chunks are mostly right), chunk_recall, and both as `right/all`."""
    per = rows.groupBy(author, work).agg(F.sum(F.col(correct).cast("long")).alias("c"), F.count(F.lit(1)).alias("t"))
    right = F.sum((2 * F.col("c") > F.col("t")).cast("long"))
    return per.groupBy(author).agg((right / F.count(F.lit(1))).alias("work_recall"), (F.sum("c") / F.sum("t")).alias("chunk_recall"), F.format_string("%d/%d", right, F.count(F.lit(1))).alias("works"), F.format_string("%d/%d", F.sum("c"), F.sum("t")).alias("chunks"))


def kappa(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa of two labellings; null if chance agreement is whole."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("same"))
    pa = rows.groupBy(F.col(a).alias("label")).agg(F.count(F.lit(1)).alias("na"))
    pb = rows.groupBy(F.col(b).alias("label")).agg(F.count(F.lit(1)).alias("nb"))
    chance = pa.join(pb, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("cross"))
    pe = F.col("cross") / (F.col("n") * F.col("n"))
    return n.crossJoin(chance).select(F.try_divide(F.col("same") / F.col("n") - pe, 1 - pe).alias("kappa"))


def auc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the ROC curve, ties by half. Counts by distinct score come first; a running sum over them in ranges of the score,
    with the sums of lower ranges added, so no one task sees all of it."""
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    part = F.floor(F.col("s") * 64)
    per = per.withColumn("part", part)
    inner = F.coalesce(F.sum("q").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = per.groupBy("part").agg(F.sum("q").alias("pq"))
    lower = parts.withColumn("lower", F.coalesce(F.sum("pq").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("pq")
    return per.withColumn("inner", inner).join(lower, "part").agg((F.sum(F.col("p") * (F.col("inner") + F.col("lower") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def paired(a: DataFrame, b: DataFrame, key: str = "work_id", correct: str = "correct") -> DataFrame:
    """One row: both, gained (only b), lost (only a), neither."""
    j = a.select(key, F.col(correct).alias("a")).join(b.select(key, F.col(correct).alias("b")), key)
    n = lambda c: F.sum(c.cast("long"))
    return j.agg(n(F.col("a") & F.col("b")).alias("both"), n(~F.col("a") & F.col("b")).alias("gained"), n(F.col("a") & ~F.col("b")).alias("lost"), n(~F.col("a") & ~F.col("b")).alias("neither"))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of the discordant counts, by logs of binomial terms; one without discordants."""
    n = (b + c).cast("double")
    # ln C(n, i) built up from i - 1; the fold carries (ln term, sum)
    start = F.struct((-n * F.lit(0.6931471805599453)).alias("t"), F.exp(-n * F.lit(0.6931471805599453)).alias("s"))
    k = F.least(b, c).cast("int")
    steps = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, lambda acc, i: F.struct((acc["t"] + F.log(n - i + 1) - F.log(i.cast("double"))).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log(n - i + 1) - F.log(i.cast("double")))).alias("s")))
    return F.when(b + c == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail["s"]))


def holm(rows: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Step-down adjusted p of a closed family of tests."""
    w = Window.orderBy(p, key)
    m = rows.agg(F.count(F.lit(1)).alias("_m"))
    raw = rows.crossJoin(m).withColumn("_r", F.row_number().over(w)).withColumn("_q", (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return raw.withColumn("holm", F.least(F.lit(1.0), F.max("_q").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_m", "_r", "_q")


def slices(rows: DataFrame, factor: str, correct: str = "correct") -> DataFrame:
    """level (null for all), n, accuracy: overall and by level of the factor; a missing level is a level."""
    r = rows.select(F.coalesce(F.col(factor).cast("string"), F.lit("<missing>")).alias("level"), F.col(correct).cast("double").alias("c"))
    return r.rollup("level").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("accuracy"))


def fisher_p(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and exact two-sided p of a table of four counts. Weights are told by their logs against the table's own, summed from
    exact ratios of neighbours, so counts of any size do; from the likeliest table outwards, as far as a weight is above zero."""
    from math import inf, log

    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, col - (n - row)), min(row, col)
    top = min(high, max(low, (row + 1) * (col + 1) // (n + 2)))
    logs = [np.zeros(1)]  # of the likeliest table
    for step, end in ((1, high), (-1, low)):
        x, last = top, 0.0
        while x != end and last > -745:  # exp of less is zero
            far = min(x + 100_000, end) if step > 0 else max(x - 100_000, end)
            at = np.arange(x, far, step, dtype=float)
            up = (row - at) * (col - at) / ((at + 1) * (n - row - col + at + 1)) if step > 0 else at * (n - row - col + at) / ((row - at + 1) * (col - at + 1))
            logs.append(last + np.cumsum(np.log(up)))
            x, last = far, float(logs[-1][-1])
    # the own weight, by the same ratios
    own, x = 0.0, top
    while x < a:
        own, x = own + log((row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1))), x + 1
    while x > a:
        own, x = own + log(x * (n - row - col + x) / ((row - x + 1) * (col - x + 1))), x - 1
    w = np.concatenate(logs)
    e = np.exp(w)
    return (a * d / (b * c) if b * c else inf), float(e[w <= own + 1e-7].sum() / e.sum())


def violations(rows: DataFrame, unit: str = "work_id", tolerance: float = 1e-6) -> DataFrame:
    """unit, problem: probabilities that are null, not finite, outside [0, 1], or do not sum to one."""
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    per = rows.groupBy(unit).agg(F.max(bad.cast("int")).alias("bad"), F.sum("p").alias("s"))
    problem = F.when(F.col("bad") == 1, "value").when(F.abs(F.col("s") - 1) > tolerance, "sum")
    return per.select(unit, problem.alias("problem")).where("problem is not null")


def inconsistent(rows: DataFrame, recomputed: DataFrame, unit: str = "work_id") -> DataFrame:
    """Units whose stated prediction, correctness or rank differs from what the scores say."""
    j = rows.alias("a").join(recomputed.alias("b"), unit)
    same = F.col("a.pred_label").eqNullSafe(F.col("b.pred_label")) & F.col("a.rank").eqNullSafe(F.col("b.rank")) & F.col("a.correct").eqNullSafe(F.col("b.pred_label") == F.col("a.true_label"))
    return j.where(~same).select(unit)
