"""Timelines, runs and spans: rolling means, foreign runs, segmentation scores.

A timeline is (unit, ordinal, label, p); spans are (doc_id, start, end, label), end exclusive. Windows go by unit or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def restrict(scores: DataFrame, candidates: list[str], keys: list[str]) -> DataFrame:
    """Candidates alone, summing to one in each row; rows of zeros stay zeros."""
    total = F.sum("p").over(Window.partitionBy(*keys))
    return scores.where(F.col("label").isin(candidates)).withColumn("p", F.when(total == 0, F.lit(0.0)).otherwise(F.col("p") / total))


def rolling_mean(rows: DataFrame, window: int, value: str = "p", by: list[str] | None = None, order: str = "ordinal") -> DataFrame:
    """Centred mean of an odd number of values; beyond the ends the first and last value stand. The window is no longer than the series
    (`size` is its length) and an even one is one shorter."""
    by = by or ["unit"]
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(order)
    n = F.count(F.lit(1)).over(whole)
    at = F.row_number().over(ordered) - 1
    rows = rows.withColumn("_n", n).withColumn("_i", at).withColumn("_first", F.first(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_last", F.last(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out, done = None, F.lit(None).cast("double")
    for k in range(window if window % 2 else window - 1, 0, -2):
        # short series shrink the window: one expression for each odd length that can occur
        h = k // 2
        inside = F.sum(value).over(ordered.rowsBetween(-h, h))
        left = F.greatest(h - F.col("_i"), F.lit(0))
        right = F.greatest(F.col("_i") + h - (F.col("_n") - 1), F.lit(0))
        mean = (inside + left * F.col("_first") + right * F.col("_last")) / k
        fits = F.col("_n") >= k
        done = F.coalesce(done, F.when(fits, mean))
        out = done
    return rows.withColumn("smooth", F.coalesce(out, F.col(value)) if out is not None else F.col(value)).drop("_n", "_i", "_first", "_last")


def runs(rows: DataFrame, by: str = "unit", order: str = "ordinal", label: str = "label") -> DataFrame:
    """by, label, start, end (inclusive), length, mean_p of stretches of equal labels."""
    w = Window.partitionBy(by).orderBy(order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("_run", F.sum(change.cast("int")).over(w))
    return marked.groupBy(by, "_run").agg(F.first(label).alias("label"), F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"), F.avg("p").alias("mean_p")).drop("_run")


def foreign_runs(rows: DataFrame, host: str | Column, conf: float = 0.6, least: int = 3, by: str = "unit") -> DataFrame:
    """Runs of one label other than the host's, long and sure enough. rows: the best label of each chunk with its p."""
    host = F.lit(host) if isinstance(host, str) else host
    return runs(rows, by).where((F.col("label") != host) & (F.col("length") >= least) & (F.col("mean_p") >= conf))


def foreign_fraction(rows: DataFrame, host: str | Column, by: str = "unit") -> DataFrame:
    host = F.lit(host) if isinstance(host, str) else host
    return rows.groupBy(by).agg(F.avg((F.col("label") != host).cast("double")).alias("fraction"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows with the same label in both timelines."""
    return a.select(*keys, F.col("label").alias("a")).join(b.select(*keys, F.col("label").alias("b")), keys).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def splice(a: DataFrame, b: DataFrame) -> DataFrame:
    """Timeline of a, then b."""
    offset = a.agg((F.max("ordinal") + 1).alias("_o"))
    return a.unionByName(b.crossJoin(offset).withColumn("ordinal", F.col("ordinal") + F.col("_o")).drop("_o"))


def null_summary(fractions: DataFrame) -> DataFrame:
    """n, mean, std (divisor n - 1, zero below two) of the control works' fractions."""
    return fractions.agg(F.count(F.lit(1)).alias("n"), F.avg("fraction").alias("mean"), F.coalesce(F.stddev_samp("fraction"), F.lit(0.0)).alias("std"))


def empirical_p(fractions: DataFrame, observed: float) -> DataFrame:
    return fractions.agg(((1 + F.sum((F.col("fraction") >= observed).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"))


def verdict(fraction: Column, mean: Column, std: Column, p: Column, n_runs: Column) -> Column:
    """signal, weak, background, or, where the controls do not vary, degenerate with or without an empirical signal."""
    z = (fraction - mean) / std
    return F.when(std > 1e-9, F.when((z >= 3) & (n_runs > 0), "signal").when(z >= 2, "weak").otherwise("background")).otherwise(F.when((p <= 0.1) & (n_runs > 0), "degenerate_signal").otherwise("degenerate"))


def canonical(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Neighbouring spans of one label as one."""
    w = Window.partitionBy(doc).orderBy("start")
    new = ~(F.lag("label").over(w).eqNullSafe(F.col("label")) & F.lag("end").over(w).eqNullSafe(F.col("start")))
    return spans.withColumn("_k", F.sum(new.cast("int")).over(w)).groupBy(doc, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")).drop("_k")


def span_problems(spans: DataFrame, contiguous: bool = False, doc: str = "doc_id") -> DataFrame:
    """doc, start, problem: empty or negative spans, overlaps, gaps if they are not allowed."""
    w = Window.partitionBy(doc).orderBy("start", "end")
    before = F.lag("end").over(w)
    problem = F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "empty").when(before > F.col("start"), "overlap")
    if contiguous:
        problem = problem.when(before < F.col("start"), "gap")
    return spans.select(doc, "start", problem.alias("problem")).where("problem is not null")


def overlaps(truth: DataFrame, pred: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, true_label, pred_label, n: positions by both labels. Spans of one document meet; each overlaps its neighbours only, so the
    range condition is on rows of one document."""
    j = truth.alias("t").join(pred.alias("p"), (F.col(f"t.{doc}") == F.col(f"p.{doc}")) & (F.col("t.start") < F.col("p.end")) & (F.col("p.start") < F.col("t.end")))
    n = F.least("t.end", "p.end") - F.greatest("t.start", "p.start")
    return j.groupBy(F.col(f"t.{doc}").alias(doc), F.col("t.label").alias("true_label"), F.col("p.label").alias("pred_label")).agg(F.sum(n).alias("n"))


def position_accuracy(truth: DataFrame, pred: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, accuracy, macro_f1 by position, over labels that either side has."""
    o = overlaps(truth, pred, doc)
    t = truth.groupBy(doc, "label").agg(F.sum(F.col("end") - F.col("start")).alias("nt"))
    p = pred.groupBy(doc, "label").agg(F.sum(F.col("end") - F.col("start")).alias("np"))
    same = o.where("true_label = pred_label").select(doc, F.col("true_label").alias("label"), F.col("n").alias("tp"))
    per = t.join(p, [doc, "label"], "full_outer").join(same, [doc, "label"], "left").na.fill(0, ["nt", "np", "tp"])
    return per.groupBy(doc).agg((F.sum("tp") / F.sum("nt")).alias("accuracy"), F.avg(F.try_divide(2 * F.col("tp"), F.col("nt") + F.col("np"))).alias("macro_f1"))


def prf(tp: Column, n_pred: Column, n_true: Column) -> tuple[Column, Column, Column]:
    """Precision (one without predictions), recall (one without truth), and their mean."""
    precision = F.when(n_pred == 0, F.lit(1.0)).otherwise(tp / n_pred)
    recall = F.when(n_true == 0, F.lit(1.0)).otherwise(tp / n_true)
    return precision, recall, F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def boundaries(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, at, left, right: where one span ends and another starts."""
    w = Window.partitionBy(doc).orderBy("start")
    return spans.select(doc, F.col("start").alias("at"), F.lag("label").over(w).alias("left"), F.col("label").alias("right")).where("left is not null")


def boundary_scores(truth: DataFrame, pred: DataFrame, tolerance: int = 0, labelled: bool = False, doc: str = "doc_id") -> DataFrame:
    """doc, tp, n_pred, n_true, precision, recall, f1 of boundaries, matched one to one within the tolerance. Exact ones by an
    equi-join; else each document's sorted places are matched left to right, which is largest for intervals of one width."""
    t, p = boundaries(truth, doc), boundaries(pred, doc)
    kind = ["left", "right"] if labelled else []
    nt = t.groupBy(doc).agg(F.count(F.lit(1)).alias("n_true"))
    np_ = p.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pred"))
    docs = truth.select(doc).union(pred.select(doc)).distinct()
    if tolerance == 0:
        hits = t.join(p, [doc, "at", *kind]).groupBy(doc).agg(F.count(F.lit(1)).alias("tp"))
    else:
        sides = t.select(doc, *kind, F.lit(0).alias("side"), "at").unionByName(p.select(doc, *kind, F.lit(1).alias("side"), "at"))
        places = sides.groupBy(doc, *kind).agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("at")))).alias(n) for s, n in ((0, "a"), (1, "b"))))
        # the fold carries (next unused place of b, matches)
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("m"))

        def step(acc: Column, at: Column) -> Column:
            rest = F.filter(F.transform(F.col("b"), lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda s: (s["j"] >= acc["i"]) & (F.abs(s["x"] - at) <= tolerance))
            return F.when(F.size(rest) > 0, F.struct((F.element_at(rest, 1)["j"] + 1).alias("i"), (acc["m"] + 1).alias("m"))).otherwise(acc)

        hits = places.select(doc, F.aggregate("a", start, step)["m"].alias("m")).groupBy(doc).agg(F.sum("m").alias("tp"))
    one = docs.join(nt, doc, "left").join(np_, doc, "left").join(hits, doc, "left").na.fill(0, ["n_true", "n_pred", "tp"])
    precision, recall, f1 = prf(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return one.select(doc, "tp", "n_pred", "n_true", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def span_ious(truth: DataFrame, pred: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, t_start, p_start, iou of overlapping spans of one label."""
    j = truth.alias("t").join(pred.alias("p"), (F.col(f"t.{doc}") == F.col(f"p.{doc}")) & (F.col("t.label") == F.col("p.label")) & (F.col("t.start") < F.col("p.end")) & (F.col("p.start") < F.col("t.end")))
    inner = F.least("t.end", "p.end") - F.greatest("t.start", "p.start")
    return j.select(F.col(f"t.{doc}").alias(doc), F.col("t.start").alias("t_start"), F.col("p.start").alias("p_start"), (inner / (F.col("t.end") - F.col("t.start") + F.col("p.end") - F.col("p.start") - inner)).alias("iou"))


def segment_scores(truth: DataFrame, pred: DataFrame, threshold: float = 0.5, doc: str = "doc_id") -> DataFrame:
    """doc, tp, n_true, n_pred, precision, recall, f1, mean_iou, penalised_iou. Above a half spans of either side have one partner at
    most, so no matching is needed; below that the largest matching by Hungarian assignment."""
    pairs = span_ious(truth, pred, doc).where(F.col("iou") >= threshold)
    if threshold <= 0.5:
        def match(pdf):
            import numpy as np
            import pandas as pd

            a, ai = np.unique(pdf["t_start"], return_inverse=True)
            b, bi = np.unique(pdf["p_start"], return_inverse=True)
            score = np.zeros((len(a), len(b)))
            score[ai, bi] = 1000 + pdf["iou"]  # most pairs first, then the largest overlap
            chosen = [(i, j) for i, j in assignment(-score) if score[i, j] > 0]
            return pd.DataFrame({doc: [pdf[doc].iloc[0]] * len(chosen), "iou": [score[i, j] - 1000 for i, j in chosen]})

        pairs = pairs.groupBy(doc).applyInPandas(match, f"{doc} {dict(truth.dtypes)[doc]}, iou double")
    hit = pairs.groupBy(doc).agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("total"))
    nt = truth.groupBy(doc).agg(F.count(F.lit(1)).alias("n_true"))
    np_ = pred.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pred"))
    one = nt.join(np_, doc, "full_outer").join(hit, doc, "left").na.fill(0, ["n_true", "n_pred", "tp"]).na.fill(0.0, ["total"])
    precision, recall, f1 = prf(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return one.select(doc, "tp", "n_true", "n_pred", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.coalesce(F.try_divide("total", "tp"), F.lit(0.0)).alias("mean_iou"), (F.col("total") / F.greatest("n_true", "n_pred")).alias("penalised_iou"))


def assignment(cost) -> list[tuple[int, int]]:
    """Rows and columns of the cheapest one-to-one assignment (shortest augmenting paths with potentials)."""
    import numpy as np

    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    cost = cost.T if flip else cost
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def label_mapping(truth: DataFrame, pred: DataFrame, doc: str = "doc_id") -> DataFrame:
    """pred_label, true_label: anonymous clusters to true labels over the whole corpus, by largest overlap. The table of counts has
    labels x labels rows, which the driver assigns."""
    import numpy as np

    rows = overlaps(truth, pred, doc).groupBy("true_label", "pred_label").agg(F.sum("n").alias("n")).collect()
    a, b = sorted({r.true_label for r in rows}), sorted({r.pred_label for r in rows})
    counts = np.zeros((len(a), len(b)))
    for r in rows:
        counts[a.index(r.true_label), b.index(r.pred_label)] = r.n
    pairs = [(b[j], a[i]) for i, j in assignment(-counts) if counts[i, j] > 0]
    return truth.sparkSession.createDataFrame(pairs, "pred_label string, true_label string")


def apply_mapping(pred: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels without a partner keep a name of their own."""
    return pred.join(F.broadcast(mapping), pred.label == mapping.pred_label, "left").withColumn("label", F.coalesce("true_label", F.concat(F.lit("unmatched:"), F.col("label")))).drop("pred_label", "true_label")


def corpus_report(truth: DataFrame, pred: DataFrame, work: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: summed position accuracy, boundary counts and f1, and how often documents and works of a single author are split.
    work: doc, work_id."""
    o = overlaps(truth, pred, doc).agg(F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("right"))
    total = truth.agg(F.sum(F.col("end") - F.col("start")).alias("positions"))
    b = boundary_scores(truth, pred, 0, doc=doc).agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"))
    single = truth.groupBy(doc).agg(F.count_distinct("label").alias("k")).where("k = 1").select(doc)
    split = pred.join(single, doc, "left_semi").groupBy(doc).agg((F.count_distinct("label") > 1).alias("split")).join(work, doc)
    per = split.groupBy("work_id").agg(F.bool_or("split").alias("any"), F.sum(F.col("split").cast("long")).alias("n"), F.count(F.lit(1)).alias("docs"))
    fpr = per.agg(F.coalesce(F.sum("n") / F.sum("docs"), F.lit(0.0)).alias("document_fpr"), F.coalesce(F.avg(F.col("any").cast("double")), F.lit(0.0)).alias("work_fpr"))
    _, _, f1 = prf(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return o.crossJoin(total).crossJoin(b).crossJoin(fpr).select((F.col("right") / F.col("positions")).alias("accuracy"), "tp", "n_pred", "n_true", f1.alias("boundary_f1"), "document_fpr", "work_fpr")
