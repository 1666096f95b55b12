"""Named analyses, composed of the operators: typicality and outsiders, self-attribution, factors that give an author away,
recall across a factor's levels, paired comparison of two models with whole authors drawn anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import attribution as A
from quillmark.operators import delta as D
from quillmark.operators import metrics as M
from quillmark.operators import resampling as RS
from quillmark.operators import vocabulary as V

#: How typical a unit is of a closed panel, by its probabilities: large for members.
TYPICALITY = ("max_prob", "top2_mass", "margin", "neg_entropy")


def typicality(scores: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit and TYPICALITY; scores: unit, label, p. A label without mass adds no entropy; a single label has its mass as margin."""
    down = F.reverse(F.array_sort(F.collect_list("p")))
    entropy = F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p"))), F.lit(0.0))
    second = F.coalesce(F.get("_p", F.lit(1)), F.lit(0.0))
    one = scores.groupBy(unit).agg(down.alias("_p"), entropy.alias("neg_entropy")).withColumn("max_prob", F.get("_p", F.lit(0)))
    return one.select(unit, "max_prob", (F.col("max_prob") + second).alias("top2_mass"), (F.col("max_prob") - second).alias("margin"), "neg_entropy")


def posterior_entropy(scores: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, bits: a description of the scores and no evidence of a second hand."""
    return typicality(scores, unit).select(unit, (-F.col("neg_entropy") / F.log(F.lit(2.0))).alias("bits"))


def outsider_auc(typical: DataFrame, places: int = 9) -> DataFrame:
    """measure, auc, median_member, median_outsider: how well each measure tells members of the panel from outsiders. typical:
    TYPICALITY and `member`. Scores equal to `places` digits are ties."""
    parts = []
    for name in TYPICALITY:
        rows = typical.select(F.round(name, places).alias("score"), F.col("member").alias("positive"))
        middle = rows.agg(F.percentile(F.when(F.col("positive"), F.col("score")), F.lit(0.5)).alias("median_member"), F.percentile(F.when(~F.col("positive"), F.col("score")), F.lit(0.5)).alias("median_outsider"))
        parts.append(M.auc(rows).crossJoin(middle).select(F.lit(name).alias("measure"), "auc", "median_member", "median_outsider"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def self_rate(predictions: DataFrame) -> DataFrame:
    """author, right, works, rate: how many held-out works go to their own author. predictions: work_id, author, candidate."""
    right = F.sum((F.col("author") == F.col("candidate")).cast("long"))
    return predictions.groupBy("author").agg(right.alias("right"), F.count(F.lit(1)).alias("works"), (right / F.count(F.lit(1))).alias("rate"))


def identifiability(rows: DataFrame, factors: list[str], author: str = "author") -> DataFrame:
    """factor, complete, author_determined_by_factor, factor_determined_by_author, perfect_confound. A factor with a missing or empty
    value is incomplete and determines nothing; neither does one of an empty table."""
    parts = []
    for factor in factors:
        own = rows.select(F.col(author).alias("a"), F.nullif(F.col(factor).cast("string"), F.lit("")).alias("v"))
        cells = own.groupBy("a", "v").agg(F.count(F.lit(1)).alias("n"))  # authors x levels
        whole = cells.agg(F.coalesce(F.sum(F.col("v").isNull().cast("long")) == 0, F.lit(False)).alias("complete"))
        single = [cells.groupBy(by).agg(F.count_distinct(other).alias("k")).agg(F.coalesce(F.max("k") == 1, F.lit(False)).alias(name)) for by, other, name in (("v", "a", "_fa"), ("a", "v", "_af"))]
        fa, af = F.col("complete") & F.col("_fa"), F.col("complete") & F.col("_af")
        parts.append(whole.crossJoin(single[0]).crossJoin(single[1]).select(F.lit(factor).alias("factor"), "complete", fa.alias("author_determined_by_factor"), af.alias("factor_determined_by_author"), (fa & af).alias("perfect_confound")))
    return reduce(DataFrame.unionByName, parts)


def cross_level_scores(values: DataFrame, works: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, author, level, candidate, score: the cosine of each unit with the candidate's works of all other levels. values: unit,
    term, value; works: unit, author, level, one row each. Sums over an author less those of the unit's level, so nothing is copied for a
    level; a candidate without works of
    another level, or without a term of the unit in any work, has no row."""
    rows = A.unit_length(values, unit).join(works, unit)
    part = rows.groupBy(F.col("author").alias("candidate"), "level", "term").agg(F.sum("value").alias("s"))
    total = part.groupBy("candidate", "term").agg(F.sum("s").alias("t"))
    n_part = works.groupBy(F.col("author").alias("candidate"), "level").agg(F.count(F.lit(1)).alias("n"))
    n_total = n_part.groupBy("candidate").agg(F.sum("n").alias("all_n"))
    whole = total.groupBy("candidate").agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    shared = part.join(total, ["candidate", "term"]).groupBy("candidate", "level").agg(F.sum(F.col("s") * F.col("t")).alias("st"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    dots = rows.join(total, "term").groupBy(unit, "author", "level", "candidate").agg(F.sum(F.col("value") * F.col("t")).alias("d"))
    own = rows.join(part, ["level", "term"]).groupBy(unit, "candidate").agg(F.sum(F.col("value") * F.col("s")).alias("o"))
    j = dots.join(own, [unit, "candidate"], "left").join(whole, "candidate").join(n_total, "candidate").join(n_part, ["candidate", "level"], "left").join(shared, ["candidate", "level"], "left").na.fill(0, ["n"]).na.fill(0.0, ["o", "st", "ss"])
    length = F.sqrt(F.greatest(F.col("tt") - 2 * F.col("st") + F.col("ss"), F.lit(1e-18)))
    return j.where(F.col("all_n") > F.col("n")).select(unit, "author", "level", "candidate", ((F.col("d") - F.col("o")) / length).alias("score"))


def cross_level_shares(rows: DataFrame, most: int) -> tuple[list[str], DataFrame]:
    """Candidates, and work_id, author, level, scores (in their order; null where `cross_level_scores` has no row) over shares of the `most`
    frequent words. rows: author, work_id, level, text; a work has one of each. A work is one narrow row, its scores are made where it
    is; the driver holds sums of authors x levels x vocabulary."""
    import numpy as np
    import pyarrow as pa

    vocabulary = D.vocabulary_of(rows, most, "pooled")
    units = V.hoisted(D.counted(rows, vocabulary, ("level",)))
    cells = [(r.author, r.level) for r in units.select("author", "level").distinct().orderBy("author", "level").collect()]
    at, authors, levels = {c: k for k, c in enumerate(cells)}, sorted({a for a, _ in cells}), sorted({x for _, x in cells})
    kind = dict(units.dtypes)["work_id"]

    def vectors(batches):
        for b in batches:
            for k in range(0, b.num_rows, D.PIECE):
                part = b.slice(k, D.PIECE)
                own = np.array([at[c] for c in zip(part.column("author").to_pylist(), part.column("level").to_pylist(), strict=True)], int)
                yield part, own, D.unit_rows(D.dense(part.column("cells"), part.column("events"), len(vocabulary)))

    sums = D.summed(units, vectors, cells, len(vocabulary))
    total, rest = np.zeros((len(authors), len(vocabulary))), np.zeros((len(levels), len(authors), len(vocabulary)))
    for (a, own), s in zip(cells, sums, strict=True):
        total[authors.index(a)] += s
        rest[[k for k, x in enumerate(levels) if x != own], authors.index(a)] += s  # without the own level's works, so none is zero exactly
    some, there, rest = (total != 0).astype(float).T, rest.any(axis=2), np.stack([D.unit_rows(x) for x in rest]) if levels else rest
    place = {x: k for k, x in enumerate(levels)}

    def run(batches):
        for part, _, x in vectors(batches):
            level = np.array([place[v] for v in part.column("level").to_pylist()], int)
            score, ok = np.zeros((len(x), len(authors))), ((x != 0).astype(float) @ some > 0) & there[level]
            for k in np.unique(level):
                score[level == k] = x[level == k] @ rest[k].T
            flat = pa.array(score.ravel(), mask=~ok.ravel())
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(authors), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column("work_id"), part.column("author"), part.column("level"), scores], ["work_id", "author", "level", "scores"])

    return authors, units.mapInArrow(run, f"work_id {kind}, author string, level string, scores array<double>")


def long_scores(candidates: list[str], scores: DataFrame) -> DataFrame:
    """work_id, author, level, candidate, score of a work's scores in the order of the candidates."""
    names = F.array(*map(F.lit, candidates)).cast("array<string>")
    return scores.select("work_id", "author", "level", F.posexplode("scores").alias("_p", "score")).where("score is not null").select("work_id", "author", "level", F.get(names, F.col("_p")).alias("candidate"), "score")


def best_of_scores(candidates: list[str], scores: DataFrame, places: int) -> DataFrame:
    """author, level, works, right as `cross_level_recall` of scores rounded to `places` digits, without a row for each score."""
    rounded = F.transform("scores", lambda v: F.round(v, places))
    names = F.array(*map(F.lit, candidates)).cast("array<string>")
    best = scores.select("author", "level", rounded.alias("s")).where(F.array_max("s").isNotNull()).select("author", "level", F.get(names, (F.array_position("s", F.array_max("s")) - 1).cast("int")).alias("candidate"))
    return best.groupBy("author", "level").agg(F.count(F.lit(1)).alias("works"), F.sum((F.col("candidate") == F.col("author")).cast("long")).alias("right"))


def cross_level_recall(scores: DataFrame, unit: str = "work_id") -> DataFrame:
    """author, level, works, right: units of a level whose best candidate by works of the other levels is their author."""
    own = scores.select(unit, "author", "level").distinct()
    right = F.sum((F.col("candidate") == F.col("author")).cast("long"))
    return A.best(scores, unit).join(own, unit).groupBy("author", "level").agg(F.count(F.lit(1)).alias("works"), right.alias("right"))


def clustered_comparison(a: DataFrame, b: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: works, accuracy_a, accuracy_b, only_a, only_b, mcnemar_p, and over draws of whole authors the difference's median, lo,
    hi, significant and share of draws at or below zero. a, b: work_id, author, correct, for the same works."""
    j = a.select("work_id", "author", F.col("correct").cast("long").alias("x")).join(b.select("work_id", F.col("correct").cast("long").alias("y")), "work_id")
    sums = j.groupBy(F.col("author").alias("unit")).agg(F.sum(F.col("x") - F.col("y")).alias("num"), F.count(F.lit(1)).alias("den"))
    table = RS.draw_table(a.sparkSession, RS.units_of(sums), draws, seed, by_choice=True)
    per = sums.join(table, "unit").groupBy("draw").agg((F.sum(F.col("num") * F.col("times")) / F.sum(F.col("den") * F.col("times"))).alias("v"))
    ends = per.agg(F.percentile("v", F.array(*map(F.lit, (0.5, 0.025, 0.975)))).alias("q"), F.avg((F.col("v") <= 0).cast("double")).alias("share_at_most_zero"))
    flat = j.agg(F.count(F.lit(1)).alias("works"), F.avg("x").alias("accuracy_a"), F.avg("y").alias("accuracy_b"), F.coalesce(F.sum(F.col("x") * (1 - F.col("y"))), F.lit(0)).alias("only_a"), F.coalesce(F.sum((1 - F.col("x")) * F.col("y")), F.lit(0)).alias("only_b"))
    lo, hi = F.col("q")[1], F.col("q")[2]
    return flat.crossJoin(ends).select("works", "accuracy_a", "accuracy_b", "only_a", "only_b", M.mcnemar_p(F.col("only_a"), F.col("only_b")).alias("mcnemar_p"), F.col("q")[0].alias("median"), lo.alias("lo"), hi.alias("hi"), (~((lo <= 0) & (hi >= 0))).alias("significant"), "share_at_most_zero")
