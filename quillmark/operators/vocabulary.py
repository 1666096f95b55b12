"""Term counts, vocabularies and weights as long relations (unit, term, value).

Nothing is ever densified: a unit's zero entries are implied. What needs zeros (means, distances) divides by the number of
units, or adds the closed form of all zeros. Ties of a vocabulary go to the smaller term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hoisted(rows: DataFrame) -> DataFrame:
    """A table that several parts of one plan read, kept (in memory, then on disk) instead of being made once for each; lost parts
    are made again. `spark.catalog.clearCache()` or `unpersist()` lets it go."""
    return rows.persist()


def counts(rows: DataFrame, terms: Column, unit: str | list[str] = "work_id") -> DataFrame:
    """unit, term, n. Partial sums are made where the rows are, so what is shuffled are distinct terms of a unit."""
    units = [unit] if isinstance(unit, str) else unit
    return rows.select(*units, F.explode(terms).alias("term")).groupBy(*units, "term").agg(F.count(F.lit(1)).alias("n"))


def events(rows: DataFrame, terms: Column, unit: str | list[str] = "work_id") -> DataFrame:
    """unit, events: all terms of a unit, before any pruning."""
    units = [unit] if isinstance(unit, str) else unit
    return rows.groupBy(*units).agg(F.sum(F.size(terms)).alias("events"))


def sizes_of(table: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, events out of a whole count table (before pruning), for units with any term: the text is not read again."""
    return table.groupBy(unit).agg(F.sum("n").alias("events"))


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """term, total, rank of the `most` terms with the largest total count; a top-k, taken in each partition before they meet."""
    top = table.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "term")))


def work_vocabulary(table: DataFrame, sizes: DataFrame, most: int | None = None, least_works: int = 2, unit: str = "work_id") -> DataFrame:
    """term, works, mean_share, idf: terms of at least `least_works` works, by the mean over all works of their share of the work's
    events (zeros included); idf = ln((W+1)/(works+1)) + 1. sizes: unit, events."""
    n_works = sizes.agg(F.count(F.lit(1)).alias("all_works"))
    per = table.join(sizes, unit).groupBy("term").agg(F.count(F.lit(1)).alias("works"), F.sum(F.col("n") / F.col("events")).alias("_share"))
    out = per.where(F.col("works") >= least_works).crossJoin(n_works).select("term", "works", (F.col("_share") / F.col("all_works")).alias("mean_share"), (F.log((F.col("all_works") + 1.0) / (F.col("works") + 1.0)) + 1.0).alias("idf"))
    return out.orderBy(F.desc("mean_share"), "term").limit(most) if most is not None else out


def pooled_vocabulary(table: DataFrame, least_units: int, most: int | None = None, unit: str = "work_id") -> DataFrame:
    """term, df, total, idf over units as they are: capped by total count."""
    n_units = table.agg(F.count_distinct(unit).alias("all_units"))
    per = table.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).where(F.col("df") >= least_units)
    if most is not None:
        per = per.orderBy(F.desc("total"), "term").limit(most)
    return per.crossJoin(n_units).select("term", "df", "total", (F.log((F.col("all_units") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def presence_vocabulary(table: DataFrame, least: int = 2, unit: str = "work_id") -> DataFrame:
    """term, units: terms that `least` units really have."""
    return table.where("n > 0").groupBy("term").agg(F.count_distinct(unit).alias("units")).where(F.col("units") >= least)


def selected(table: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The counts of vocabulary terms; Spark broadcasts the vocabulary if it is small."""
    return table.join(vocabulary, "term")


def relative(table: DataFrame, sizes: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, term, value: count / all events of the unit."""
    return table.join(sizes, unit).select(unit, "term", F.try_divide(F.col("n"), F.col("events")).cast("double").alias("value")).na.fill(0.0, ["value"])


def selected_share(table: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, term, value: count / the unit's selected counts."""
    total = F.sum("n").over(Window.partitionBy(unit))
    return table.select(unit, "term", (F.col("n") / total).alias("value"))


def tfidf(table: DataFrame, vocabulary: DataFrame, unit: str = "work_id", sublinear: bool = True) -> DataFrame:
    """unit, term, value: (1 + ln n) x idf, of length one for each unit."""
    tf = 1.0 + F.log("n") if sublinear else F.col("n").cast("double")
    weighted = table.join(vocabulary.select("term", "idf"), "term").select(unit, "term", (tf * F.col("idf")).alias("w"))
    return weighted.select(unit, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(unit)))).alias("value"))


def statistics(values: DataFrame, units: DataFrame) -> DataFrame:
    """term, mean, std over all units (absent terms are zeros; divisor n; a std of zero becomes 1e-9). units: one row each."""
    n = units.agg(F.count(F.lit(1)).cast("double").alias("n_units"))
    per = values.groupBy("term").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count(F.lit(1)).alias("k"), F.min("value").alias("low"), F.max("value").alias("high")).crossJoin(n)
    mean = F.col("s") / F.col("n_units")
    constant = (F.col("low") == F.col("high")) & (F.col("k") == F.col("n_units"))
    std = F.sqrt(F.greatest(F.col("q") / F.col("n_units") - mean * mean, F.lit(0.0)))
    return per.select("term", mean.alias("mean"), F.when(constant | (std == 0), F.lit(1e-9)).otherwise(std).alias("std"))


def zscores(values: DataFrame, stats: DataFrame, units: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, term, z for every unit and term: a dense grid, so for closed vocabularies of a few hundred terms."""
    grid = units.select(unit).crossJoin(F.broadcast(stats))
    joined = grid.join(values.select(F.col(unit).alias("_u"), F.col("term").alias("_t"), "value"), (F.col(unit) == F.col("_u")) & (F.col("term") == F.col("_t")), "left")
    return joined.select(unit, "term", ((F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("std")).alias("z"))


def max_abs(values: DataFrame, train: DataFrame | None = None, unit: str = "work_id") -> DataFrame:
    """unit, term, value / the largest absolute value of the term among training rows; terms of zeros stay."""
    top = (train if train is not None else values).groupBy("term").agg(F.max(F.abs("value")).alias("_m"))
    return values.join(top, "term").select(unit, "term", F.when(F.col("_m") > 0, F.col("value") / F.col("_m")).otherwise(F.col("value")).alias("value"))


def standardised(values: DataFrame, units: DataFrame, unit: str = "work_id") -> DataFrame:
    """As `zscores`, with terms that do not vary left centred only."""
    stats = statistics(values, units).withColumn("std", F.when(F.col("std") <= 1e-9, F.lit(1.0)).otherwise(F.col("std")))
    return zscores(values, stats, units, unit)


def blocks(parts: dict[str, DataFrame], unit: str = "work_id") -> DataFrame:
    """One long relation of several feature blocks, terms prefixed by the block's name."""
    out = None
    for name, part in parts.items():
        own = part.select(unit, F.concat(F.lit(f"{name}::"), F.col("term")).alias("term"), "value")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no feature block")
    return out


def hashed(table: DataFrame, buckets: int, unit: str = "work_id") -> DataFrame:
    """Counts by hash bucket instead of term."""
    return table.withColumn("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("string")).groupBy(unit, "term").agg(F.sum("n").alias("n"))


def truncated_svd(values: DataFrame, k: int, unit: str = "work_id") -> DataFrame:
    """unit, component, value: uncentred truncated SVD scores. The matrix stays distributed; the terms' Gram matrix (vocabulary
    squared, so a closed vocabulary) is what the driver sees."""
    import numpy as np

    pairs = values.alias("a").join(values.alias("b"), unit).groupBy(F.col("a.term").alias("i"), F.col("b.term").alias("j")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("g"))
    rows = pairs.collect()
    terms = sorted({r.i for r in rows})
    at = {t: n for n, t in enumerate(terms)}
    gram = np.zeros((len(terms), len(terms)))
    for r in rows:
        gram[at[r.i], at[r.j]] = r.g
    power, vectors = np.linalg.eigh(gram)
    chosen = np.argsort(-power)[: min(k, len(terms))]
    vectors = vectors[:, chosen] * np.where(vectors[np.abs(vectors[:, chosen]).argmax(axis=0), chosen] < 0, -1.0, 1.0) if len(terms) else vectors
    table = values.sparkSession.createDataFrame([(t, c, float(vectors[n, c])) for n, t in enumerate(terms) for c in range(len(chosen))], "term string, component int, load double")
    return values.join(F.broadcast(table), "term").groupBy(unit, "component").agg(F.sum(F.col("value") * F.col("load")).alias("value"))
