"""Corpora as relations: works, chunks, labels, folds, weights.

chunks(author, label, work_id, ordinal, text); a work belongs to one author; label is the author's place in the sorted list.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import tokens as T


def works(docs: DataFrame, author: str = "source", work: str = "doc_id", text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """author, work_id, text and what else is to be kept of any table with such columns; rows without text or author are no works."""
    return docs.select(F.col(author).alias("author"), F.col(work).alias("work_id"), F.col(text).alias("text"), *keep).where("author is not null and work_id is not null and trim(text) <> ''")


def labels(rows: DataFrame) -> DataFrame:
    """author, label: places in the sorted list of authors, of which there are few."""
    return rows.select("author").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("author")) - 1)


def with_labels(rows: DataFrame) -> DataFrame:
    return rows.join(labels(rows), "author")


def without(rows: DataFrame, authors: Iterable[str], column: str = "author") -> DataFrame:
    return rows.where(~F.col(column).isin(list(authors))) if list(authors) else rows


def authors_of(rows: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    return without(rows, exclude).select("author").distinct().orderBy("author")


def work_authors(rows: DataFrame) -> DataFrame:
    """work_id, author; fails on a work of two authors."""
    one = rows.groupBy("work_id").agg(F.min("author").alias("author"), F.max("author").alias("_last"))
    return one.select("work_id", F.when(F.col("author").eqNullSafe(F.col("_last")), F.col("author")).otherwise(F.raise_error(F.concat(F.lit("work of several authors: "), F.col("work_id").cast("string")))).alias("author"))


def chunk_by_words(rows: DataFrame, size: int, keep_tail: bool = True) -> DataFrame:
    """Chunks of `size` words."""
    return rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(T.word_windows(F.col("text"), size, keep_tail)).alias("ordinal", "text"))


def chunk_by_sentences(rows: DataFrame, size: int = 500, least: int = 100, overlap: float = 0.0) -> DataFrame:
    """Chunks of whole sentences, some `size` words long. With an overlap the next window starts that share of its sentences earlier."""
    sents = T.sentences(F.col("text"))
    sizes = F.transform(sents, lambda s: F.size(F.regexp_extract_all(s, F.lit(T.WORD), F.lit(0))))
    keep = [c for c in rows.columns if c != "text"]
    if not overlap:
        return rows.select(*keep, F.posexplode(T.packed_sentences(sents, sizes, size, least)).alias("ordinal", "text"))
    kind = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n != "text")

    def cut(batches):
        import pandas as pd

        for b in batches:
            out = []
            for *head, texts, counts in b.itertuples(index=False):
                start, ordinal = 0, 0
                while start < len(texts):
                    end, n = start, 0
                    while end < len(texts) and (n + counts[end] <= size or n == 0):
                        n += counts[end]
                        end += 1
                    if n >= least or (end - start == 1 and n > size):
                        out.append((*head, ordinal, " ".join(texts[start:end])))
                        ordinal += 1
                    start += max(1, round(max(1, end - start) * (1.0 - overlap)))
            yield pd.DataFrame(out, columns=[*keep, "ordinal", "text"])

    return rows.select(*keep, sents.alias("_s"), sizes.alias("_n")).mapInPandas(cut, f"{kind}, ordinal int, text string")


def chapters(rows: DataFrame, heading: str = r"(?im)^[ \t]*глава[ \t]+[\p{L}\p{N}]+[.]?[ \t]*$", least_words: int = 50) -> DataFrame:
    """Segments between heading lines; headings and short segments go."""
    parts = F.split(F.col("text"), heading)
    out = rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(parts).alias("chapter", "text"))
    return out.where(F.size(T.space_words(F.col("text"))) >= least_words).withColumn("text", F.trim("text"))


def work_weights(rows: DataFrame) -> DataFrame:
    """weight: works / (authors x works of the author x chunks of the work); an author's rows sum to works / authors."""
    per_work = rows.groupBy("author", "work_id").agg(F.count(F.lit(1)).alias("_chunks"))
    per_author = per_work.groupBy("author").agg(F.count(F.lit(1)).alias("_works"))
    total = per_author.agg(F.sum("_works").alias("_all"), F.count(F.lit(1)).alias("_authors"))
    share = per_work.join(per_author, "author").crossJoin(total).select("author", "work_id", (F.col("_all") / (F.col("_authors") * F.col("_works") * F.col("_chunks"))).alias("weight"))
    return rows.join(share, ["author", "work_id"])


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """class_weight: rows / (classes x rows of the class)."""
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return rows.join(per.crossJoin(total).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("class_weight")), label)


def weights(rows: DataFrame, weighting: str) -> DataFrame:
    """`work_balanced`, `class_balanced` or `none`."""
    if weighting == "work_balanced":
        return work_weights(rows)
    if weighting == "class_balanced":
        return balanced_weights(rows)
    if weighting != "none":
        raise ValueError(f"unknown weighting: {weighting}")
    return rows.withColumn("weight", F.lit(1.0))


def ordered_by_work(rows: DataFrame, value: str, ordinal: str = "ordinal") -> DataFrame:
    """work_id and its values in order; a work is bounded, a corpus is not."""
    return rows.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, value))), lambda s: s[value]).alias("values"))


def held_out_works(rows: DataFrame, least_works: int = 2) -> DataFrame:
    """fold, work_id, author, label of each work whose author has `least_works`; the others only ever train. Folds go by work."""
    works_ = with_labels(rows.select("author", "work_id").distinct())
    enough = works_.groupBy("author").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_works).select("author")
    return works_.join(enough, "author").withColumn("fold", F.row_number().over(Window.orderBy("author", "work_id")) - 1).select("fold", "work_id", "author", "label")


def fold_roles(rows: DataFrame, folds: DataFrame, unit: str = "work_id") -> DataFrame:
    """fold, role (train or test) and the row: every row once for each fold. For work tables; never for features, where sums less
    the own part do the same without copies."""
    return rows.crossJoin(F.broadcast(folds.select("fold", F.col(unit).alias("_own")))).withColumn("role", F.when(F.col(unit) == F.col("_own"), "test").otherwise("train")).drop("_own")


def round_robin_folds(rows: DataFrame, k: int) -> DataFrame:
    """work_id, author, fold: (author's rank + work's rank) mod k."""
    w = rows.select("author", "work_id").distinct()
    return w.withColumn("fold", F.pmod(F.dense_rank().over(Window.orderBy("author")) - 1 + F.row_number().over(Window.partitionBy("author").orderBy("work_id")) - 1, F.lit(k)).cast("int"))


def panel(rows: DataFrame, k: int = 5, least_works: int = 2) -> DataFrame:
    """The frozen screening panel: round-robin folds over authors with enough works."""
    w = rows.select("author", "work_id").distinct()
    enough = w.groupBy("author").count().where(F.col("count") >= least_works).select("author")
    return round_robin_folds(w.join(enough, "author"), k)


def factor_folds(rows: DataFrame, factor: str, author: str = "author") -> DataFrame:
    """level, n_train, n_test, train_classes, missing_classes: what leaving one level out leaves to train on. A missing level is a level."""
    level = F.coalesce(F.col(factor).cast("string"), F.lit("<missing>"))
    per = rows.select(level.alias("level"), F.col(author).alias("author")).groupBy("level", "author").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("author").agg(F.sum("n").alias("all_n"))
    n_all = per.agg(F.sum("n").alias("rows_all"), F.count_distinct("author").alias("classes"))
    by = per.join(totals, "author").groupBy("level").agg(F.sum("n").alias("n_test"), F.sum((F.col("all_n") == F.col("n")).cast("int")).alias("missing_classes"))
    return by.crossJoin(n_all).select("level", (F.col("rows_all") - F.col("n_test")).alias("n_train"), "n_test", (F.col("classes") - F.col("missing_classes")).alias("train_classes"), F.col("missing_classes").cast("long").alias("missing_classes"))


def purged_cells(rows: DataFrame, factor: str, group: str) -> DataFrame:
    """level, grp, n_test, n_train, n_purged: test is the level within the group, train is other levels of other groups, what shares
    one of both is purged. Counts by inclusion and exclusion, without copying rows."""
    base = rows.select(F.coalesce(F.col(factor).cast("string"), F.lit("<missing>")).alias("level"), F.col(group).cast("string").alias("grp"))
    cells = base.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("n_test"))
    by_level = cells.groupBy("level").agg(F.sum("n_test").alias("in_level"))
    by_group = cells.groupBy("grp").agg(F.sum("n_test").alias("in_group"))
    total = cells.agg(F.sum("n_test").alias("all_n"))
    either = F.col("in_level") + F.col("in_group") - F.col("n_test")
    return cells.join(by_level, "level").join(by_group, "grp").crossJoin(total).select("level", "grp", "n_test", (F.col("all_n") - either).alias("n_train"), (either - F.col("n_test")).alias("n_purged"))


def purged_role(level: Column, group: Column, test_level: str, test_group: str) -> Column:
    """A row's role in one cell."""
    return F.when((level == test_level) & (group == test_group), "test").when((level != test_level) & (group != test_group), "train").otherwise("purged")


def subset(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """Whole works of another table."""
    return rows.join(keep.select("work_id").distinct(), "work_id", "left_semi")


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: count and an order-free digest of the rows."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("digest"))


def differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: only_left, only_right or changed."""
    joined = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    status = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(F.col("_a") != F.col("_b"), "changed")
    return joined.select(key, status.alias("status")).where("status is not null")


def summary(rows: DataFrame) -> DataFrame:
    """One row: authors, works, words, and the largest to the smallest author by words."""
    per = rows.groupBy("author").agg(F.count_distinct("work_id").alias("n"), F.sum(F.size(T.space_words(F.col("text")))).alias("words"))
    return per.agg(F.count(F.lit(1)).alias("n_authors"), F.sum("n").alias("n_works"), F.sum("words").alias("total_words"), F.round(F.max("words") / F.min(F.when(F.col("words") > 0, F.col("words"))), 1).alias("imbalance"))
