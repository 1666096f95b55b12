"""Scalar style features of a text, as columns and as long relations. Annotated tokens, where a feature needs them, are an input:
array<struct<i, text, lemma, pos, dep, head, morph, is_alpha, is_punct, is_space, like_num, sent>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.functions import tokens as T

# Vowels of the rhythm, counted as hard and soft.
HARD, SOFT = "аоуэы", "иеяёю"
# Noise patterns of the corpus check.
NOISE = {
    "chapter_markers": r"(?im)^\s*(глава|часть|том)\s+[ivxlcdm\d]",
    "page_numbers": r"(?m)^\s*\d{1,4}\s*$",
    "isbn": r"(?i)ISBN",
    "copyright": r"(?i)(©|copyright|все права защищены|OCR|FB2|fb2|библиотека)",
}


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.aggregate(counts, F.lit(0.0), lambda a, c: F.when(c > 0, a - c / total * F.log2(c / total)).otherwise(a))


def vowel_rhythm(text: Column, hard: str = HARD, soft: str = SOFT, least: int = 20) -> Column:
    """Entropy of neighbouring hard and soft vowels; zero below `least` vowels."""
    letters = F.regexp_replace(F.array_join(T.alpha_words(F.lower(text)), ""), f"[^{hard}{soft}]", "")

    def of(hs: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(hs) - 1, F.lit(1)))
        return T.let(F.transform(places, lambda i: F.substring(hs, i, F.lit(2))), lambda pairs: F.when(F.length(hs) < least, F.lit(0.0)).otherwise(entropy(F.array(*(_times(pairs, k) for k in ("HH", "HS", "SH", "SS"))))))

    return T.let(F.translate(letters, hard + soft, "H" * len(hard) + "S" * len(soft)), of)


def _times(values: Column, value: str) -> Column:
    return F.size(F.filter(values, lambda v: v == value)).cast("double")


def punctuation_rates(text: Column) -> dict[str, Column]:
    n = F.greatest(F.size(T.alpha_words(text)), F.lit(1))
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    marks = F.size(F.regexp_extract_all(text, F.lit(T.PUNCTUATION), F.lit(0)))
    tokens = marks + F.size(F.regexp_extract_all(text, F.lit(T.WORD), F.lit(0)))
    return {"punct_ratio": F.coalesce(F.try_divide(marks, tokens), F.lit(0.0)), "dash_per_100": 100.0 * (count("—") + count("-")) / n, "semi_per_100": 100.0 * count(";") / n}


def mean_lengths(text: Column) -> dict[str, Column]:
    w = T.alpha_words(text)
    s = F.transform(T.sentences(text), lambda x: F.size(T.alpha_words(x)))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)).otherwise(F.lit(0.0))
    return {"avg_word": mean(F.transform(w, F.length)), "avg_sent": mean(s)}


def speech_ratio(text: Column) -> Column:
    s = T.sentences(text)
    return F.when(F.size(s) > 0, F.size(F.filter(s, lambda x: x.rlike("^[—-]"))) / F.size(s)).otherwise(F.lit(0.0))


def cyrillic_ratio(text: Column) -> Column:
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return F.try_divide(F.length(F.regexp_replace(letters, "[^а-яёА-ЯЁ]", "")), F.length(letters))


def noise_counts(text: Column) -> dict[str, Column]:
    return {name: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for name, p in NOISE.items()}


def richness(rows: DataFrame, unit: str = "work_id", words: Column | None = None) -> DataFrame:
    """unit, ttr, hapax (share of types), yule_k over words (lemmas, if given)."""
    w = words if words is not None else T.words(F.col("text"))
    counts = rows.select(unit, F.explode(w).alias("t")).groupBy(unit, "t").agg(F.count(F.lit(1)).alias("n"))
    n, v, q = F.sum("n"), F.count(F.lit(1)), F.sum(F.col("n") * F.col("n"))
    return counts.groupBy(unit).agg((v / n).alias("ttr"), (F.sum((F.col("n") == 1).cast("long")) / v).alias("hapax"), F.when(n > 1, 10000.0 * (q - n) / (n * n)).otherwise(F.lit(0.0)).alias("yule_k"))


def length_histogram(rows: DataFrame, most: int = 16, unit: str = "work_id") -> DataFrame:
    """unit, length (most + 1 for all longer), share of words."""
    per = rows.select(unit, F.explode(T.alpha_words(F.col("text"))).alias("w")).groupBy(unit, F.least(F.length("w"), F.lit(most + 1)).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(unit).agg(F.sum("n").alias("all_n"))
    return per.join(total, unit).select(unit, "length", (F.col("n") / F.col("all_n")).alias("share"))


def sentence_lengths(rows: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, std (divisor n), cv, p10, p50, p90, short, long of words per sentence."""
    s = rows.select(unit, F.explode(T.sentences(F.col("text"))).alias("s")).select(unit, F.size(T.alpha_words(F.col("s"))).cast("double").alias("n"))
    p = F.percentile("n", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return s.groupBy(unit).agg(F.stddev_pop("n").alias("std"), F.coalesce(F.try_divide(F.stddev_pop("n"), F.avg("n")), F.lit(0.0)).alias("cv"), p[0].alias("p10"), p[1].alias("p50"), p[2].alias("p90"), F.avg((F.col("n") < 5).cast("double")).alias("short"), F.avg((F.col("n") > 30).cast("double")).alias("long"))


def richness_by_length(rows: DataFrame, least_points: int = 6, least_words: int = 5, unit: str = "work_id") -> DataFrame:
    """unit, slope, intercept, r2 of type-token ratio on sentence length; zeros for few points or no variation."""
    s = rows.select(unit, F.explode(T.sentences(F.col("text"))).alias("s")).select(unit, T.alpha_words(F.lower("s")).alias("w")).where(F.size("w") >= least_words)
    s = s.select(unit, F.size("w").cast("double").alias("x"), (F.size(F.array_distinct("w")) / F.size("w")).alias("y"))
    enough = (F.count(F.lit(1)) >= least_points) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    z = lambda c: F.when(enough, c).otherwise(F.lit(0.0))
    return s.groupBy(unit).agg(z(F.regr_slope("y", "x")).alias("slope"), z(F.regr_intercept("y", "x")).alias("intercept"), z(F.regr_r2("y", "x")).alias("r2"))


def pos_ratios(tokens: Column, tags: tuple[str, ...] = ("NOUN", "VERB", "ADJ", "ADV")) -> dict[str, Column]:
    alpha = F.filter(tokens, lambda t: t["is_alpha"])
    share = lambda tag: F.coalesce(F.try_divide(F.size(F.filter(alpha, lambda t: t["pos"] == tag)), F.size(alpha)), F.lit(0.0))
    return {tag.lower(): share(tag) for tag in tags}


def morphology(rows: DataFrame, unit: str = "chunk_id") -> DataFrame:
    """unit, term (Feature=Value), value: share of all feature values of alphabetic tokens."""
    per = rows.select(unit, F.explode(F.filter("tokens", lambda t: t["is_alpha"])).alias("t")).select(unit, F.explode(F.map_entries("t.morph")).alias("e")).groupBy(unit, F.concat_ws("=", "e.key", "e.value").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(unit).agg(F.sum("n").alias("s"))
    return per.join(total, unit).select(unit, "term", (F.col("n") / F.col("s")).alias("value"))


def dependencies(rows: DataFrame, unit: str = "chunk_id") -> DataFrame:
    """unit, term (dependency label), value: share of tokens."""
    return rows.select(unit, F.size("tokens").alias("s"), F.explode("tokens").alias("t")).groupBy(unit, F.col("t.dep").alias("term")).agg((F.count(F.lit(1)) / F.first("s")).alias("value"))


def tree_shape(tokens: Column, deepest: int = 200) -> dict[str, Column]:
    """Head distance, depth, branching and leaf ratio of the dependency trees. Depths come from following heads, all tokens at once,
    until every token reached its root (a fold over as many steps as there are tokens, `deepest` at most)."""
    heads = F.transform(tokens, lambda t: t["head"].cast("int"))
    n = F.size(tokens)
    dist = F.transform(tokens, lambda t: F.abs(t["i"] - t["head"]).cast("double"))
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("at"), F.transform(tokens, lambda t: F.lit(0)).alias("d"))

    def up(acc: Column, _: Column) -> Column:
        nxt = F.transform(acc["at"], lambda a: F.element_at(heads, a + 1))
        moved = F.zip_with(acc["at"], nxt, lambda a, b: (a != b).cast("int"))
        return F.struct(nxt.alias("at"), F.zip_with(acc["d"], moved, lambda d, m: d + m).alias("d"))

    depth = F.transform(F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(deepest + 1))), start, up)["d"], lambda d: d.cast("double"))
    children = F.transform(tokens, lambda t: F.size(F.filter(tokens, lambda c: (c["head"] == t["i"]) & (c["i"] != t["i"]))).cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / n
    z = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return {"head_dist_mean": z(mean(dist)), "head_dist_max": z(F.array_max(dist)), "tree_depth_mean": z(mean(depth)), "tree_depth_max": z(F.array_max(depth)), "branching_mean": z(mean(children)), "leaf_ratio": z(F.size(F.filter(children, lambda c: c == 0)) / n)}


def suffix_profile(tokens: Column, suffixes: list[str]) -> dict[str, Column]:
    """Over distinct noun, verb and adjective lemmas: types with each first matching suffix over types + 1, coverage, and the entropy of
    the suffixes over its largest value."""
    lemmas = F.array_distinct(F.transform(F.filter(tokens, lambda t: t["pos"].isin("NOUN", "VERB", "ADJ")), lambda t: F.lower(t["lemma"])))

    def first(w: Column) -> Column:
        case = F.when(F.lit(False), F.lit(""))
        for s in suffixes:
            case = case.when(w.endswith(s), F.lit(s))
        return case

    found = F.filter(F.transform(lemmas, first), lambda s: s.isNotNull())
    counts = F.array(*(_times(found, s) for s in suffixes))
    n = F.size(lemmas) + 1
    out = {f"suffix_{s}": F.element_at(counts, i + 1) / n for i, s in enumerate(suffixes)}
    largest = F.log2(F.lit(float(max(len(suffixes), 2))))
    return out | {"coverage": F.size(found) / n, "suffix_entropy": F.when(F.size(found) > 0, entropy(counts) / largest).otherwise(F.lit(0.0))}


def representation(rows: DataFrame) -> DataFrame:
    """All text features that need no fold and no annotation, in one pass over the text; written once, they serve every fold."""
    t = F.col("text")
    return rows.withColumns({"text_sha256": F.sha2(t, 256), "punct_str": T.punctuation_string(t), "vowel_entropy": vowel_rhythm(t), "speech": speech_ratio(t), "cyrillic": cyrillic_ratio(t), "old_letters": X.old_orthography_share(t), **mean_lengths(t), **punctuation_rates(t)})
