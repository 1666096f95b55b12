"""Quality rules: an isolation forest over rule statistics.

Every document gets a few counts (the rules). An isolation forest, whose trees each grow on a few good rows,
measures how few random splits set a document's counts apart; a document that is set apart sooner than
the calibrated threshold allows is rejected. The threshold comes from all labelled rows, see `threshold`.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows are each
judged, with equal verdicts; a very long text is counted whole, in memory of some ten times its size; an empty table gives an
empty result; without usable labels only the base rule decides (``score`` is null); columns of the input other than id and
text, whatever their names, are ignored by `judge`, kept by `keep`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import SPACE, map_batches, split_words

SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long, n_distinct long"
NAMES = [x.split()[0] for x in STATS.split(", ")]


def text_statistics(texts: list[str | None]) -> np.ndarray:
    """The counts of some texts, a row each, in the order of STATS. Words are numbered once for all of them."""
    out = np.zeros((len(texts), len(NAMES)), np.int64)
    codes, distinct, offsets = split_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    total = lambda flags: np.bincount(owner[flags], minlength=len(texts))
    out[:, 0] = np.diff(offsets)
    out[:, 4] = total(repeated_words(codes, owner))
    out[:, 6] = total(np.array([w.isupper() and len(w) > 1 for w in distinct], bool)[codes]) if len(codes) else 0
    out[:, 8] = np.bincount(np.unique(owner * len(distinct) + codes) // max(1, len(distinct)), minlength=len(texts))
    for i, text in enumerate(texts):
        if text:
            lines = [x for x in text.split("\n") if x.strip(SPACE)]
            out[i, [1, 2, 3, 5, 7]] = len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), text.count("!") + text.count("?")
    return out


def repeated_words(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of three words that occurs twice or more in its text. Hashes of the windows say which
    may, the words themselves which do."""
    flags = np.zeros(len(codes), bool)
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(codes) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return flags
    h = owner[at].astype(np.uint64)
    for k in range(3):
        h = (h ^ codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    del h
    at = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    if not len(at):
        return flags
    rows = np.stack([owner[at], codes[at], codes[at + 1], codes[at + 2]])
    order = np.lexsort(rows)
    rows, at = rows[:, order], at[order]
    same = (rows[:, 1:] == rows[:, :-1]).all(axis=0)
    at = at[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for k in range(3):
        flags[at + k] = True
    return flags


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, then STATS; one row for each input row, without a shuffle."""

    def stats(b: dict[str, list]) -> dict[str, list]:
        counts = text_statistics(b["text"])
        return {"id": b["id"], **{name: counts[:, i] for i, name in enumerate(NAMES)}}

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), stats, f"id {kind}, {STATS}")


def features(counts: np.ndarray) -> np.ndarray:
    """Rates out of the counts, so that a text's length alone says little."""
    c = counts.astype(float)
    n, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 5], 1)
    rates = [c[:, 1] / n, np.log1p(100 * c[:, 2] / n), np.log1p(100 * c[:, 3] / lines), np.log1p(100 * c[:, 4] / n), np.log1p(100 * c[:, 6] / n), np.log1p(100 * c[:, 7] / n)]
    return np.stack(rates, axis=1)


@dataclass(frozen=True)
class IsolationForest:
    """Trees as flat arrays [tree, node]; a node's children are 2k+1 and 2k+2. feature is -1 at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path length / usual path length): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            live = feature[node] >= 0
            while live.any():
                f = feature[node]
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(live, 2 * node + 1 + right, node)
                live = feature[node] >= 0
            total += path[node]
        return 2.0 ** (-total / (len(self.path) * self.usual))


def usual_path(n: int) -> float:
    """Mean length of an unsuccessful search among n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, box: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7) -> IsolationForest:
    """Random splits of random samples of x, each drawn over the node's part of `box` ([feature, low and high] over all
    calibration rows), not over the rows in it: so a split can set empty space apart, and rows that later fall there
    have a short path. Ends at single rows or at the depth of a balanced tree plus two."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = math.ceil(math.log2(max(sample, 2))) + 2
    size = 2 ** (depth + 1)
    feature, split, path = np.full((trees, size), -1, np.int16), np.zeros((trees, size)), np.zeros((trees, size))
    varied = np.flatnonzero(box[:, 1] > box[:, 0])
    for t in range(trees):
        todo = [(0, 0, rng.choice(len(x), sample, replace=False), box)]
        while todo:
            node, level, rows, part = todo.pop()
            if level >= depth or len(rows) < 2 or not len(varied):
                path[t, node] = level + usual_path(len(rows))
                continue
            f = int(rng.choice(varied))
            at = rng.uniform(*part[f])
            right = x[rows, f] >= at
            low, high = part.copy(), part.copy()
            low[f, 1] = high[f, 0] = at
            feature[t, node], split[t, node] = f, at
            todo += [(2 * node + 1, level + 1, rows[~right], low), (2 * node + 2, level + 1, rows[right], high)]
    return IsolationForest(feature, split, path, max(usual_path(sample), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, keep: float, good_weight: float = 5.0) -> float:
    """The score above which rows are rejected. Of the thresholds that keep the share `keep` of the good rows, the one with the
    largest share of bad rows rejected less `good_weight` times that of good ones; then the middle of the gap above it."""
    fine, bad = np.sort(scores[good]), np.sort(scores[~good])
    if not len(fine):
        return math.inf
    least = fine[min(len(fine) - 1, math.ceil(keep * len(fine)) - 1)]
    at = fine[fine >= least]
    gain = (len(bad) - np.searchsorted(bad, at, "right")) / max(len(bad), 1) - good_weight * (len(fine) - np.searchsorted(fine, at, "right")) / len(fine)
    best = at[len(at) - 1 - int(np.argmax(gain[::-1]))]
    above = np.concatenate([fine[fine > best], bad[bad > best]])
    return float((best + above.min()) / 2) if len(above) else float(best)


@dataclass(frozen=True)
class QualityModel:
    forest: IsolationForest
    threshold: float


def fit(docs: DataFrame, labels: DataFrame, trees: int = 200, sample: int = 256, keep: float = 0.998, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """Fits on all labelled rows. Each tree of the forest grows, as the method has it, on `sample` rows labelled good (quality 1), so
    that what is unlike them is isolated early; the pool of these are as many good rows as the trees draw in all, of smallest hashed
    id. The box that trees split and the threshold come from every labelled row. Rows with contradicting labels count as bad; null
    ids or labels are left out. None without a good row."""
    few = labels.select(F.col("doc_id").alias("id"), "quality").dropna().groupBy("id").agg(F.min("quality").alias("quality"))
    # counts are joined, not texts
    one = rule_statistics(docs.where(F.col(id_col).isNotNull()), id_col, text_col).groupBy("id").agg(F.min(F.struct(*NAMES)).alias("s"))  # of texts that share an id
    rows = one.join(few, "id").select("id", (F.col("quality") == 1).alias("good"), "s.*").persist()
    try:
        failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        pool = rows.where(F.col("good") & ~failed).orderBy(F.xxhash64("id"), "id").limit(trees * sample).select(*NAMES).collect()
        if not pool:
            return None
        forest = grow(features(np.array(pool, dtype=float)), box_of(rows), trees, sample)
        scored = scores_of(rows.where(~failed), forest).persist()
        try:
            return QualityModel(forest, whole_threshold(scored, keep))
        finally:
            scored.unpersist()
    finally:
        rows.unpersist()


def box_of(rows: DataFrame) -> np.ndarray:
    """[feature, low and high] over all rows of STATS."""

    def run(batches):
        ends = [features(np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in NAMES], axis=1)) for b in batches if b.num_rows]
        if ends:
            low, high = np.min([x.min(axis=0) for x in ends], axis=0), np.max([x.max(axis=0) for x in ends], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(low)), pa.int32()), pa.array(low), pa.array(high)], ["f", "low", "high"])

    sides = rows.select(*NAMES).mapInArrow(run, "f int, low double, high double").groupBy("f").agg(F.min("low"), F.max("high")).orderBy("f").collect()
    return np.array([r[1:] for r in sides], dtype=float)


def scores_of(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """score, good of rows (STATS, good)."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            x = features(np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in NAMES], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.score(x), pa.float64()), b.column("good")], ["score", "good"])

    return rows.select(*NAMES, "good").mapInArrow(run, "score double, good boolean")


def whole_threshold(scored: DataFrame, keep: float, good_weight: float = 5.0) -> float:
    """`threshold` over a table (score, good) of any size. The driver gets the highest scores of good rows, the share 1 - `keep` of
    them, which are the candidates, and the number of bad rows between each two."""
    n = {r.good: r["count"] for r in scored.groupBy("good").count().collect()}
    n_fine, n_bad = n.get(True, 0), n.get(False, 0)
    if not n_fine:
        return math.inf
    most = n_fine - min(n_fine - 1, math.ceil(keep * n_fine) - 1)
    fine = np.sort([r.score for r in scored.where("good").select("score").orderBy(F.desc("score")).limit(most).collect()])
    at = np.unique(fine)

    def run(batches):
        total = np.zeros(len(at) + 1, np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(at, b.column("score").to_numpy(zero_copy_only=False)), minlength=len(at) + 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    above = np.zeros(len(at) + 1, np.int64)
    for r in scored.where("not good").select("score").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        above[r.k] = r.n
    rejected = above[::-1].cumsum()[::-1][1:]  # bad rows above each candidate
    gain = rejected / max(n_bad, 1) - good_weight * (len(fine) - np.searchsorted(fine, at, "right")) / n_fine
    best = float(at[len(at) - 1 - int(np.argmax(gain[::-1]))])
    following = scored.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return best if following is None else (best + following) / 2


def base_rule(counts: np.ndarray, least_words: int) -> np.ndarray:
    """Which rows fail: under `least_words` words, or over half of them in repeated windows."""
    return (counts[:, 0] < least_words) | (100 * counts[:, 4] > 50 * counts[:, 0])


def judge(docs: DataFrame, model: QualityModel | None, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, STATS, base_failed (see `base_rule`), score, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of nodes: trees x 2^depth
    kind = dict(docs.dtypes)[id_col]

    def verdicts(b: dict[str, list]) -> dict[str, list]:
        counts = text_statistics(b["text"])
        failed = base_rule(counts, least_words)
        m = sent.value
        score = m.forest.score(features(counts)) if m else None
        kept = ~failed & (score <= m.threshold + 1e-12) if m else ~failed
        return {"id": b["id"], **{n: counts[:, i] for i, n in enumerate(NAMES)}, "base_failed": failed, "score": score if m else [None] * len(counts), "kept": kept}

    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), verdicts, f"id {kind}, {STATS}, base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: QualityModel | None, least_words: int = 50, text_col: str = "text") -> DataFrame:
    """The rows that `judge` keeps, with all their columns."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(b: dict[str, list]) -> dict[str, list]:
        counts = text_statistics(b[text_col])
        kept = ~base_rule(counts, least_words)
        if sent.value:
            kept &= sent.value.forest.score(features(counts)) <= sent.value.threshold + 1e-12
        return {n: [v for v, k in zip(b[n], kept, strict=True) if k] for n in names}

    return map_batches(docs, run, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes))


def quality_rules(docs: DataFrame, labels: DataFrame, least_words: int = 50, **options) -> DataFrame:
    """Fit and judge: the operator."""
    return judge(docs, fit(docs, labels, least_words=least_words, **options), least_words)
