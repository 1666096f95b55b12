"""Attribution cases: a feasibility gate, then a diagnostic ranking that always abstains."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.functions.words import function_words
from quillmark.operators import attribution as A
from quillmark.operators import metrics as M
from quillmark.operators import panels as P
from quillmark.operators import resampling as R
from quillmark.operators import vocabulary as V
from quillmark.sources.files import strict_json

# Other names of feature sets, and the gate's limits.
ALIASES = {"function_words": "fw_fixed", "fw": "fw_fixed", "topic_strict": "fw_fixed", "char": "char3", "char_3gram": "char3", "char3+fw": "char3_fw", "fw+char3": "char3_fw"}
LEAST_RECALL, MOST_P, EPS = 0.80, 0.05, 1e-9


@dataclass(frozen=True)
class CaseSpec:
    case_id: str
    authors: tuple[str, ...]
    target: str | None = None
    feature_sets: tuple[str, ...] = ("fw_fixed", "char3")
    language: str = "en"
    chunk_words: int = 500
    min_work_words: int = 0
    balanced: bool = True
    max_exact: int = 5000
    n_random: int = 1000
    seed: int = 42
    gates: tuple[str, ...] = ()
    exclude: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def parse(text: str) -> CaseSpec:
        raw = strict_json(text)
        return CaseSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def feature_rows(chunks: DataFrame, feature_set: str, language: str = "en", most: int = 800, unit: str = "chunk_id", fit_on: DataFrame | None = None) -> DataFrame:
    """unit, term, value of unit length: function-word counts, or sublinear TF-IDF of character trigrams within words, or both. `fit_on`
    are the chunks that the vocabulary and its weights come from."""
    name = ALIASES.get(feature_set.lower().strip(), feature_set.lower().strip())
    fit = chunks if fit_on is None else fit_on
    if name == "fw_fixed":
        words = chunks.sparkSession.createDataFrame([(w,) for w in sorted(set(function_words(language)))], "term string")
        c = V.counts(chunks, T.hyphen_words(F.col("text")), unit).join(F.broadcast(words), "term")
        return A.unit_length(c.select(unit, "term", F.col("n").cast("double").alias("value")), unit)
    if name == "char3":
        grams = T.char_ngrams_in_words(F.lower(F.col("text")), 3)
        own, base = V.counts(chunks, grams, unit), V.counts(fit, grams, unit)
        return V.tfidf(own, V.pooled_vocabulary(base, 1, most, unit), unit)
    if name == "char3_fw":
        parts = {n: feature_rows(chunks, n, language, most, unit, fit_on) for n in ("fw_fixed", "char3")}
        return A.unit_length(V.blocks(parts, unit), unit)
    raise ValueError(f"unknown feature set: {feature_set}")


def work_vectors(chunks: DataFrame, feature_set: str, language: str = "en") -> DataFrame:
    """work_id, term, value: the unit mean of a work's chunk rows."""
    rows = feature_rows(chunks, feature_set, language)
    return A.unit_length(A.unit_means(rows, chunks.select("chunk_id", "work_id"), "work_id"), "work_id")


def panel_of(chunks: DataFrame, feature_set: str, language: str = "en") -> P.Panel:
    """The panel's `work_vectors`, a row a work. Function words are counted chunk by chunk, without a long relation."""
    name = ALIASES.get(feature_set.lower().strip(), feature_set.lower().strip())
    if name == "fw_fixed":
        words = sorted(set(function_words(language)))
        return P.Panel(P.packed_counts(chunks, T.hyphen_words(F.col("text")), words), len(words))
    vectors = V.hoisted(work_vectors(chunks, feature_set, language))
    terms = [r.term for r in vectors.select("term").distinct().orderBy("term").collect()]  # a closed vocabulary
    out = P.Panel(P.packed(vectors, chunks, terms), len(terms))
    vectors.unpersist()
    return out


def gate(chunks: DataFrame, spec: CaseSpec, feature_set: str) -> dict:
    """Leave-one-work-out recall and its permutation p on the panel. chunks: chunk_id, work_id, author, text. Features are fitted on the
    panel, labels alone are held out, so permutations share one set of work vectors."""
    panel = panel_of(chunks, feature_set, spec.language)
    try:
        if panel.works.min(initial=np.inf) < 2 or len(panel.works) < 2:
            return {"status": "uncomputable", "work_macro_recall": 0.0, "permutation_p": None, "gate_pass": False, "failures": ["gate_requires_at_least_two_works_per_author"]}
        hits = panel.held_out().groupBy("work_id", "author").agg(F.min(F.struct((-F.col("score")).alias("neg"), "candidate"))["candidate"].alias("candidate"))
        recall = hits.groupBy("author").agg(F.avg((F.col("candidate") == F.col("author")).cast("double")).alias("r")).agg(F.avg("r")).first()[0]
        p = permutation(panel, recall, spec)
    finally:
        panel.close()
    failures = ["work_macro_recall_below_0_80"] * (recall < LEAST_RECALL - EPS) + ["work_permutation_not_significant"] * (p > MOST_P)
    return {"status": "fail" if failures else "pass", "work_macro_recall": round(recall, 4), "permutation_p": p, "gate_pass": not failures, "failures": failures}


def permutation(panel: P.Panel, observed: float, spec: CaseSpec) -> float:
    """p of the recall among assignments of the panel's labels to its works: all of them for two authors if they are few, else
    random orders of the labels, for any number of authors."""
    n, first = len(panel.labels), int(panel.works[0])
    # more works than assignments allowed have more assignments, too
    if len(panel.works) == 2 and n <= spec.max_exact and math.comb(n, first) <= spec.max_exact:
        sets, exact = R.label_assignments(range(n), first, spec.max_exact, spec.n_random, spec.seed)
        orders = (np.array([w not in s for w in range(n)], panel.labels.dtype) for s in sets)
    else:
        orders, exact = panel.random_orders(spec.n_random, spec.seed), False
    return R.permutation_p(observed, panel.recalls(orders), exact)


def attribute(panel: DataFrame, target: DataFrame, spec: CaseSpec, feature_set: str) -> DataFrame:
    """candidate, score, place of the target's unit work mean against the candidates' centroids; a diagnosis, never a verdict."""
    rows = feature_rows(panel.unionByName(target), feature_set, spec.language, fit_on=panel)
    own = rows.join(panel.select("chunk_id"), "chunk_id", "left_semi")
    works = A.unit_length(A.unit_means(own, panel.select("chunk_id", "work_id"), "work_id"), "work_id")
    centroids = A.cosine_centroids(works, panel.select("work_id", "author").distinct(), spec.balanced)
    them = rows.join(target.select("chunk_id"), "chunk_id", "left_semi").join(target.select("chunk_id", "work_id"), "chunk_id")
    vector = A.unit_length(A.unit_means(them.select("chunk_id", "term", "value"), target.select("chunk_id", "work_id"), "work_id"), "work_id").groupBy("term").agg(F.avg("value").alias("value")).withColumn("work_id", F.lit("target"))
    scores = A.cosine_scores(vector.select("work_id", "term", "value"), centroids)
    return M.stable_top(scores.select("work_id", F.col("candidate").alias("label"), F.col("score").alias("p")), 1000).select(F.col("label").alias("candidate"), F.col("p").alias("score"), "place")


def evidence_score(recall: Column, p: Column, consistency: Column, margin: Column, failures: Column) -> Column:
    """0..100 out of recall, significance, agreement of feature sets, margin, less a penalty for failures."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    sig = F.coalesce(clamp(-F.log10(F.greatest(p, F.lit(1e-12))) / 3.0), F.lit(0.0))
    raw = 0.45 * clamp(recall) + 0.25 * sig + 0.20 * consistency + 0.10 * clamp(F.coalesce(margin, F.lit(0.0)) / 0.05) - F.least(F.lit(0.3), 0.05 * failures)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * raw))


def required_gates(wanted: tuple[str, ...], results: dict[str, bool | None]) -> dict[str, str]:
    """pass, fail, unavailable (known, without result) or unknown for each gate asked for."""
    return {g: "unknown" if g not in results else "unavailable" if results[g] is None else "pass" if results[g] else "fail" for g in wanted}


def run(spark: SparkSession, chunks: DataFrame, spec: CaseSpec, target: DataFrame | None = None) -> dict:
    """The passport: gates, the best of them, the diagnostic ranking and a decision. Always abstains from naming an author."""
    chunks = chunks.where(F.col("author").isin(list(spec.authors)) & ~F.col("work_id").cast("string").isin(list(spec.exclude) or [""]))
    gates = {f: gate(chunks, spec, f) for f in spec.feature_sets}
    best = max(gates, key=lambda f: (gates[f]["gate_pass"], gates[f]["work_macro_recall"], f))
    ranks = {f: [(r.candidate, round(r.score, 6)) for r in attribute(chunks, target, spec, f).orderBy("place").collect()] for f in spec.feature_sets} if target is not None else {}
    tops = [r[0][0] for r in ranks.values() if r]
    margin = ranks[best][0][1] - ranks[best][1][1] if ranks and len(ranks.get(best, [])) > 1 else 0.0
    g = gates[best]
    sig = min(1.0, max(0.0, -math.log10(max(g["permutation_p"], 1e-12)) / 3)) if g["permutation_p"] is not None else 0.0
    consistency = tops.count(ranks[best][0][0]) / len(tops) if tops else 0.0
    evidence = max(0.0, min(100.0, 100 * (0.45 * min(1.0, g["work_macro_recall"]) + 0.25 * sig + 0.2 * consistency + 0.1 * max(0.0, min(1.0, margin / 0.05)) - min(0.3, 0.05 * len(set(g["failures"]))))))
    decision = "fail" if not g["gate_pass"] else "gate_only" if target is None else "inconclusive"
    return {"case_id": spec.case_id, "decision": decision, "feature_set": best, "gates": gates, "diagnostic_ranking": ranks.get(best, []), "winner": None, "abstained": True, "evidence": round(evidence, 4)}


def passport_row(spark: SparkSession, passport: dict) -> DataFrame:
    return spark.createDataFrame([(passport["case_id"], passport["decision"], passport["evidence"], json.dumps(passport, sort_keys=True))], "case_id string, decision string, evidence double, passport string")


def ranked(passports: DataFrame) -> DataFrame:
    """Strongest evidence first, then the stronger decision."""
    strength = F.when(F.col("decision") == "gate_only", 2).when(F.col("decision") == "inconclusive", 1).otherwise(0)
    return passports.orderBy(F.desc("evidence"), F.desc(strength), "case_id")
