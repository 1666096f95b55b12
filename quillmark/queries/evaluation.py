"""Metrics, tests and inference over predictions: the language of a document, guessed from its letters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmark.operators import metrics as M
from quillmark.operators import resampling as RS
from quillmark.queries.registry import documents, query

PREDS = "preds AS (SELECT doc_id AS work_id, source AS author, lang AS true_label, CASE WHEN regexp_matches(text, '[éèêç]') THEN 'fr' WHEN regexp_matches(text, '[ßöäü]') THEN 'de' WHEN regexp_matches(text, '[ñí]') THEN 'es' ELSE 'en' END AS pred_label FROM documents)"
MARKED = f"{PREDS}, marked AS (SELECT *, true_label = pred_label AS correct FROM preds)"
LABELS = "labels_ AS (SELECT DISTINCT lang AS label FROM documents)"
SCORES = "sc AS (SELECT doc_id AS work_id, lang AS true_label, label, n, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, lang, unnest(['de', 'en', 'es', 'fr']) AS label, unnest([1 + len(regexp_extract_all(text, '[ßöäü]')), 1 + len(regexp_extract_all(text, 'th')), 1 + len(regexp_extract_all(text, '[ñí]')), 1 + len(regexp_extract_all(text, '[éèêç]'))]) AS n FROM documents))"


def preds(spark, d):
    t = F.col("text")
    guess = F.when(t.rlike("[éèêç]"), "fr").when(t.rlike("[ßöäü]"), "de").when(t.rlike("[ñí]"), "es").otherwise("en")
    return documents(spark, d).select(F.col("doc_id").alias("work_id"), F.col("source").alias("author"), F.col("lang").alias("true_label"), guess.alias("pred_label")).withColumn("correct", F.col("true_label") == F.col("pred_label"))


def label_list(spark, d):
    return documents(spark, d).select(F.col("lang").alias("label")).distinct()


def scores(spark, d):
    n = lambda p: 1 + F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    pairs = F.array(*(F.struct(F.lit(k).alias("label"), n(p).alias("n")) for k, p in (("de", "[ßöäü]"), ("en", "th"), ("es", "[ñí]"), ("fr", "[éèêç]"))))
    rows = documents(spark, d).select(F.col("doc_id").alias("work_id"), F.col("lang").alias("true_label"), pairs.alias("s"))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["n"])
    return rows.select("work_id", "true_label", F.explode(F.transform("s", lambda x: F.struct(x["label"].alias("label"), (x["n"] / total).alias("p")))).alias("x")).select("work_id", "true_label", "x.*")


@query(f"WITH {MARKED} SELECT avg(CAST(correct AS INT)) AS accuracy FROM marked", "accuracy")
def accuracy(spark, d):
    return M.accuracy(preds(spark, d))


PER = f"{PREDS}, {LABELS}, per AS (SELECT label, count(*) FILTER (true_label = label AND pred_label = label) AS tp, count(*) FILTER (true_label = label) AS n_true, count(*) FILTER (pred_label = label) AS n_pred FROM labels_, preds GROUP BY label)"


@query(f"WITH {PER} SELECT label, tp, n_true, n_pred, coalesce(tp / nullif(n_pred, 0), 0) AS precision, tp / nullif(n_true, 0) AS recall, coalesce(2 * tp / nullif(n_true + n_pred, 0), 0) AS f1 FROM per", "precision recall f1")
def per_label(spark, d):
    return M.per_label(preds(spark, d), label_list(spark, d))


@query(f"WITH {PER} SELECT avg(coalesce(2 * tp / nullif(n_true + n_pred, 0), 0)) AS macro_f1 FROM per", "macro_f1")
def macro_f1(spark, d):
    return M.macro_f1(preds(spark, d), label_list(spark, d))


@query(f"WITH {PREDS}, {LABELS} SELECT a.label AS true_label, b.label AS pred_label, count(p.work_id) AS n FROM labels_ a CROSS JOIN labels_ b LEFT JOIN preds p ON p.true_label = a.label AND p.pred_label = b.label GROUP BY ALL")
def confusion(spark, d):
    return M.confusion(preds(spark, d), label_list(spark, d))


@query(f"WITH {MARKED} SELECT author AS level, count(*) AS n, avg(CAST(correct AS INT)) AS accuracy FROM marked GROUP BY ROLLUP (author)", "accuracy")
def factor_slices(spark, d):
    return M.slices(preds(spark, d), "author")


@query(f"WITH {SCORES}, r AS (SELECT *, max(p) FILTER (label = true_label) OVER (PARTITION BY work_id) AS own, row_number() OVER (PARTITION BY work_id ORDER BY p DESC, label) AS place FROM sc) SELECT work_id, true_label, max(label) FILTER (place = 1) AS pred_label, count(*) FILTER (p >= own) AS rank FROM r GROUP BY ALL")
def worst_tie_rank(spark, d):
    return M.worst_tie_rank(scores(spark, d))


@query(f"WITH {SCORES} SELECT work_id, true_label, label, p, place FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY p DESC, label) AS place FROM sc) WHERE place <= 2", "p")
def stable_top(spark, d):
    return M.stable_top(scores(spark, d), 2).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SCORES} SELECT work_id, (list(p ORDER BY p DESC))[1] - (list(p ORDER BY p DESC))[2] AS margin FROM sc GROUP BY work_id", "margin")
def margin(spark, d):
    return M.margin(scores(spark, d))


@query(f"WITH {SCORES}, r AS (SELECT work_id, count(*) FILTER (p >= own) AS rank FROM (SELECT *, max(p) FILTER (label = true_label) OVER (PARTITION BY work_id) AS own FROM sc) GROUP BY work_id) SELECT avg(CAST(rank <= 2 AS INT)) AS top_k FROM r", "top_k")
def top_k_accuracy(spark, d):
    return M.top_k_accuracy(M.worst_tie_rank(scores(spark, d)), 2)


@query(f"WITH {SCORES}, c AS (SELECT work_id, max(p) AS conf, (list(label ORDER BY p DESC, label))[1] = any_value(true_label) AS correct FROM sc GROUP BY work_id), b AS (SELECT ceil(conf * 10) AS bin, count(*) AS n, avg(CAST(correct AS INT)) AS acc, avg(conf) AS c FROM c WHERE conf > 0 GROUP BY bin) SELECT sum(n / (SELECT count(*) FROM c) * abs(acc - c)) AS ece FROM b", "ece")
def calibration_error(spark, d):
    top = M.stable_top(scores(spark, d))
    return M.calibration_error(top.select(F.col("p").alias("conf"), (F.col("label") == F.col("true_label")).alias("correct")))


@query("WITH v AS (SELECT source AS author, lang AS label, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT author AS work_id, label FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, first, label) AS r FROM v) WHERE r = 1")
def majority_vote(spark, d):
    return M.majority_vote(documents(spark, d).select(F.col("source").alias("work_id"), F.col("lang").alias("label"), F.col("doc_id").alias("ordinal")))


@query(f"WITH {SCORES} SELECT d.source AS work_id, l.label, coalesce(sum(sc.p), 0) / count(DISTINCT d.doc_id) AS p FROM documents d CROSS JOIN (SELECT DISTINCT label FROM sc) l LEFT JOIN sc ON sc.work_id = d.doc_id AND sc.label = l.label GROUP BY ALL", "p")
def soft_vote(spark, d):
    s = scores(spark, d).join(documents(spark, d).select(F.col("doc_id").alias("work_id"), "source"), "work_id").select(F.col("source").alias("unit"), F.col("work_id").alias("chunk"), "label", "p")
    return M.soft_vote(s, s.select("label").distinct(), "unit").withColumnRenamed("unit", "work_id")


@query("SELECT (same / n - cross_ / (n * n)) / (1 - cross_ / (n * n)) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same FROM labels), (SELECT sum(a.n * b.n) AS cross_ FROM (SELECT quality AS l, count(*) AS n FROM labels GROUP BY l) a JOIN (SELECT toxic AS l, count(*) AS n FROM labels GROUP BY l) b USING (l))", "kappa")
def kappa(spark, d):
    return M.kappa(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic")


@query(r"WITH s AS (SELECT len(regexp_extract_all(text, '[éèêç]')) / greatest(length(text), 1) AS s, lang = 'fr' AS y FROM documents), g AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM s GROUP BY s) SELECT sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)", "auc")
def auc(spark, d):
    s = F.size(F.regexp_extract_all("text", F.lit("[éèêç]"), F.lit(0))) / F.greatest(F.length("text"), F.lit(1))
    return M.auc(documents(spark, d).select(s.alias("score"), (F.col("lang") == "fr").alias("positive")))


@query(f"WITH {MARKED} SELECT count(*) FILTER (correct AND true_label = 'en') AS both, count(*) FILTER (NOT correct AND true_label = 'en') AS gained, count(*) FILTER (correct AND true_label <> 'en') AS lost, count(*) FILTER (NOT correct AND true_label <> 'en') AS neither FROM marked")
def paired_transitions(spark, d):
    p = preds(spark, d)
    return M.paired(p, p.select("work_id", (F.col("true_label") == "en").alias("correct")))


MCNEMAR = f"{MARKED}, n AS (SELECT author, count(*) FILTER (NOT correct AND true_label = 'en') AS b, count(*) FILTER (correct AND true_label <> 'en') AS c FROM marked GROUP BY author), k AS (SELECT author, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM n), t AS (SELECT author, b, c, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) AS tail FROM k GROUP BY ALL), m AS (SELECT author, b, c, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * tail) END AS p FROM t)"


def mcnemar_rows(spark, d):
    p = preds(spark, d)
    n = p.groupBy("author").agg(F.sum((~F.col("correct") & (F.col("true_label") == "en")).cast("long")).alias("b"), F.sum((F.col("correct") & (F.col("true_label") != "en")).cast("long")).alias("c"))
    return n.withColumn("p", M.mcnemar_p(F.col("b"), F.col("c")))


@query(f"WITH {MCNEMAR} SELECT author, b, c, p FROM m", "p")
def mcnemar(spark, d):
    return mcnemar_rows(spark, d)


@query(f"WITH {MCNEMAR}, h AS (SELECT author, p, row_number() OVER (ORDER BY p, author) AS r, count(*) OVER () AS k FROM m) SELECT author AS name, p, least(1, max((k - r + 1) * p) OVER (ORDER BY p, author ROWS UNBOUNDED PRECEDING)) AS holm FROM h", "p holm")
def holm(spark, d):
    return M.holm(mcnemar_rows(spark, d).select(F.col("author").alias("name"), "p"))


@query("WITH r AS (SELECT d.lang AS author, d.source AS work, l.quality = 1 AS ok FROM documents d JOIN labels l USING (doc_id)), w AS (SELECT author, work, count(*) FILTER (ok) AS c, count(*) AS t FROM r GROUP BY ALL) SELECT author, count(*) FILTER (2 * c > t) / count(*) AS work_recall, sum(c) / sum(t) AS chunk_recall, count(*) FILTER (2 * c > t) || '/' || count(*) AS works, CAST(sum(c) AS BIGINT) || '/' || CAST(sum(t) AS BIGINT) AS chunks FROM w GROUP BY author", "work_recall chunk_recall")
def work_and_chunk_recall(spark, d):
    r = documents(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select(F.col("lang").alias("author"), F.col("source").alias("work_id"), (F.col("quality") == 1).alias("correct"))
    return M.recalls(r)


@query(f"WITH p AS (SELECT d.lang AS t, CASE WHEN l.doc_id IS NOT NULL THEN p.pred_label END AS g FROM documents d LEFT JOIN labels l USING (doc_id) JOIN ({'WITH ' + PREDS + ' SELECT * FROM preds'}) p ON p.work_id = d.doc_id), c AS (SELECT DISTINCT t AS label FROM p), f AS (SELECT label, 2 * count(*) FILTER (t = label AND g = label) AS a, count(*) FILTER (t = label) + count(*) FILTER (g = label) AS b FROM c, p GROUP BY label) SELECT (SELECT avg(CASE WHEN g = t THEN 1 ELSE 0 END) FROM p) AS accuracy, (SELECT avg(CASE WHEN g IS NULL THEN 0 ELSE 1 END) FROM p) AS coverage, avg(a / nullif(b, 0)) AS macro_f1 FROM f", "accuracy coverage macro_f1")
def abstention(spark, d):
    known = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("work_id"), F.lit(True).alias("known"))
    p = preds(spark, d).join(known, "work_id", "left").withColumn("pred_label", F.when(F.col("known"), F.col("pred_label")))
    return M.abstaining(p, label_list(spark, d))


@query(f"WITH {SCORES} SELECT work_id, 'sum' AS problem FROM sc GROUP BY work_id HAVING abs(sum(p) - 1) > 1e-6 UNION ALL SELECT work_id, 'value' FROM sc WHERE p < 0 OR p > 1")
def probability_violations(spark, d):
    return M.violations(scores(spark, d))


def _draws(n: int, draws: int, seed: int = 42):
    rng = np.random.default_rng(seed)
    for i in range(draws):
        times = np.bincount(rng.choice(np.arange(n), size=n, replace=True), minlength=n)
        yield from ((i, j, int(times[j])) for j in np.flatnonzero(times))


_VALUES = ", ".join(f"({i}, {j}, {t})" for i, j, t in _draws(20, 100))
BOOT = f"{MARKED}, s AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS u, sum(CAST(correct AS INT)) AS num, count(*) AS den FROM marked GROUP BY author), dr(draw, u, times) AS (VALUES {_VALUES}), b AS (SELECT draw, sum(num * times) / sum(den * times) AS v FROM s JOIN dr USING (u) GROUP BY draw)"


@query(f"WITH {BOOT} SELECT (SELECT sum(num) / sum(den) FROM s) AS point, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM b", "point lo hi")
def clustered_bootstrap(spark, d):
    return RS.clustered_ci(preds(spark, d), "author", 100)


@query(f"WITH {MARKED}, s AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS u, sum(CAST(correct AS INT)) - sum(CAST(true_label = 'en' AS INT)) AS num, count(*) AS den FROM marked GROUP BY author), dr(draw, u, times) AS (VALUES {_VALUES}), b AS (SELECT draw, sum(num * times) / sum(den * times) AS v FROM s JOIN dr USING (u) GROUP BY draw), q AS (SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM b) SELECT (SELECT sum(num) / sum(den) FROM s) AS diff, lo, hi, NOT (lo <= 0 AND hi >= 0) AS significant FROM q", "diff lo hi")
def paired_bootstrap(spark, d):
    p = preds(spark, d)
    sums = p.groupBy(F.col("author").alias("unit")).agg(F.sum(F.col("correct").cast("double")).alias("num_a"), F.sum((F.col("true_label") == "en").cast("double")).alias("num_b"), F.count(F.lit(1)).cast("double").alias("den"))
    return RS.paired_difference(sums, RS.draw_table(spark, RS.units_of(sums), 100, by_choice=True))


@query()
def iid_bootstrap(spark, d):
    p = preds(spark, d)
    sums = RS.accuracy_sums(p, "author")
    return RS.bootstrap(sums, RS.draw_table(spark, RS.units_of(sums), 100)).withColumns({c: F.round(c, 6) for c in ("point", "lo", "hi")})


@query("SELECT -hi AS lo, -lo AS hi FROM (SELECT -0.1 AS lo, 0.3 AS hi)", "lo hi")
def flipped_interval(spark, d):
    lo, hi = RS.flip_interval(F.lit(-0.1), F.lit(0.3))
    return spark.range(1).select(lo.alias("lo"), hi.alias("hi"))
