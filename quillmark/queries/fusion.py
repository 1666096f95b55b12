"""Fusion of score channels, losses, agreement and blind-benchmark scores, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import benchmark as B
from quillmark.operators import metrics as M
from quillmark.operators import models as MO
from quillmark.operators import segments as S
from quillmark.queries.evaluation import MARKED, PREDS, SCORES, preds, scores
from quillmark.queries.registry import documents, query


@query(f"WITH {SCORES} SELECT work_id, true_label, label, p / sum(p) OVER (PARTITION BY work_id) AS p FROM sc WHERE label IN ('de', 'en')", "p")
def restricted_scores(spark, d):
    return S.restrict(scores(spark, d), ["de", "en"], ["work_id"])


@query(f"WITH {SCORES}, e AS (SELECT work_id, label, exp(5 * p - max(5 * p) OVER (PARTITION BY work_id)) AS e FROM sc) SELECT work_id, label, e / sum(e) OVER (PARTITION BY work_id) AS p FROM e", "p")
def softmax_channel(spark, d):
    return MO.softmax_scores(scores(spark, d).withColumn("score", 5 * F.col("p")).drop("p", "true_label"), ["work_id"]).select("work_id", "label", "p")


#: Two channels: shares of telling letters, and the guess made of them with all of the mass.
CHANNELS = f"{PREDS}, {SCORES}, ch AS (SELECT 'letters' AS channel, work_id AS unit, label, p FROM sc UNION ALL SELECT 'guess', sc.work_id, sc.label, CAST(sc.label = preds.pred_label AS DOUBLE) FROM sc JOIN preds USING (work_id))"


def channels(spark, d):
    s = scores(spark, d).select(F.lit("letters").alias("channel"), F.col("work_id").alias("unit"), "label", F.col("p").cast("double").alias("p"))
    g = s.join(preds(spark, d).select(F.col("work_id").alias("unit"), "pred_label"), "unit").select(F.lit("guess").alias("channel"), "unit", "label", (F.col("label") == F.col("pred_label")).cast("double").alias("p"))
    return s.unionByName(g)


@query(f"WITH {CHANNELS} SELECT unit, label, avg(p) AS p FROM ch GROUP BY unit, label", "p")
def channel_mean(spark, d):
    return MO.mean_channels(channels(spark, d))


@query(f"WITH {CHANNELS}, top AS (SELECT channel, unit, arg_max(label, p) AS pred FROM (SELECT * FROM ch ORDER BY label) GROUP BY ALL), best AS (SELECT channel, unit, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY channel, unit ORDER BY p DESC, label) AS r FROM ch) WHERE r = 1), acc AS (SELECT channel, power(greatest(avg(CAST(pred = true_label AS INT)) - 0.25, 0), 6) AS w FROM best JOIN preds ON best.unit = preds.work_id GROUP BY channel), w AS (SELECT channel, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 1 / count(*) OVER () END AS w FROM acc) SELECT unit, label, sum(w * p) AS p FROM ch JOIN w USING (channel) GROUP BY unit, label", "p")
def reliable_fusion(spark, d):
    rows = channels(spark, d)
    best = M.stable_top(rows.withColumn("key", F.concat_ws("/", "channel", F.col("unit").cast("string"))), 1, "key")
    hit = best.join(preds(spark, d).select(F.col("work_id").alias("unit"), "true_label"), "unit")
    accuracy = hit.groupBy("channel").agg(F.avg((F.col("label") == F.col("true_label")).cast("double")).alias("accuracy"))
    return MO.reliable_channels(rows, accuracy, 0.25)


TRUE_P = f"{SCORES}, own AS (SELECT sc.work_id, d.source AS author, -ln(greatest(p, 1e-12)) AS loss FROM sc JOIN documents d ON d.doc_id = sc.work_id WHERE label = true_label)"


def true_scores(spark, d):
    rows = scores(spark, d).where("label = true_label")
    return rows.join(documents(spark, d).select(F.col("doc_id").alias("work_id"), F.col("source").alias("author")), "work_id").select("work_id", "author", "p")


@query(f"WITH {TRUE_P} SELECT avg(loss) AS nll FROM own", "nll")
def true_label_loss(spark, d):
    return MO.nll(true_scores(spark, d))


@query(f"WITH {TRUE_P} SELECT avg(l) AS nll FROM (SELECT avg(loss) AS l FROM own GROUP BY author)", "nll")
def work_loss(spark, d):
    return MO.nll(true_scores(spark, d), "author")


@query(f"WITH {TRUE_P}, m AS (SELECT 'letters' AS method, avg(loss) AS nll FROM own UNION ALL SELECT 'even', ln(4)) SELECT arg_min(method, nll) AS chosen FROM m")
def calibrator_choice(spark, d):
    losses = MO.nll(true_scores(spark, d)).select(F.lit("letters").alias("method"), "nll").union(spark.range(1).select(F.lit("even"), F.log(F.lit(4.0))))
    return spark.createDataFrame([(MO.choose_calibrator(losses, 2, 3),)], "chosen string")


@query("WITH s AS (SELECT doc_id AS work_id, lang AS label, doc_id % 3 AS split FROM documents) SELECT k AS split, CASE WHEN s.split = k THEN 'validation' ELSE 'train' END AS role, count(*) AS n, count(DISTINCT label) AS n_classes, count(DISTINCT label) = 4 AS complete FROM s CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL")
def split_preflight(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("work_id"), F.col("lang").alias("label"))
    splits = rows.select("work_id", F.explode(F.array(*map(F.lit, range(3)))).alias("split")).withColumn("role", F.when(F.col("work_id") % 3 == F.col("split"), "validation").otherwise("train"))
    return MO.split_report(rows, splits, 4)


@query(f"WITH {MARKED} SELECT avg(CAST(true_label = pred_label AS INT)) AS agreement FROM marked", "agreement")
def label_agreement(spark, d):
    p = preds(spark, d)
    return S.agreement(p.select("work_id", F.col("true_label").alias("label")), p.select("work_id", F.col("pred_label").alias("label")), ["work_id"])


@query("WITH r AS (SELECT d.lang AS author, d.source AS work, l.quality = 1 AS ok FROM documents d JOIN labels l USING (doc_id)), w AS (SELECT author, work, 2 * count(*) FILTER (ok) > count(*) AS hit FROM r GROUP BY ALL), a AS (SELECT author, avg(CAST(hit AS INT)) AS r FROM w GROUP BY author) SELECT avg(r) AS mean, median(r) AS median, min(r) AS lowest, count(*) AS authors FROM a", "mean median lowest")
def author_recall_summary(spark, d):
    r = documents(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select(F.col("lang").alias("author"), F.col("source").alias("work_id"), (F.col("quality") == 1).alias("correct"))
    return M.recalls(r).agg(F.avg("work_recall").alias("mean"), F.percentile("work_recall", F.lit(0.5)).alias("median"), F.min("work_recall").alias("lowest"), F.count(F.lit(1)).alias("authors"))


#: ln n! over a table of counts, so the terms are exact to double precision.
@query(f"WITH {MARKED}, n AS (SELECT count(*) FILTER (g AND correct) AS a, count(*) FILTER (g AND NOT correct) AS b, count(*) FILTER (NOT g AND correct) AS c, count(*) FILTER (NOT g AND NOT correct) AS d FROM (SELECT *, hash_ AS g FROM (SELECT *, work_id % 2 = 0 AS hash_ FROM marked))), x AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM n), t AS (SELECT *, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - (a + c - x) + 1) AS w FROM x), m AS (SELECT *, max(w) FILTER (x = a) OVER () AS own, max(w) OVER () AS top FROM t) SELECT any_value(a) * any_value(d) / (any_value(b) * any_value(c)) AS odds, sum(exp(w - top)) FILTER (w <= own + 1e-7) / sum(exp(w - top)) AS p FROM m", "odds p")
def fisher_exact(spark, d):
    p, g, ok = preds(spark, d), F.col("work_id") % 2 == 0, F.col("correct")
    a, b, c, e = p.agg(*(F.sum(x.cast("long")) for x in (g & ok, g & ~ok, ~g & ok, ~g & ~ok))).first()
    return spark.createDataFrame([M.fisher_p(a, b, c, e)], "odds double, p double")


@query(f"WITH {SCORES} SELECT DISTINCT work_id FROM sc WHERE work_id % 7 = 0")
def inconsistent_records(spark, d):
    ranks = M.worst_tie_rank(scores(spark, d))
    stated = ranks.withColumn("correct", F.col("pred_label") == F.col("true_label")).withColumn("rank", F.when(F.col("work_id") % 7 == 0, F.col("rank") + 9).otherwise(F.col("rank")))
    return M.inconsistent(stated, ranks)


# Blind benchmark: documents with a truth, a submission that lacks some and adds others.
TRUTH = f"{PREDS}, truth AS (SELECT 'doc_' || right(md5(CAST(doc_id AS VARCHAR)), 16) AS doc_id, doc_id AS n, lang AS author_label FROM documents), sub AS (SELECT truth.doc_id, pred_label AS author_label FROM truth JOIN preds ON work_id = n WHERE n % 5 > 0 UNION ALL SELECT 'doc_extra' || n, 'en' FROM truth WHERE n % 50 = 0 UNION ALL SELECT truth.doc_id, 'en' FROM truth WHERE n % 50 = 1)"


def blind(spark, d):
    rows = documents(spark, d)
    key = F.concat(F.lit("doc_"), F.right(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(16)))
    truth = rows.select(key.alias("doc_id"), F.col("doc_id").alias("n"), F.col("lang").alias("author_label"))
    guess = truth.join(preds(spark, d).select(F.col("work_id").alias("n"), "pred_label"), "n").where("n % 5 > 0").select("doc_id", F.col("pred_label").alias("author_label"))
    extra = truth.where("n % 50 = 0").select(F.concat(F.lit("doc_extra"), F.col("n").cast("string")).alias("doc_id"), F.lit("en").alias("author_label"))
    return truth, guess, guess.unionByName(extra).unionByName(truth.where("n % 50 = 1").select("doc_id", F.lit("en").alias("author_label")))


@query(f"WITH {TRUTH}, t AS (SELECT doc_id, count(*) AS t FROM truth GROUP BY 1), s AS (SELECT doc_id, count(*) AS s FROM sub GROUP BY 1), j AS (SELECT doc_id, CASE WHEN s IS NULL THEN 'missing' WHEN t IS NULL THEN 'extra' WHEN s > 1 OR t > 1 THEN 'repeated' END AS side FROM t FULL JOIN s USING (doc_id)) SELECT * FROM j WHERE side IS NOT NULL")
def submission_ids(spark, d):
    truth, _, submission = blind(spark, d)
    return B.id_findings(truth, submission)


@query(f"WITH {TRUTH}, j AS (SELECT t.author_label AS t, p.pred_label AS g FROM truth t LEFT JOIN preds p ON p.work_id = t.n AND t.n % 5 > 0), k AS (SELECT DISTINCT t AS label FROM j), f AS (SELECT label, count(*) FILTER (t = label AND g = label) AS tp, count(*) FILTER (t = label) AS nt, count(*) FILTER (g = label) AS np FROM k, j GROUP BY label) SELECT (SELECT count(*) FROM j) AS n, (SELECT avg(CAST(g IS NOT NULL AS INT)) FROM j) AS coverage, (SELECT avg(CAST(t IS NOT DISTINCT FROM g AS INT)) FROM j) AS accuracy, (SELECT avg(2 * tp / (nt + np)) FROM f) AS macro_f1", "coverage accuracy macro_f1")
def benchmark_score(spark, d):
    truth, guess, _ = blind(spark, d)
    return B.classification(truth, guess, "author_label")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 11 = 1 THEN 'digest' ELSE 'span_beyond' END AS problem FROM documents WHERE doc_id % 11 IN (0, 1) OR (doc_id % 11 = 2 AND length(text) IS NOT NULL)")
def artifact_check(spark, d):
    rows = documents(spark, d)
    own = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2(F.when(F.col("doc_id") % 11 == 1, "other").otherwise(F.col("text")), 256).alias("sha256"), F.array(F.struct(F.lit(0).alias("start"), (F.length("text") + (F.col("doc_id") % 11 == 2).cast("int")).alias("end"), F.lit("a").alias("label"))).alias("spans"))
    return B.artifact_findings(own, rows.where("doc_id % 11 > 0").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


ROLES = "own AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS sha256, CASE doc_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'test' ELSE 'blind:' || doc_id END AS role FROM documents), first AS (SELECT sha256, role, min(doc_id) AS doc_id FROM own GROUP BY ALL)"


@query(f"WITH {ROLES} SELECT DISTINCT least(l.doc_id, r.doc_id) AS a, greatest(l.doc_id, r.doc_id) AS b, 'sha256' AS by FROM own l JOIN first r ON l.sha256 = r.sha256 AND l.role <> r.role")
def role_isolation(spark, d):
    split = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "test").otherwise("blind")
    own = documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), split.alias("split"), F.md5("text").alias("sha256"), *(F.lit(None).cast("string").alias(c) for c in ("text_path", "source_id", "revision", "work")))
    return B.role_leaks(own)


@query("WITH j AS (SELECT source AS author, doc_id AS work_id, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'not_public' WHEN source = 'src3' THEN 'excluded' WHEN coalesce(CASE WHEN doc_id % 4 > 0 THEN lang END, 'unknown') = 'unknown' THEN 'no_source' END AS reason FROM documents), n AS (SELECT author, count(*) AS n FROM j WHERE reason IS NULL GROUP BY author) SELECT author, work_id, coalesce(reason, CASE WHEN coalesce(n, 0) < 20 THEN 'few_books' END) AS reason, coalesce(reason, CASE WHEN coalesce(n, 0) < 20 THEN 'few_books' END) IS NULL AS kept FROM j LEFT JOIN n USING (author)")
def benchmark_package(spark, d):
    rows = documents(spark, d)
    return B.package(rows.select(F.col("source").alias("author"), F.col("doc_id").alias("work_id")), rows.where("doc_id % 4 > 0").select(F.col("doc_id").alias("work_id"), F.col("lang").alias("source")), ["src0", "src1", "src2", "src3"], ["src3"], 20)
