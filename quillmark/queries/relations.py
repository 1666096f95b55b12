"""Timelines, runs and spans over `conversations` and `events`, and relational controls over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators import segments as S
from quillmark.queries.registry import query
from quillmark.sources import files as FS
from quillmark.streaming import scoring as ST


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("unit"), (F.row_number().over(w) - 1).alias("ordinal"), F.col("event_type").alias("label"), F.col("value").alias("p"))


EV = "ev AS (SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal, event_type AS label, value AS p FROM events)"
RUNS = f"{EV}, g AS (SELECT *, ordinal - row_number() OVER (PARTITION BY unit, label ORDER BY ordinal) AS k FROM ev), runs AS (SELECT unit, label, min(ordinal) AS start, max(ordinal) AS \"end\", count(*) AS length, avg(p) AS mean_p FROM g GROUP BY unit, label, k)"


@query(f"WITH {RUNS} SELECT unit, label, start, \"end\", length, mean_p FROM runs", "mean_p")
def event_runs(spark, d):
    return S.runs(events(spark, d)).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(f"WITH {RUNS} SELECT unit, label, start, \"end\", length, mean_p FROM runs WHERE label <> 'click' AND length >= 2 AND mean_p >= 20", "mean_p")
def foreign_runs(spark, d):
    return S.foreign_runs(events(spark, d), "click", 20.0, 2).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(f"WITH {EV} SELECT unit, avg(CASE WHEN label <> 'click' THEN 1 ELSE 0 END) AS fraction FROM ev GROUP BY unit", "fraction")
def foreign_fraction(spark, d):
    return S.foreign_fraction(events(spark, d), "click")


@query(f"WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n, least(5, CASE WHEN count(*) OVER (PARTITION BY unit) % 2 = 1 THEN count(*) OVER (PARTITION BY unit) ELSE count(*) OVER (PARTITION BY unit) - 1 END) AS k FROM ev), pad AS (SELECT a.unit, a.ordinal, avg(b.p) AS smooth FROM (SELECT *, unnest(range(-(greatest(k, 1) - 1) // 2, (greatest(k, 1) - 1) // 2 + 1)) AS o FROM n) a JOIN ev b ON b.unit = a.unit AND b.ordinal = greatest(0, least(a.n - 1, a.ordinal + a.o)) GROUP BY ALL) SELECT unit, ordinal, smooth FROM pad", "smooth")
def rolling_mean(spark, d):
    return S.rolling_mean(events(spark, d), 5).select("unit", F.col("ordinal").cast("long").alias("ordinal"), "smooth")


@query(f"WITH {EV}, f AS (SELECT unit, avg(CASE WHEN label <> 'click' THEN 1 ELSE 0 END) AS fraction FROM ev GROUP BY unit) SELECT count(*) AS n, avg(fraction) AS mean, coalesce(stddev_samp(fraction), 0) AS std FROM f", "mean std")
def null_summary(spark, d):
    return S.null_summary(S.foreign_fraction(events(spark, d), "click"))


@query(f"WITH {EV}, f AS (SELECT unit, avg(CASE WHEN label <> 'click' THEN 1 ELSE 0 END) AS fraction FROM ev GROUP BY unit) SELECT (1 + count(*) FILTER (fraction >= 0.9)) / (1 + count(*)) AS p FROM f", "p")
def empirical_p(spark, d):
    return S.empirical_p(S.foreign_fraction(events(spark, d), "click"), 0.9)


def spans(spark, d, label):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.greatest(F.length("text"), F.lit(1))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.sum(n).over(w) - n).alias("start"), F.sum(n).over(w).alias("end"), label.alias("label"))
    return rows


def truth(spark, d):
    return spans(spark, d, F.col("role"))


def guess(spark, d):
    return S.canonical(spans(spark, d, F.when(F.length("text") > 200, "assistant").otherwise("user")))


SPANS = """sp AS (SELECT conv_id AS doc_id, role, text, sum(greatest(length(text), 1)) OVER w AS "end", greatest(length(text), 1) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT doc_id, CAST("end" - n AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", role AS label FROM sp), p0 AS (SELECT doc_id, CAST("end" - n AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CASE WHEN length(text) > 200 THEN 'assistant' ELSE 'user' END AS label FROM sp),
p1 AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS k FROM (SELECT *, coalesce(label = lag(label) OVER w2 AND start = lag("end") OVER w2, false) AS same FROM p0 WINDOW w2 AS (PARTITION BY doc_id ORDER BY start))),
p AS (SELECT doc_id, min(start) AS start, max("end") AS "end", any_value(label) AS label FROM p1 GROUP BY doc_id, k)"""


@query(f"WITH {SPANS} SELECT doc_id, start, \"end\", label FROM p")
def canonical_spans(spark, d):
    return guess(spark, d)


OVER = f"{SPANS}, o AS (SELECT t.doc_id, t.label AS true_label, p.label AS pred_label, CAST(sum(least(t.\"end\", p.\"end\") - greatest(t.start, p.start)) AS BIGINT) AS n FROM t JOIN p ON t.doc_id = p.doc_id AND t.start < p.\"end\" AND p.start < t.\"end\" GROUP BY ALL)"


@query(f"WITH {OVER} SELECT * FROM o")
def span_overlaps(spark, d):
    return S.overlaps(truth(spark, d), guess(spark, d))


@query(f"WITH {OVER}, nt AS (SELECT doc_id, label, sum(\"end\" - start) AS nt FROM t GROUP BY ALL), np AS (SELECT doc_id, label, sum(\"end\" - start) AS np FROM p GROUP BY ALL), j AS (SELECT doc_id, label, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(o.n, 0) AS tp FROM nt FULL JOIN np USING (doc_id, label) LEFT JOIN (SELECT doc_id, true_label AS label, n FROM o WHERE true_label = pred_label) o USING (doc_id, label)) SELECT doc_id, sum(tp) / sum(nt) AS accuracy, avg(2 * tp / (nt + np)) AS macro_f1 FROM j GROUP BY doc_id", "accuracy macro_f1")
def position_accuracy(spark, d):
    return S.position_accuracy(truth(spark, d), guess(spark, d))


BOUND = f"{SPANS}, bt AS (SELECT doc_id, start AS pos FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY start) AS l FROM t) WHERE l IS NOT NULL), bp AS (SELECT doc_id, start AS pos FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY start) AS l FROM p) WHERE l IS NOT NULL), c AS (SELECT x.doc_id, (SELECT count(*) FROM bt JOIN bp USING (doc_id, pos) WHERE doc_id = x.doc_id) AS tp, (SELECT count(*) FROM bp WHERE doc_id = x.doc_id) AS n_pred, (SELECT count(*) FROM bt WHERE doc_id = x.doc_id) AS n_true FROM (SELECT DISTINCT doc_id FROM t) x), r AS (SELECT *, CASE WHEN n_pred = 0 THEN 1 ELSE tp / n_pred END AS precision, CASE WHEN n_true = 0 THEN 1 ELSE tp / n_true END AS recall FROM c)"


@query(f"WITH {BOUND} SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r", "precision recall f1")
def boundaries_exact(spark, d):
    return S.boundary_scores(truth(spark, d), guess(spark, d))


PLACES = f"{SPANS}, bt AS (SELECT doc_id, start AS pos, l, label AS r FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY start) AS l FROM t) WHERE l IS NOT NULL), bp AS (SELECT doc_id, start AS pos, l, label AS r FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY start) AS l FROM p) WHERE l IS NOT NULL), docs AS (SELECT DISTINCT doc_id FROM t)"
PRF = "SELECT doc_id, tp, n_pred, n_true, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT *, CASE WHEN n_pred = 0 THEN 1 ELSE tp / n_pred END AS precision, CASE WHEN n_true = 0 THEN 1 ELSE tp / n_true END AS recall FROM (SELECT doc_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_pred FROM bp GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_true FROM bt GROUP BY 1) USING (doc_id)))"


@query(f"WITH {PLACES}, sides AS (SELECT docs.doc_id, coalesce((SELECT list(pos ORDER BY pos) FROM bt WHERE bt.doc_id = docs.doc_id), []::BIGINT[]) AS a, coalesce((SELECT list(pos ORDER BY pos) FROM bp WHERE bp.doc_id = docs.doc_id), []::BIGINT[]) AS b FROM docs), hits AS (SELECT doc_id, list_reduce(list_prepend([0, 0]::BIGINT[], list_transform(a, lambda x: [x]::BIGINT[])), lambda s, x: CASE WHEN len(list_filter(range(s[1], len(b)), lambda j: abs(b[j + 1] - x[1]) <= 40)) > 0 THEN [list_filter(range(s[1], len(b)), lambda j: abs(b[j + 1] - x[1]) <= 40)[1] + 1, s[2] + 1]::BIGINT[] ELSE s END)[2] AS tp FROM sides) {PRF}", "precision recall f1")
def boundaries_within(spark, d):
    return S.boundary_scores(truth(spark, d), guess(spark, d), 40)


@query(f"WITH {PLACES}, hits AS (SELECT doc_id, count(*) AS tp FROM bt JOIN bp USING (doc_id, pos, l, r) GROUP BY doc_id) {PRF}", "precision recall f1")
def boundaries_labelled(spark, d):
    return S.boundary_scores(truth(spark, d), guess(spark, d), 0, labelled=True)


IOU = f"{SPANS}, iou AS (SELECT t.doc_id, t.start AS t_start, p.start AS p_start, (least(t.\"end\", p.\"end\") - greatest(t.start, p.start)) / (t.\"end\" - t.start + p.\"end\" - p.start - (least(t.\"end\", p.\"end\") - greatest(t.start, p.start))) AS iou FROM t JOIN p ON t.doc_id = p.doc_id AND t.label = p.label AND t.start < p.\"end\" AND p.start < t.\"end\")"


@query(f"WITH {IOU} SELECT doc_id, t_start, p_start, iou FROM iou", "iou")
def span_ious(spark, d):
    return S.span_ious(truth(spark, d), guess(spark, d))


@query(f"WITH {IOU}, h AS (SELECT doc_id, count(*) AS tp, sum(iou) AS s FROM iou WHERE iou >= 0.6 GROUP BY doc_id), n AS (SELECT doc_id, (SELECT count(*) FROM t WHERE t.doc_id = x.doc_id) AS n_true, (SELECT count(*) FROM p WHERE p.doc_id = x.doc_id) AS n_pred FROM (SELECT DISTINCT doc_id FROM t) x), r AS (SELECT doc_id, coalesce(tp, 0) AS tp, n_true, n_pred, coalesce(tp, 0) / n_pred AS precision, coalesce(tp, 0) / n_true AS recall, coalesce(s / tp, 0) AS mean_iou, coalesce(s, 0) / greatest(n_true, n_pred) AS penalised_iou FROM n LEFT JOIN h USING (doc_id)) SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r", "precision recall f1 mean_iou penalised_iou")
def segment_scores(spark, d):
    return S.segment_scores(truth(spark, d), guess(spark, d), 0.6)


@query()
def segment_scores_matched(spark, d):
    return S.segment_scores(truth(spark, d), guess(spark, d), 0.3).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "mean_iou", "penalised_iou")})


@query()
def label_mapping(spark, d):
    anonymous = guess(spark, d).withColumn("label", F.when(F.col("label") == "user", "cluster_a").otherwise("cluster_b"))
    return S.label_mapping(truth(spark, d), anonymous)


@query(f"WITH {OVER}{BOUND[len(SPANS):]}, one AS (SELECT doc_id FROM t GROUP BY doc_id HAVING count(DISTINCT label) = 1), cut AS (SELECT doc_id, count(DISTINCT label) > 1 AS split FROM p JOIN one USING (doc_id) GROUP BY doc_id), fpr AS (SELECT coalesce(avg(CAST(split AS INT)), 0) AS f FROM cut), s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_true) AS BIGINT) AS n_true FROM c), b AS (SELECT *, CASE WHEN n_pred = 0 THEN 1 ELSE tp / n_pred END AS pr, CASE WHEN n_true = 0 THEN 1 ELSE tp / n_true END AS re FROM s) SELECT (SELECT sum(n) FILTER (true_label = pred_label) FROM o) / (SELECT sum(\"end\" - start) FROM t) AS accuracy, tp, n_pred, n_true, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS boundary_f1, f AS document_fpr, f AS work_fpr FROM b, fpr", "accuracy boundary_f1 document_fpr work_fpr")
def segmentation_report(spark, d):
    work = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("conv_id").cast("string").alias("work_id")).distinct()
    return S.corpus_report(truth(spark, d), guess(spark, d), work)


@query(f"WITH {SPANS} SELECT doc_id, start, 'gap' AS problem FROM (SELECT *, lag(\"end\") OVER (PARTITION BY doc_id ORDER BY start) AS b FROM t) WHERE b < start")
def span_problems(spark, d):
    return S.span_problems(truth(spark, d), contiguous=True)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", "total")
def windowed_events(spark, d):
    return ST.windowed(table(spark, d, "events"))


@query("WITH n AS (SELECT source AS author, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 5 ORDER BY count(*) DESC, source LIMIT 3) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents JOIN n ON n.author = source) WHERE r <= 5")
def top_authors(spark, d):
    return FS.top_authors(table(spark, d, "documents"), 3, 5, "source", "doc_id").select("doc_id")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL", "sum_qty revenue")
def grouped_totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "total")
def joined_totals(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
