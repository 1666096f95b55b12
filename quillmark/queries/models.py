"""Distances, centroids, held-out attribution, learned models and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import alignment as AL
from quillmark.operators import attribution as A
from quillmark.operators import chars as CH
from quillmark.operators import corpus as C
from quillmark.operators import delta as D
from quillmark.operators import models as ML
from quillmark.operators import overlap as O
from quillmark.operators import vocabulary as V
from quillmark.plans import analyze as AN
from quillmark.plans import cases as K
from quillmark.plans import registry as R
from quillmark.plans import verification as VF
from quillmark.queries.registry import query, works
from quillmark.queries.vocabulary import MFW, REL, STATS, WORK_VOCAB, parts, units

#: The first words by their mean share of a work, in place of the most frequent ones.
TOP_SHARES = f"{WORK_VOCAB}, mfw AS (SELECT term FROM vocab ORDER BY mean_share DESC, term LIMIT 150)"
DELTA = f"{STATS}, cent AS (SELECT author AS candidate, term, avg(z) AS c FROM z GROUP BY ALL), dist AS (SELECT work_id, author, candidate, avg(abs(z - c)) AS distance FROM z JOIN cent USING (term) GROUP BY ALL)"


@query(f"WITH <works>, <counts>, {DELTA}, b AS (SELECT work_id, author, candidate, distance, row_number() OVER (PARTITION BY work_id ORDER BY distance, candidate) AS r FROM dist) SELECT work_id, author, candidate, distance FROM b WHERE r = 1", "distance")
def delta_attribution(spark, d):
    return D.nearest(D.distances(D.space(works(spark, d), 150)))


@query(f"WITH <works>, <counts>, {DELTA} SELECT work_id, candidate, distance FROM dist", "distance")
def delta_manhattan(spark, d):
    return D.distances(D.space(works(spark, d), 150)).select("work_id", "candidate", "distance")


@query(f"WITH <works>, <counts>, {DELTA} SELECT work_id, candidate, 1 - sum(z * c) / (sqrt(sum(z * z)) * sqrt(sum(c * c))) AS distance FROM z JOIN cent USING (term) GROUP BY ALL", "distance")
def delta_cosine(spark, d):
    return D.distances(D.space(works(spark, d), 150), "cosine").select("work_id", "candidate", "distance")


@query(f"WITH <works>, <counts>, {DELTA}, e AS (SELECT work_id, candidate, exp(-distance + min(distance) OVER (PARTITION BY work_id)) AS e FROM dist) SELECT work_id, candidate, e / (sum(e) OVER (PARTITION BY work_id) + 1e-12) AS p FROM e", "p")
def delta_softmax(spark, d):
    return A.softmax(D.distances(D.space(works(spark, d), 150)), "work_id", "distance").select("work_id", "candidate", "p")


@query(f"WITH <works>, <counts>, {STATS}, s AS (SELECT author AS candidate, term, sum(z) AS s, count(*) AS n FROM z GROUP BY ALL), dist AS (SELECT work_id, z.author, candidate, avg(abs(z - CASE WHEN z.author = candidate THEN (s - z) / (n - 1) ELSE s / n END)) AS distance FROM z JOIN s USING (term) WHERE z.author <> candidate OR n > 1 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY distance, candidate) AS r FROM dist) SELECT work_id, author, candidate, distance FROM b WHERE r = 1", "distance")
def delta_held_out(spark, d):
    return D.nearest(D.distances(D.space(works(spark, d), 150), held_out=True))


NEAREST = "b AS (SELECT work_id, candidate, distance, row_number() OVER (PARTITION BY work_id ORDER BY distance, candidate) AS r FROM dist) SELECT work_id, candidate, distance FROM b WHERE r = 1"


@query(f"WITH <works>, <counts>, {DELTA.replace(MFW, TOP_SHARES)}, {NEAREST}", "distance")
def delta_work_vocabulary(spark, d):
    return D.nearest(D.distances(D.space(works(spark, d), 150, vocabulary="work"))).drop("author")


@query(f"WITH <works>, <counts>, {DELTA.replace('c.n / e.events', 'c.n / sum(c.n) OVER (PARTITION BY c.work_id)')}, {NEAREST}", "distance")
def delta_selected_mass(spark, d):
    return D.nearest(D.distances(D.space(works(spark, d), 150, denominator="selected"))).drop("author")


UNIT = "unit AS (SELECT work_id, author, term, value / sqrt(sum(value * value) OVER (PARTITION BY work_id)) AS value FROM rel)"


@query(f"WITH <works>, <counts>, {REL}, {UNIT}, m AS (SELECT author AS candidate, term, sum(value) AS s FROM unit GROUP BY ALL), cent AS (SELECT candidate, term, s / sqrt(sum(s * s) OVER (PARTITION BY candidate)) AS c FROM m) SELECT work_id, candidate, sum(value * c) AS score FROM unit JOIN cent USING (term) GROUP BY ALL", "score")
def cosine_centroids(spark, d):
    rows, _, sizes, _, chosen = parts(spark, d)
    values = V.relative(chosen, sizes)
    return A.cosine_scores(values, A.cosine_centroids(values, units(rows)))


@query(f"WITH <works>, <counts>, {REL}, {UNIT}, m AS (SELECT author AS candidate, term, sum(value) AS s FROM unit GROUP BY ALL), n AS (SELECT author AS candidate, count(DISTINCT work_id) AS n FROM works GROUP BY author), x AS (SELECT u.work_id, u.author, m.candidate, u.term, u.value, CASE WHEN u.author = m.candidate THEN s - u.value ELSE s END AS c FROM unit u JOIN m USING (term)), q AS (SELECT candidate, sum(s * s) AS q FROM m GROUP BY ALL), dots AS (SELECT work_id, author, candidate, sum(value * c) AS dot, sum(value * (c + CASE WHEN author = candidate THEN value ELSE 0 END)) AS whole FROM x GROUP BY ALL) SELECT work_id, author, candidate, dot / CASE WHEN author = candidate THEN sqrt(q - 2 * whole + 1) ELSE sqrt(q) END AS score FROM dots JOIN q USING (candidate) JOIN n USING (candidate) WHERE author <> candidate OR n > 1", "score")
def cosine_held_out(spark, d):
    rows, _, sizes, _, chosen = parts(spark, d)
    return A.held_out_cosine(V.relative(chosen, sizes), units(rows))


CHAR = r"ch AS (SELECT work_id, author, term, count(*) AS n FROM (SELECT work_id, author, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS term FROM (SELECT work_id, author, regexp_replace(lower(text), '\s\s+', ' ', 'g') AS t FROM works)) GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM ch GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 1000), nn AS (SELECT count(DISTINCT work_id) AS k FROM ch), w AS (SELECT work_id, author, term, (1 + ln(n)) * (ln((k + 1.0) / (df + 1.0)) + 1) AS w FROM ch JOIN v USING (term), nn), rel AS (SELECT work_id, author, term, w / sqrt(sum(w * w) OVER (PARTITION BY work_id)) AS value FROM w)"


@query(f"WITH <works>, {CHAR}, m AS (SELECT author AS candidate, term, sum(value) AS s FROM rel GROUP BY ALL), cent AS (SELECT candidate, term, s / sqrt(sum(s * s) OVER (PARTITION BY candidate)) AS c FROM m), sc AS (SELECT work_id, candidate, sum(value * c) AS score FROM rel JOIN cent USING (term) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, candidate) AS r FROM sc) SELECT work_id, candidate, score FROM b WHERE r = 1", "score")
def char_cosine(spark, d):
    return CH.nearest_trigrams(works(spark, d), 1000)


@query("WITH <works> SELECT author, count(*) AS count FROM works GROUP BY author ORDER BY count(*) DESC, author LIMIT 1")
def majority(spark, d):
    return A.majority(works(spark, d))


@query()
def model_comparison(spark, d):
    return AN.sweep_table(AN.evaluate(works(spark, d), ["delta:150", "delta_cos:150", "char_cos", "majority"]), "delta:150")


@query()
def impostors(spark, d):
    rows = works(spark, d)
    terms = T.words(F.col("text"))
    table, sizes = V.counts(rows, terms, "author"), V.events(rows, terms, "author")
    vocab = V.most_frequent(table, 300).select("term")
    return A.impostors(V.relative(table.join(F.broadcast(vocab), "term"), sizes, "author"), "src0", "src1")


def labelled_vectors(spark, d):
    rows = works(spark, d)
    _, _, sizes, vocab, chosen = parts(spark, d, 100)
    labels = C.with_labels(units(rows))
    size = 100
    return ML.vectors(V.max_abs(V.relative(chosen, sizes)), ML.indexed(vocab), size, C.balanced_weights(labels).withColumnRenamed("class_weight", "weight"))


@query()
def logistic_regression(spark, d):
    rows = labelled_vectors(spark, d).cache()
    p = ML.probabilities(ML.logistic(rows), rows)
    return p.withColumn("p", F.round("p", 4))


@query()
def kmeans_silhouette(spark, d):
    """Two clusters of the labels' mean vectors: units are the panel's members, not its rows."""
    from pyspark.ml.functions import array_to_vector

    u = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode("embedding").alias("i", "v"))
    means = u.groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
    out = ML.kmeans(means.select(F.col("label").alias("unit"), "x", array_to_vector("x").alias("features")), 2)
    return ML.silhouette(out.select("unit", "x", "cluster")).withColumn("silhouette", F.round("silhouette", 6))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings WHERE vec_id IS NOT NULL), u AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e), c AS (SELECT label AS candidate, i, avg(v) AS c FROM u GROUP BY ALL), s AS (SELECT vec_id, candidate, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) AS score FROM u JOIN c USING (i) GROUP BY ALL) SELECT vec_id, candidate, score FROM s", "score")
def embedding_centroids(spark, d):
    u = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = u.groupBy(F.col("label").alias("candidate"), "i").agg(F.avg("v").alias("c"))
    return u.join(F.broadcast(c), "i").groupBy("vec_id", "candidate").agg((F.sum(F.col("v") * F.col("c")) / (F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.sum(F.col("c") * F.col("c"))))).alias("score"))


@query()
def edition_residual(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("unit"), F.col("label").cast("string").alias("work_id"), (F.col("vec_id") % 2).cast("string").alias("domain"), F.col("embedding").cast("array<double>").alias("x"))
    directions = ML.residual_projection(rows)
    return ML.residualised(rows, directions).select("unit", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), 6).alias("square"))


@query()
def compression_ranking(spark, d):
    rows = works(spark, d)
    first = F.broadcast(rows.agg(F.min("work_id").alias("work_id")))  # one number
    target = rows.join(first, "work_id").limit(1)
    references = rows.join(first, "work_id", "left_anti").select(F.col("author").alias("candidate_id"), "work_id", "text")
    return AL.compression_ranking(target, references).withColumn("score", F.round("score", 6))


@query()
def edition_alignment(spark, d):
    rows = works(spark, d)
    """Every work against a variant with a foreword; a pair has its work's id, which tells works apart."""
    a = rows.select(F.col("work_id").alias("pair_id"), F.col("text").alias("text_a"), F.concat(F.lit("Preface of the editor. "), F.col("text")).alias("text_b"))
    return AL.coverage(a, AL.aligned_blocks(a, 20)).withColumns({c: F.round(c, 6) for c in ("coverage_a", "coverage_b", "coverage")})


@query()
def case_passport(spark, d):
    rows = works(spark, d)
    chunks = C.chunk_by_words(rows, 500).withColumn("work_id", F.concat_ws("/", "author", F.col("work_id").cast("string"))).withColumn("chunk_id", F.concat_ws("#", "work_id", F.col("ordinal").cast("string")))
    panel = tuple(r.author for r in C.authors_of(rows).collect())  # the closed panel's names
    return K.passport_row(spark, K.run(spark, chunks, K.CaseSpec("all sources", panel, feature_sets=("fw_fixed",))))


@query("SELECT 100 * (0.45 * 0.9 + 0.25 * least(1, greatest(0, -log10(0.01) / 3)) + 0.2 * 0.5 + 0.1 * least(1, 0.02 / 0.05) - 0.1) AS score", "score")
def evidence_score(spark, d):
    v = [F.lit(x) for x in (0.9, 0.01, 0.5, 0.02, 2)]
    return spark.range(1).select(K.evidence_score(*v).alias("score"))


@query()
def analyze(spark, d):
    rows = O.first_of_equal(works(spark, d), F.col("text"), "work_id").withColumn("work_id", F.col("work_id").cast("string"))
    lone = rows.where(F.length("text") > 2000).agg(F.max("work_id")).first()[0]
    return AN.delta_ranking(C.chunk_by_words(rows, 500).withColumn("chunk_id", F.concat_ws("#", "work_id", F.col("ordinal").cast("string"))), rows.where(F.col("work_id") != lone), lone, 150).withColumns({c: F.round(c, 6) for c in ("distance", "margin")})


@query()
def model_registry(spark, d):
    return spark.createDataFrame([(m.key, m.pattern, m.needs_works, m.deployable, m.confirmatory) for m in R.MODELS], "key string, pattern string, needs_works boolean, deployable boolean, confirmatory boolean")


@query()
def verification_features(spark, d):
    rows = works(spark, d)
    return VF.pair_features(rows, VF.pairs(rows)).withColumns({c: F.round(c, 6) for c in VF.PAIR})
