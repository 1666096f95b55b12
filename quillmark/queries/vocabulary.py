"""Vocabularies, weights, folds and long feature relations over `documents` (author = source, work = doc_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import corpus as C
from quillmark.operators import vocabulary as V
from quillmark.plans import registry as R
from quillmark.queries.registry import documents, query, works


def parts(spark, d, most=150):
    """rows, counts, events, and the counts of the most frequent words."""
    rows = works(spark, d)
    terms = T.words(F.col("text"))
    table = V.hoisted(V.counts(rows, terms))
    sizes = V.sizes_of(table)
    vocab = V.most_frequent(table, most)
    return rows, table, sizes, vocab, table.join(F.broadcast(vocab.select("term")), "term")


def units(rows):
    return rows.select("work_id", "author").distinct()


MFW = "mfw AS (SELECT term, total, row_number() OVER (ORDER BY total DESC, term) AS rank FROM (SELECT term, sum(n) AS total FROM counts GROUP BY term) ORDER BY total DESC, term LIMIT 150)"
REL = f"{MFW}, rel AS (SELECT c.work_id, c.author, c.term, c.n / e.events AS value FROM counts c JOIN mfw USING (term) JOIN events e USING (work_id))"
STATS = f"{REL}, grid AS (SELECT u.work_id, u.author, m.term, coalesce(r.value, 0) AS value FROM (SELECT work_id, author FROM events) u CROSS JOIN mfw m LEFT JOIN rel r ON r.work_id = u.work_id AND r.term = m.term), stats AS (SELECT term, avg(value) AS mean, CASE WHEN min(value) = max(value) THEN 1e-9 ELSE stddev_pop(value) END AS std FROM grid GROUP BY term), z AS (SELECT work_id, author, term, (value - mean) / std AS z FROM grid JOIN stats USING (term))"


@query(f"WITH <works>, <counts>, {MFW} SELECT term, CAST(total AS BIGINT) AS total, rank FROM mfw")
def mfw_top(spark, d):
    return parts(spark, d)[3].withColumn("rank", F.col("rank").cast("long"))


WORK_VOCAB = "n AS (SELECT count(*) AS w FROM events), vocab AS (SELECT term, count(*) AS works, sum(n / events) / any_value(w) AS mean_share, ln((any_value(w) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM counts JOIN events USING (work_id), n GROUP BY term HAVING count(*) >= 2)"


@query(f"WITH <works>, <counts>, {WORK_VOCAB} SELECT term, works, mean_share, idf FROM vocab ORDER BY mean_share DESC, term LIMIT 300", "mean_share idf")
def work_vocabulary(spark, d):
    _, table, sizes, _, _ = parts(spark, d)
    return V.work_vocabulary(table, sizes, 300)


@query(f"WITH <works>, <counts>, {WORK_VOCAB} SELECT works, count(*) AS n_terms, any_value(idf) AS idf FROM vocab GROUP BY works", "idf")
def work_idf(spark, d):
    _, table, sizes, _, _ = parts(spark, d)
    return V.work_vocabulary(table, sizes).groupBy("works").agg(F.count(F.lit(1)).alias("n_terms"), F.max("idf").alias("idf"))


@query(f"WITH <works>, <counts>, {REL} SELECT work_id, term, value FROM rel", "value")
def relative_frequencies(spark, d):
    _, _, sizes, _, chosen = parts(spark, d)
    return V.relative(chosen, sizes)


@query(f"WITH <works>, <counts>, {MFW} SELECT work_id, term, n / sum(n) OVER (PARTITION BY work_id) AS value FROM counts JOIN mfw USING (term)", "value")
def selected_shares(spark, d):
    return V.selected_share(parts(spark, d)[4])


@query(f"WITH <works>, <counts>, {MFW}, df AS (SELECT term, count(*) AS df FROM counts JOIN mfw USING (term) GROUP BY term), n AS (SELECT count(DISTINCT work_id) AS n FROM counts JOIN mfw USING (term)), w AS (SELECT work_id, term, (1 + ln(c.n)) * (ln((n.n + 1.0) / (df + 1.0)) + 1) AS w FROM counts c JOIN df USING (term), n) SELECT work_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY work_id)) AS value FROM w", "value")
def tfidf_l2(spark, d):
    chosen = parts(spark, d)[4]
    return V.tfidf(chosen, V.pooled_vocabulary(chosen, 1))


@query(f"WITH <works>, <counts>, {STATS} SELECT term, mean, std FROM stats", "mean std")
def work_statistics(spark, d):
    rows, _, sizes, _, chosen = parts(spark, d)
    return V.statistics(V.relative(chosen, sizes), units(rows))


@query(f"WITH <works>, <counts>, {STATS} SELECT work_id, term, z FROM z", "z")
def zscores(spark, d):
    rows, _, sizes, _, chosen = parts(spark, d)
    values = V.relative(chosen, sizes)
    return V.zscores(values, V.statistics(values, units(rows)), units(rows))


@query(f"WITH <works>, <counts>, {REL} SELECT work_id, term, value / max(abs(value)) OVER (PARTITION BY term) AS value FROM rel", "value")
def max_abs_scale(spark, d):
    _, _, sizes, _, chosen = parts(spark, d)
    return V.max_abs(V.relative(chosen, sizes))


@query("WITH <works>, <counts> SELECT term, count(*) AS units FROM counts WHERE n > 0 GROUP BY term HAVING count(*) >= 5")
def presence_vocabulary(spark, d):
    return V.presence_vocabulary(parts(spark, d)[1], 5)


@query("WITH <works>, <counts>, c AS (SELECT author, term, sum(n) AS n FROM counts GROUP BY ALL), e AS (SELECT author, sum(events) AS events FROM events GROUP BY author) SELECT author, term, n / events AS value FROM c JOIN e USING (author) WHERE n >= 50", "value")
def grouped_relative(spark, d):
    rows = works(spark, d)
    terms = T.words(F.col("text"))
    table, sizes = V.counts(rows, terms, "author"), V.events(rows, terms, "author")
    return V.relative(table.where("n >= 50"), sizes, "author")


@query("WITH <works>, p AS (SELECT author, work_id, unnest(range(0, CAST(ceil(len(<space>) / 200) AS BIGINT))) AS ordinal FROM works WHERE len(<space>) > 0), k AS (SELECT author, work_id, count(*) AS chunks FROM p GROUP BY ALL), a AS (SELECT author, count(*) AS works FROM k GROUP BY author), t AS (SELECT sum(works) AS w, count(*) AS n FROM a) SELECT author, work_id, chunks, w / (n * works * chunks) AS weight FROM k JOIN a USING (author), t", "weight")
def work_weights(spark, d):
    chunks = C.chunk_by_words(works(spark, d), 200)
    return C.work_weights(chunks).groupBy("author", "work_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("weight").alias("weight"))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, sum(n) OVER () / (count(*) OVER () * n) AS class_weight FROM c", "class_weight")
def balanced_weights(spark, d):
    return C.balanced_weights(documents(spark, d), "lang").select("lang", "class_weight").distinct()


@query("WITH <works>, w AS (SELECT DISTINCT author, work_id FROM works) SELECT author, work_id, CAST((dense_rank() OVER (ORDER BY author) - 1 + row_number() OVER (PARTITION BY author ORDER BY work_id) - 1) % 5 AS INT) AS fold FROM w")
def round_robin_folds(spark, d):
    return C.round_robin_folds(works(spark, d), 5)


@query("WITH <works>, w AS (SELECT DISTINCT author, work_id FROM works), e AS (SELECT author FROM w GROUP BY author HAVING count(*) >= 2), l AS (SELECT author, dense_rank() OVER (ORDER BY author) - 1 AS label FROM (SELECT DISTINCT author FROM w)) SELECT row_number() OVER (ORDER BY w.author, w.work_id) - 1 AS fold, w.work_id, w.author, label FROM w JOIN e USING (author) JOIN l USING (author)")
def held_out_works(spark, d):
    out = C.held_out_works(works(spark, d))
    return out.select(F.col("fold").cast("long").alias("fold"), "work_id", "author", F.col("label").cast("long").alias("label"))


@query("SELECT coalesce(lang, '<missing>') AS level, (SELECT count(*) FROM documents) - count(*) AS n_train, count(*) AS n_test, (SELECT count(DISTINCT source) FROM documents) - count(DISTINCT source) FILTER (own = total) AS train_classes, count(DISTINCT source) FILTER (own = total) AS missing_classes FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS own, count(*) OVER (PARTITION BY source) AS total FROM documents) GROUP BY lang")
def factor_folds(spark, d):
    return C.factor_folds(documents(spark, d), "lang", "source")


@query("WITH c AS (SELECT lang AS level, source AS grp, count(*) AS n_test FROM documents GROUP BY ALL), x AS (SELECT *, sum(n_test) OVER (PARTITION BY level) + sum(n_test) OVER (PARTITION BY grp) - n_test AS either, sum(n_test) OVER () AS t FROM c) SELECT level, grp, n_test, CAST(t - either AS BIGINT) AS n_train, CAST(either - n_test AS BIGINT) AS n_purged FROM x")
def purged_cells(spark, d):
    return C.purged_cells(documents(spark, d), "lang", "source")


@query("SELECT doc_id AS work_id, min(source) AS author FROM documents GROUP BY doc_id")
def work_authors(spark, d):
    return C.work_authors(works(spark, d)).join(documents(spark, d).select(F.col("doc_id").alias("work_id")), "work_id", "right").select("work_id", "author")


@query("SELECT DISTINCT source AS author FROM documents WHERE source NOT IN ('src0', 'src1') AND trim(text) <> ''")
def author_list(spark, d):
    return C.authors_of(works(spark, d), ["src0", "src1"])


@query()
def corpus_digest(spark, d):
    return C.digest(works(spark, d), "author", "work_id", "text")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'only_left' ELSE 'changed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR length(d.text) + l.toxic <> d.n_chars")
def snapshot_differences(spark, d):
    rows = documents(spark, d)
    later = rows.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", (F.length("text") + F.col("toxic")).cast("long").alias("n_chars"))
    return C.differences(rows, later, "doc_id", "n_chars")


@query("WITH <works>, <counts>, band AS (SELECT term FROM (SELECT term, row_number() OVER (ORDER BY sum(n) DESC, term) AS r FROM counts GROUP BY term) WHERE r BETWEEN 101 AND 150) SELECT e.work_id, coalesce(k, 0) / 50 AS share FROM events e LEFT JOIN (SELECT work_id, count(DISTINCT term) AS k FROM counts JOIN band USING (term) GROUP BY work_id) USING (work_id)", "share")
def mfw_tail_presence(spark, d):
    from quillmark.operators import attribution as A

    rows, table, _, vocab, _ = parts(spark, d)
    return A.tail_presence(table, vocab, 101, 150, units(rows))


@query()
def hashed_counts(spark, d):
    return V.hashed(parts(spark, d)[1], 1 << 18).groupBy("work_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("n"))


@query()
def feature_blocks(spark, d):
    rows = works(spark, d)
    blocks = R.block_registry(R.Config().overlay(char_most=500), ("function_words", "length", "punctuation"))
    return R.features(rows, blocks).groupBy("work_id").agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("value"), 6).alias("total"))


@query()
def truncated_svd(spark, d):
    _, _, sizes, _, chosen = parts(spark, d, 50)
    return V.truncated_svd(V.relative(chosen, sizes), 5).withColumn("value", F.round("value", 6))
