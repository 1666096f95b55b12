"""Duplicates, overlap, containment and contamination over `documents` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import overlap as O
from quillmark.queries.registry import documents, query, works


def rows_of(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("work_id"), "text")


@query("SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_groups(spark, d):
    return O.exact_groups(rows_of(spark, d))


@query("SELECT first, doc_id AS copy FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first")
def exact_copies(spark, d):
    return O.exact_copies(rows_of(spark, d))


NORMAL = "d0 AS (SELECT doc_id, text, <tok> AS w FROM documents), d1 AS (SELECT doc_id, text, w FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id) AS r FROM d0) WHERE r = 1)"


@query(f"""WITH {NORMAL}, g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' ')), list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS term FROM d1),
c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id), o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS overlap FROM c x JOIN c y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, CAST(overlap AS BIGINT) AS overlap, overlap / least(sa.total, sb.total) AS coverage FROM o JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE overlap / least(sa.total, sb.total) >= 0.4""", "coverage")
def near_duplicates(spark, d):
    return O.near_duplicates(rows_of(spark, d))


JOINED = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*')"
SETS = f"""d1 AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), w AS (SELECT doc_id, {JOINED} AS w FROM d1), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS term FROM w), s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id HAVING count(*) >= 20),
inside AS (SELECT x.doc_id AS short, y.doc_id AS long, count(*) AS common, any_value(sx.size) AS size FROM g x JOIN g y ON x.term = y.term AND x.doc_id <> y.doc_id JOIN s sx ON sx.doc_id = x.doc_id JOIN s sy ON sy.doc_id = y.doc_id WHERE sx.size < sy.size OR (sx.size = sy.size AND x.doc_id < y.doc_id) GROUP BY x.doc_id, y.doc_id HAVING count(*) * 10 >= any_value(sx.size) * 9)"""


@query(f"WITH {SETS} SELECT short, long, common, size FROM inside")
def containment(spark, d):
    return O.containment(rows_of(spark, d))


@query(f"WITH {SETS}, n AS (SELECT {JOINED} AS w, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY w HAVING count(*) > 1) SELECT 'identical' AS kind, CAST(min(doc_id) AS VARCHAR) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'normalised', CAST(first AS VARCHAR), n FROM n UNION ALL SELECT 'contained', CAST(short AS VARCHAR), count(*) FROM inside GROUP BY short")
def content_inventory(spark, d):
    return O.components_inventory(rows_of(spark, d))


@query("WITH p AS (SELECT first AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first) SELECT a, b, CASE WHEN x.source <> y.source THEN 'error' ELSE 'warn' END AS severity FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b")
def duplicate_findings(spark, d):
    pairs = O.exact_copies(rows_of(spark, d)).select(F.col("first").alias("a"), F.col("copy").alias("b"))
    return O.findings_of(pairs, works(spark, d).select("work_id", "author"))


@query(r"""WITH b AS (SELECT item_id AS sent_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark), g AS (SELECT sent_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM b WHERE len(w) >= 5), k AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM (SELECT <tok> AS w FROM documents)) SELECT sent_id, avg(CASE WHEN k.g IS NULL THEN 0 ELSE 1 END) AS share FROM g LEFT JOIN k ON g.g = k.g GROUP BY sent_id""", "share")
def benchmark_contamination(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("sent_id"), "text")
    return O.novelty(items, documents(spark, d).select("text"))


@query(r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark), g AS (SELECT item_id, len(w) AS words, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM b WHERE len(w) >= 4), k AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM (SELECT <tok> AS w FROM documents)), f AS (SELECT item_id, any_value(words) AS words, avg(CASE WHEN k.g IS NULL THEN 0 ELSE 1 END) AS share FROM g LEFT JOIN k ON g.g = k.g GROUP BY item_id) SELECT sum(share * words) / sum(words) AS found FROM f""", "found")
def fragment_containment(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("frag_id"), "text")
    return O.fragment_containment(items, documents(spark, d).select("text"))


@query("SELECT b.doc_id AS other FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE a.doc_id = (SELECT min(first) FROM (SELECT min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1))")
def target_overlap(spark, d):
    rows = rows_of(spark, d)
    pairs = O.exact_copies(rows).select(F.col("first").alias("a"), F.col("copy").alias("b"))
    target = pairs.agg(F.min("a")).first()[0]
    return O.target_overlap(pairs, target, rows.where(F.col("work_id") != target)).select("other")
