"""Sources and sinks: tables written to a shared folder and read back, beside SQL over what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.queries.evaluation import PREDS, preds
from quillmark.queries.registry import documents, query, works
from quillmark.sources import files as FS

WORKS = "works AS (SELECT source AS author, CAST(doc_id AS VARCHAR) AS name, text FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND trim(text) <> '')"
HALVES = f"{WORKS}, halves AS (SELECT author, name, unnest([0, 1]) AS half, trim(unnest([substr(text, 1, length(text) // 2), substr(text, length(text) // 2 + 1)])) AS text FROM works), pieces AS (SELECT author, name, row_number() OVER (PARTITION BY author, name ORDER BY half) - 1 AS ordinal, text FROM halves WHERE text <> '')"


def named(spark, d):
    return works(spark, d).select("author", F.col("work_id").cast("string").alias("name"), "text")


def tree(spark, rows):
    """rows(path, text) as files below a new folder."""
    root = FS.scratch(spark, "tree")
    FS.write_tree(rows, root)
    return root


def pieces(spark, d):
    """path, text of two halves of each work, as author/work/chunk.txt."""
    n = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.struct(F.lit("000.txt").alias("chunk"), F.trim(F.substring("text", F.lit(1), n)).alias("text")), F.struct(F.lit("001.txt").alias("chunk"), F.trim(F.substring("text", n + 1, F.length("text"))).alias("text")))
    return named(spark, d).select("author", "name", F.inline(halves)).where("text <> ''").select(F.concat_ws("/", "author", "name", "chunk").alias("path"), "author", "name", "chunk", "text")


@query(f"WITH {WORKS} SELECT author, author || '/' || name AS work_id, md5(text) AS digest FROM works")
def scan_raw_corpus(spark, d):
    root = tree(spark, named(spark, d).select(F.concat(F.concat_ws("/", "author", "name"), F.lit(".txt")).alias("path"), "text"))
    return FS.raw_corpus(spark, root).select("author", "work_id", F.md5("text").alias("digest"))


@query(f"WITH {HALVES} SELECT author, CAST(dense_rank() OVER (ORDER BY author) - 1 AS INT) AS label, author || '/' || name AS work_id, CAST(ordinal AS INT) AS ordinal, md5(text) AS digest FROM pieces WHERE author <> 'src1'")
def scan_fragments(spark, d):
    root = tree(spark, pieces(spark, d).select("path", "text"))
    return FS.load(spark, root, "legacy", exclude=["src1"]).select("author", "label", "work_id", "ordinal", F.md5("text").alias("digest"))


@query(f"WITH {HALVES} SELECT author, name AS work_id, CAST(half AS INT) AS ordinal, md5(text) AS digest FROM halves WHERE text <> ''")
def scan_manifest_fragments(spark, d):
    rows = pieces(spark, d)
    root = tree(spark, rows.select("path", "text"))
    manifest = rows.select(F.col("name").alias("work_id"), "author", F.substring("chunk", 1, 3).cast("int").alias("span_ordinal"), F.sha2("text", 256).alias("text_sha256"), "path")
    manifest.write.json(f"{root}/manifest.json")
    return FS.load(spark, root, "work_balanced").select("author", "work_id", "ordinal", F.md5("text").alias("digest"))


@query(f"WITH {WORKS} SELECT name || '.txt' AS name, md5(trim(text)) AS digest FROM works")
def scan_unknown_texts(spark, d):
    root = tree(spark, named(spark, d).select(F.concat(F.lit("unknown/"), "name", F.lit(".txt")).alias("path"), "text"))
    return FS.unknown_fragments(spark, root).select("name", F.md5("text").alias("digest"))


@query(f"WITH {PREDS} SELECT CAST(work_id AS VARCHAR) AS work_id, author, CAST(length(true_label) AS INT) AS true_label, CAST(ascii(pred_label) AS INT) AS pred_label FROM preds")
def predictions_round_trip(spark, d):
    path = FS.scratch(spark, "predictions")
    FS.csv_sink(preds(spark, d).select(F.col("work_id").cast("string").alias("work_id"), "author", F.length("true_label").alias("true_label"), F.ascii("pred_label").alias("pred_label")), path)
    return FS.predictions_csv(spark, path)


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_round_trip(spark, d):
    rows, path = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text"), FS.scratch(spark, "json")
    FS.json_column(rows).write.text(path)
    return FS.json_rows(spark, path, rows.schema).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(f"WITH {WORKS} SELECT name AS work_id, sha256(replace(replace(text, 'ё', 'е'), 'Ё', 'Е')) AS output_sha256 FROM works")
def clean_snapshot(spark, d):
    from quillmark.functions import text as X

    return FS.write_snapshot(named(spark, d).select(F.col("name").alias("work_id"), X.fold_yo(F.col("text")).alias("text")), FS.scratch(spark, "clean"))


@query(f"WITH {HALVES} SELECT author || '/' || name || '/' || half AS work_id, sha256(text) AS output_sha256 FROM halves WHERE text <> ''")
def fragment_snapshot(spark, d):
    return FS.write_snapshot(pieces(spark, d).select(F.concat_ws("/", "author", "name", F.substring("chunk", 3, 1)).alias("work_id"), "text"), FS.scratch(spark, "fragments"))


@query("SELECT doc_id, length(text) AS n_chars_counted FROM documents WHERE text IS NOT NULL")
def cached_features(spark, d):
    rows = documents(spark, d).where("text is not null").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    build = lambda r: r.select("text_sha256", F.length("text").cast("long").alias("n_chars_counted"))
    _, cache = FS.cached(rows.where("doc_id % 2 = 0"), None, build)
    path = FS.scratch(spark, "cache")
    cache.write.parquet(path)
    full, missing = FS.cached(rows, spark.read.parquet(path), build)
    missing.write.mode("append").parquet(f"{path}-more")
    return full.select("doc_id", "n_chars_counted")


@query("SELECT lang, count(*) AS n, sum(n_chars) AS n_chars FROM documents GROUP BY lang")
def model_round_trip(spark, d):
    table = documents(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    root = FS.scratch(spark, "model")
    return FS.load_model(spark, root, ["languages"], FS.publish_model({"languages": table}, root))["languages"]


@query("SELECT doc_id, '# ' || doc_id || chr(10) || '- **Language**: ' || coalesce(lang, 'none') || chr(10) || '- **Source**: ' || coalesce(source, 'none') AS page FROM documents")
def markdown_pages(spark, d):
    return FS.markdown(documents(spark, d).select("doc_id", "lang", "source"), "doc_id", {"lang": "Language", "source": "Source"})
