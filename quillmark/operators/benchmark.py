"""Blind benchmarks: manifest rules as findings, truth and submissions as relations, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import metrics as M
from quillmark.operators import segments as S

# Which truth fields a task may and must have.
TASKS = {
    "spoof": {"allowed": ["author_label", "document_label"], "any": ["author_label", "document_label"], "all": []},
    "idio_shift": {"allowed": ["author_label", "spans"], "any": [], "all": ["spans"]},
    "mixed_authorship": {"allowed": ["spans"], "any": [], "all": ["spans"]},
}
DOC_ID = r"^doc_[0-9a-f]{16,64}$"
SHA256 = r"^[0-9a-f]{64}$"
SPAN = "struct<start: int, end: int, label: string>"
DOCUMENT = f"doc_id string, split string, task_types array<string>, source_id string, revision string, sha256 string, work string, text_path string, spans array<{SPAN}>"
TRUTH = f"doc_id string, author_label string, document_label string, spans array<{SPAN}>"


def endpoint_matrix(spark) -> DataFrame:
    """task, field, allowed, required."""
    rows = [(t, f, f in r["allowed"], f in r["all"]) for t, r in TASKS.items() for f in ("author_label", "document_label", "spans")]
    return spark.createDataFrame(rows, "task string, field string, allowed boolean, required boolean")


def manifest_findings(documents: DataFrame, declared: list[str]) -> DataFrame:
    """doc_id, problem: bad ids and digests, repeated ids, unknown splits and tasks, tasks without a document, bad spans, and whatever
    crosses roles that must be apart. documents as in DOCUMENT."""
    rules = {"doc_id": ~F.col("doc_id").rlike(DOC_ID), "sha256": ~F.col("sha256").rlike(SHA256), "split": ~F.col("split").isin("train", "validation", "test", "blind"), "no_task": F.size("task_types") < 1, "unknown_task": F.size(F.array_except("task_types", F.array(*map(F.lit, declared)))) > 0}
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    own = documents.select("doc_id", F.explode(found).alias("problem"))
    twice = documents.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("repeated_id").alias("problem"))
    used = documents.select(F.explode("task_types").alias("t")).distinct()
    idle = documents.sparkSession.createDataFrame([(t,) for t in declared], "t string").join(used, "t", "left_anti").select(F.lit(None).cast("string").alias("doc_id"), F.concat(F.lit("unused_task:"), "t").alias("problem"))
    spans = documents.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")
    bad = S.span_problems(spans).select("doc_id", F.concat(F.lit("span_"), "problem").alias("problem"))
    crossed = role_leaks(documents).select(F.col("a").alias("doc_id"), F.concat(F.lit("crosses_roles:"), "by").alias("problem"))
    return reduce(DataFrame.unionByName, [own, twice, idle, bad, crossed])


def role_leaks(documents: DataFrame) -> DataFrame:
    """a, b, by: documents of isolated roles that share bytes, path, source revision or work. Equal-key joins, one for each key; training
    and validation may share, all else may not. Links go to the first document of a key and role, which connects all."""
    keys = {"sha256": F.col("sha256"), "text_path": F.col("text_path"), "revision": F.when(F.col("source_id").isNotNull() & F.col("revision").isNotNull(), F.concat_ws("\u0001", "source_id", "revision")), "work": F.col("work")}
    role = F.when(F.col("split").isin("train", "validation"), F.lit("development")).when(F.col("split") == "blind", F.concat(F.lit("blind:"), "doc_id")).otherwise(F.col("split"))
    out = None
    for name, key in keys.items():
        own = documents.select(key.alias("k"), role.alias("role"), "doc_id").where("k is not null")
        first = own.groupBy("k", "role").agg(F.min("doc_id").alias("doc_id"))
        pairs = own.alias("l").join(first.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("l.role") != F.col("r.role")))
        part = pairs.select(F.least("l.doc_id", "r.doc_id").alias("a"), F.greatest("l.doc_id", "r.doc_id").alias("b"), F.lit(name).alias("by")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def truth_findings(truth: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, problem: fields that no task of the document allows, required ones that are missing, spans that end before the text."""
    matrix = endpoint_matrix(truth.sparkSession)
    has = {"author_label": F.col("author_label").isNotNull(), "document_label": F.col("document_label").isNotNull(), "spans": F.size(F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))) > 0}
    fields = truth.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c.alias("has")) for f, c in has.items()))).alias("x")).select("doc_id", "x.*")
    per = documents.select("doc_id", F.explode("task_types").alias("task")).join(F.broadcast(matrix), "task").groupBy("doc_id", "field").agg(F.bool_or("allowed").alias("allowed"), F.bool_or("required").alias("required"))
    problem = F.when(F.col("has") & ~F.col("allowed"), F.concat(F.lit("not_allowed:"), "field")).when(~F.col("has") & F.col("required"), F.concat(F.lit("missing:"), "field"))
    return fields.join(per, ["doc_id", "field"]).select("doc_id", problem.alias("problem")).where("problem is not null")


def id_findings(truth: DataFrame, submission: DataFrame) -> DataFrame:
    """doc_id, side of documents that only one side has, and repeated ones."""
    j = truth.groupBy("doc_id").agg(F.count(F.lit(1)).alias("t")).join(submission.groupBy("doc_id").agg(F.count(F.lit(1)).alias("s")), "doc_id", "full_outer")
    side = F.when(F.col("s").isNull(), "missing").when(F.col("t").isNull(), "extra").when((F.col("s") > 1) | (F.col("t") > 1), "repeated")
    return j.select("doc_id", side.alias("side")).where("side is not null")


def artifact_findings(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, problem: texts (doc_id, text) whose digest differs or that are missing, and spans beyond them."""
    j = documents.join(texts, "doc_id", "left")
    problem = F.when(F.col("text").isNull(), "missing").when(F.sha2("text", 256) != F.col("sha256"), "digest").when(F.array_max(F.transform("spans", lambda s: s["end"])) > F.length("text"), "span_beyond")
    return j.select("doc_id", problem.alias("problem")).where("problem is not null")


def committed(payload: bytes, sha256: str) -> bytes:
    """The payload, if it is the one committed to."""
    import hashlib

    if hashlib.sha256(payload).hexdigest() != sha256:
        raise ValueError("truth differs from its commitment")
    return payload


def classification(truth: DataFrame, submission: DataFrame, field: str) -> DataFrame:
    """n, coverage, accuracy, macro_f1 over documents whose truth has the field; classes are those of the truth."""
    j = truth.where(F.col(field).isNotNull()).select("doc_id", F.col(field).alias("true_label")).join(submission.select("doc_id", F.col(field).alias("pred_label")), "doc_id", "left")
    labels = j.select(F.col("true_label").alias("label")).distinct()
    return M.abstaining(j, labels).crossJoin(j.agg(F.count(F.lit(1)).alias("n"))).select("n", "coverage", "accuracy", "macro_f1")


def spans_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")


def score(truth: DataFrame, submission: DataFrame, work: DataFrame) -> DataFrame:
    """endpoint, metric, value: both classifications and the segmentation. work: doc_id, work_id."""
    out = []
    for field in ("author_label", "document_label"):
        c = classification(truth, submission, field)
        out.append(c.select(F.lit(field).alias("endpoint"), F.stack(F.lit(4), F.lit("n"), F.col("n").cast("double"), F.lit("coverage"), F.col("coverage"), F.lit("accuracy"), F.col("accuracy"), F.lit("macro_f1"), F.col("macro_f1")).alias("metric", "value")))
    seg = S.corpus_report(spans_of(truth), spans_of(submission), work)
    cols = seg.columns
    out.append(seg.select(F.lit("spans").alias("endpoint"), F.stack(F.lit(len(cols)), *(x for c in cols for x in (F.lit(c), F.col(c).cast("double")))).alias("metric", "value")))
    return reduce(DataFrame.unionByName, out)


def package(works: DataFrame, sources: DataFrame, public: list[str], exclude: list[str], least_books: int) -> DataFrame:
    """author, work_id, kept, reason: public-domain authors less exclusions; books without a known source go, then authors with too few
    books. works: author, work_id; sources: work_id, source."""
    j = works.join(sources, "work_id", "left")
    reason = F.when(~F.col("author").isin(public), "not_public").when(F.col("author").isin(exclude or [""]), "excluded").when(F.coalesce(F.col("source"), F.lit("unknown")) == "unknown", "no_source")
    j = j.withColumn("reason", reason)
    left = j.where("reason is null").groupBy("author").agg(F.count(F.lit(1)).alias("_n"))
    return j.join(left, "author", "left").select("author", "work_id", F.coalesce("reason", F.when(F.coalesce("_n", F.lit(0)) < least_books, "few_books")).alias("reason")).withColumn("kept", F.col("reason").isNull())
