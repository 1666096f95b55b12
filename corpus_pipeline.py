"""A corpus pipeline out of the training-data operators: documents in, packed sequences out.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's
docs. All but the last keep the columns of `documents`. Null and empty texts go in the first stage; texts of any length pass
whole; of repeated rows the second stage keeps one; rows without an id go through like others; an empty table makes empty results
everywhere; columns of the input other than those of `documents` are kept up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontamination, packing, quality, secret_scan, simhash
from quillmark.llm.common import shared_dir, table
from quillmark.llm.queries import tokenizer_path


LEAST_WORDS = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the quality rules keep; verdicts are made where the row is, so nothing is joined back. A short text is
    no bad one as such (those labelled good are as often short as others), so the rule on words asks for one shingle of the
    next stage, and the forest judges the rest."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), least_words=LEAST_WORDS)
    return quality.keep(docs, model, LEAST_WORDS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (shingles of five words; a Jaccard similarity of 0.8 or more, or at most four
    differing bits of 64): the one with the smallest doc_id; one without a doc_id only where its group has no other."""
    return simhash.drop_near_duplicates(docs, shingle=5, radius=4, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by [KIND] and n_chars of the text that remains."""
    return secret_scan.redact_secrets(docs, secret_scan.fit(docs)).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_path(), 4096, 2), 4096)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL has no isolation forest, Hamming ball, template windows, Markov models or histogram packing: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result goes through Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
