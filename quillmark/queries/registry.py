"""How queries are registered: a function of (spark, sf_dir), SQL over the same tables, and the columns of floats to round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import corpus as C
from quillmark.sources.files import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fragments of SQL that many queries share.
SQL = {
    "works": "works AS (SELECT source AS author, doc_id AS work_id, text FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND trim(text) <> '')",
    "tok": r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')",
    "alpha": r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '\p{L}+'))",
    "sents": r"list_filter(list_transform(regexp_extract_all(text, '[^.!?…\n]+[.!?…]*'), lambda s: trim(s)), lambda s: s <> '')",
    "space": r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')",
    "counts": r"counts AS (SELECT work_id, author, term, count(*) AS n FROM (SELECT work_id, author, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM works) GROUP BY ALL), events AS (SELECT work_id, any_value(author) AS author, sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS events FROM works GROUP BY work_id)",
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.works(documents(spark, sf_dir))


def query(sql: str | None = None, floats: str = "") -> Callable:
    """Registers a function under its name; `floats` are rounded to six places on both sides."""
    names = floats.split()

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c).cast("double"), 6) + 0.0 for c in names}) if names else out

        QUERIES[fn.__name__] = run
        if sql is not None:
            text = sql
            for k, v in SQL.items():
                text = text.replace(f"<{k}>", v)
            rounded = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in names)
            ORACLE_SQL[fn.__name__] = f"SELECT * REPLACE ({rounded}) FROM ({text})" if names else text
        return fn

    return register
