"""Streaming forms: texts scored against fixed model tables, and windowed counts with late data.

An extension: the batch operators are the definition, a stream applies them to each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.functions import tokens as T
from quillmark.operators import attribution as A
from quillmark.operators import vocabulary as V


def scorer(stats: DataFrame, centroids: DataFrame, unit: str = "work_id") -> Callable[[DataFrame], DataFrame]:
    """A function of new texts (unit, text) to (unit, candidate, distance); the model tables are those of `delta_model`."""

    def score(rows: DataFrame) -> DataFrame:
        terms = T.words(F.col("text"))
        values = V.relative(V.counts(rows, terms, unit).join(F.broadcast(stats.select("term")), "term"), V.events(rows, terms, unit), unit)
        return A.nearest(A.delta_distances(V.zscores(values, stats, rows.select(unit), unit), centroids, unit=unit), unit)

    return score


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch scored and written under its number, so a batch that is repeated after a failure overwrites itself."""

    def write(rows: DataFrame, batch: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, key, n, total of tumbling windows; works on streams (with a watermark) and tables."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")
