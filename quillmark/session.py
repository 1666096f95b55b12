"""Session factory used by tests, the bench and ad-hoc scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "quillmark", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution on. Where the program was submitted to a cluster, or SPARK_MASTER names one, its
    configuration stands: only the time zone and what the caller passes are set."""
    settings = {"spark.sql.session.timeZone": "UTC"}
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" not in os.environ and not os.environ.get("SPARK_MASTER"):
        settings |= {
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.enabled": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        }
        builder = builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
    elif os.environ.get("SPARK_MASTER"):
        builder = builder.master(os.environ["SPARK_MASTER"])
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
