"""The Spark session with the settings that the library's jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "claimweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments override (``_`` for ``.``)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",  # texts are long: a batch is to stay some MB
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
