"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The last of duplicate keys in a JSON object wins; otherwise such a text counts as invalid.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A row is a whole document: fewer rows per Arrow batch keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.hadoop.mapreduce.fileoutputcommitter.algorithm.version": "1",
}


def local_session(cpus: int | str = 8, app: str = "tunekit", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the same settings to submit."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
