"""Small tables about running jobs: progress by wave, and pass rates that one run leaves to the next.

Both are Parquet folders that get one row a wave or run, written when it is over, so they can be read
while a job goes on and after a driver is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PROGRESS = "job string, wave int, sent long, failed long, checked long, passed long, seconds double, at timestamp"
RATES = "model string, dataset_type string, locale string, checked long, passed long, rate double, at timestamp"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def record_progress(
    spark: SparkSession, path: str, job: str, wave: int, sent: int, failed: int, seconds: float, checked: int | None = None, passed: int | None = None
) -> None:
    _append(spark, path, PROGRESS, (job, wave, sent, failed, checked, passed, float(seconds), _now()))


def progress_of(spark: SparkSession, path: str) -> DataFrame:
    """The waves so far, with ``rate``: requests a second."""
    rows = _rows(spark, path, PROGRESS)
    return rows.withColumn("rate", F.try_divide(F.col("sent").cast("double"), F.col("seconds")))


def progress_writer(spark: SparkSession, path: str, job: str) -> Callable[[int, int, int, float], None]:
    """Something to call with (wave, sent, failed, seconds)."""
    return lambda wave, sent, failed, seconds: record_progress(spark, path, job, wave, sent, failed, seconds)


def store_pass_rate(spark: SparkSession, path: str, model: str, dataset_type: str, locale: str, checked: int, passed: int, rate: float) -> None:
    _append(spark, path, RATES, (model, dataset_type, locale, checked, passed, float(rate), _now()))


def stored_pass_rate(spark: SparkSession, path: str | None, model: str, dataset_type: str, locale: str, default: float) -> float:
    """The rate that the last run of this model, type and locale left."""
    if path is None:
        return default
    same = (F.col("model") == model) & (F.col("dataset_type") == dataset_type) & (F.col("locale") == locale)
    last = _rows(spark, path, RATES).filter(same).agg(F.max_by("rate", "at")).first()[0]
    return default if last is None else last
