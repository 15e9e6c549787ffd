"""Run and file summaries. Every counting pre-aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.operators.inference import error_class

ERRORS_SHOWN = 5
NO_CONTENT = "No content to process"


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def generation_summary(entries: DataFrame, total_requested: int) -> DataFrame:
    """One row: entries made, entries asked for, rate in percent (0 when none were asked for)."""
    made = F.count(F.lit(1))
    asked = F.lit(total_requested).cast("bigint")
    return entries.agg(
        made.alias("success_count"),
        asked.alias("total_requested"),
        percent(made, asked).alias("success_rate"),
    )


def augmentation_summary(rows: DataFrame, error: str = "error") -> DataFrame:
    """One row: total, successes, failures, rate in percent."""
    total, failed = F.count(F.lit(1)), F.count(F.col(error))
    return rows.agg(
        total.alias("total_entries"),
        (total - failed).alias("success_count"),
        failed.alias("failure_count"),
        percent(total - failed, total).alias("success_rate"),
    )


def first_errors(
    rows: DataFrame, order: tuple[str, ...], n: int = ERRORS_SHOWN, error: str = "error"
) -> DataFrame:
    """First ``n`` failure messages in row order."""
    return rows.filter(F.col(error).isNotNull()).orderBy(*order).limit(n).select(*order, error)


def errors_by_class(rows: DataFrame, error: str = "error") -> DataFrame:
    """Failures per class with one sample message."""
    per_message = (
        rows.filter(F.col(error).isNotNull()).groupBy(error).agg(F.count(F.lit(1)).alias("n"))
    )
    return per_message.groupBy(error_class(F.col(error)).alias("error_class")).agg(
        F.sum("n").alias("n"), F.min(error).alias("sample")
    )


def file_results(
    files: DataFrame,
    chunks: DataFrame,
    entries: DataFrame,
    key: str = "source_path",
    order: str = "chunk_index",
    error: str = "error",
    errors_kept: int | None = None,
) -> DataFrame:
    """Per file: chunks processed, entries generated, error count, errors in chunk order, success.

    All errors of a file are listed, at most one per chunk; ``errors_kept`` keeps only the first ones.

    ``files`` and ``chunks`` may carry an ``error`` column. All counts come from one grouping with
    partial aggregation, so a file with most of the chunks shuffles one row per task. A file
    without chunks has failed; so has one with any failed chunk.
    """
    none = F.lit(None).cast("string")
    failed = F.col(error) if error in chunks.columns else none
    own = F.col(error) if error in files.columns else none

    def counted(df: DataFrame, is_chunk: bool, is_bad: Column) -> DataFrame:
        return df.select(key, F.lit(is_chunk).alias("_chunk"), is_bad.alias("_bad"))

    # Only counters in this grouping: a text aggregate would make Spark sort every row first.
    counts = (
        counted(chunks, True, failed.isNotNull())
        .unionByName(counted(entries, False, F.lit(False)))
        .groupBy(key)
        .agg(
            F.count_if("_chunk").alias("_chunks"),
            F.count_if(~F.col("_chunk")).alias("_entries"),
            F.count_if("_bad").alias("_bad_chunks"),
        )
    )
    bad = chunks.select(key, F.col(order).alias("_order"), failed.alias("_error")).filter(F.col("_error").isNotNull())
    if errors_kept is not None:
        # row_number <= k is cut down inside each task before the shuffle, so a hot file sends k rows.
        rank = F.row_number().over(Window.partitionBy(key).orderBy("_order"))
        bad = bad.withColumn("_rank", rank).filter(F.col("_rank") <= errors_kept).drop("_rank")
    samples = bad.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_order", "_error"))).alias("_samples")
    )
    whole_file = F.coalesce(
        F.col("_file_error"), F.when(F.col("chunks_processed") == 0, NO_CONTENT)
    )
    shown = F.coalesce(
        F.transform("_samples", lambda s: s["_error"]), F.array().cast("array<string>")
    )
    zero = F.lit(0).cast("bigint")
    return (
        files.select(key, own.alias("_file_error"))
        .join(counts, key, "left")
        .join(samples, key, "left")
        .withColumn("chunks_processed", F.coalesce("_chunks", zero))
        .withColumn("entries_generated", F.coalesce("_entries", zero))
        .select(
            key,
            "chunks_processed",
            "entries_generated",
            (
                F.coalesce("_bad_chunks", zero) + F.when(whole_file.isNotNull(), 1).otherwise(0)
            ).alias("error_count"),
            F.when(whole_file.isNotNull(), F.array(whole_file)).otherwise(shown).alias("errors"),
        )
        .withColumn("success", F.col("error_count") == 0)
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over :func:`file_results`: files, successes, failures, entries, rate in percent."""
    total, good = F.count(F.lit(1)), F.count_if("success")
    return results.agg(
        total.alias("total_files"),
        good.alias("successful_files"),
        (total - good).alias("failed_files"),
        F.coalesce(F.sum("entries_generated"), F.lit(0)).alias("total_entries"),
        percent(good, total).alias("success_rate"),
    )
