"""Incremental document and dataset jobs on Structured Streaming.

The batch operators up to quality control are row-local, so they run on streams unchanged; the
checkpoint records which files are done.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tunekit.operators.inference import Model, infer
from tunekit.operators.limits import head_rows
from tunekit.operators.parsing import Parsers, parse_documents
from tunekit.plans.jobs import DocumentJob, chunk_requests, document_entries
from tunekit.sources.datasets import parse_lines, read_dataset
from tunekit.sources.documents import stream_documents
from tunekit.sources.writers import write_dataset


def stream_chunks(
    spark: SparkSession,
    path: str,
    job: DocumentJob | None = None,
    pattern: str | None = None,
    parsers: Parsers | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """Prompted chunks of new files. Files that fail to parse are left out, the stream goes on."""
    job = job or DocumentJob()
    files = stream_documents(spark, path, pattern, parsers, max_files)
    parsed = parse_documents(files, parsers, html_method=job.html_method)
    return chunk_requests(parsed.filter(F.col("error").isNull()), job)


def stream_entries(chunks: DataFrame, model: Model, job: DocumentJob | None = None) -> DataFrame:
    """Entries of streamed chunks: the model runs inside the stream."""
    return document_entries(infer(chunks, model), job or DocumentJob())


def stream_jsonl(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Free-form rows of new JSON Lines files, bad lines marked."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", str(max_files)).text(path))


def stream_table(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", max_files: int = 1000
) -> DataFrame:
    """Rows of new files of a mirrored dataset, ``max_files`` per micro-batch."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", str(max_files))
        .load(path)
    )


def append_parquet(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append exactly once, stop."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )


def append_dataset(
    df: DataFrame, target: str, fmt: str, checkpoint: str, max_entries: int | None = None, stream_id: str | None = None
) -> StreamingQuery:
    """Append each micro-batch in any dataset format, for any number of streams into one target.

    A batch has a folder of its own, named by the stream and its number, and a row in the target's
    ledger once its rows are there. A batch that is replayed writes its folder anew if the ledger
    doesn't have it, and does nothing if it has; so nothing is lost or doubled, and
    :func:`read_appended` never shows half a batch. A stream is known by the id that its checkpoint
    keeps, or by ``stream_id`` (letters, digits, ``-`` and ``_``), which then must belong to one checkpoint.

    ``max_entries`` rows of a stream are kept, over all its batches and restarts; batches after that are
    not evaluated, so their files aren't opened.
    """
    if max_entries is not None and max_entries < 1:
        raise ValueError("max_entries must be positive")
    if stream_id is not None and not re.fullmatch(r"[A-Za-z0-9_-]+", stream_id):
        raise ValueError("stream_id must consist of letters, digits, - and _")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = stream_id or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        done = {r["batch"]: r["rows"] for r in _ledger_of(spark, target, stream).collect()} if max_entries or batch_id else {}
        if batch_id in done or not _ledger_of(spark, target, stream, batch_id).isEmpty():
            return
        if max_entries is not None:
            left = max_entries - sum(done.values())
            if left <= 0:
                return
            batch = head_rows(batch, left)
        seen, began = Observation(), time.monotonic()
        failed = F.count("error") if "error" in batch.columns else F.count(F.lit(None))
        counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"), failed.alias("failed"))
        write_dataset(counted, _folder(target, stream, batch_id), fmt, mode="overwrite", allow_empty=True)
        found = (seen.get["rows"], seen.get["failed"] or 0, time.monotonic() - began, datetime.now(timezone.utc))
        row = spark.createDataFrame([(stream, batch_id, *found)], LEDGER).coalesce(1)
        row.write.mode("overwrite").parquet(f"{target}/_ledger/stream={stream}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


LEDGER = "stream string, batch long, rows long, failed long, seconds double, at timestamp"


def _folder(target: str, stream: str, batch: int) -> str:
    return f"{target}/stream={stream}/batch={batch}"


def _ledger_of(spark: SparkSession, target: str, stream: str | None = None, batch: int | None = None) -> DataFrame:
    place = f"{target}/_ledger" + ("" if stream is None else f"/stream={stream}") + ("" if batch is None else f"/batch={batch}")
    try:
        # The folders' names repeat what the rows say and are not read as columns.
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(place)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def appended_batches(spark: SparkSession, target: str) -> DataFrame:
    """What :func:`append_dataset` has finished so far, a row a batch, readable while streams run.

    ``stream, batch, rows, failed`` (rows with an ``error``, where there is such a column), ``seconds, at``, and
    ``rate``, rows a second.
    """
    return _ledger_of(spark, target).withColumn("rate", F.try_divide(F.col("rows").cast("double"), F.col("seconds")))


def read_appended(spark: SparkSession, target: str, fmt: str, schema: StructType | str | None = None, strict: bool = True) -> DataFrame:
    """The rows of all finished batches. The driver lists one folder a batch, as Spark lists files."""
    done = appended_batches(spark, target).where("rows > 0").select("stream", "batch").collect()
    folders = sorted(_folder(target, r["stream"], r["batch"]) for r in done)
    if folders:
        return read_dataset(spark, folders, fmt, schema, strict)
    return spark.createDataFrame([], schema if schema is not None else StructType())


class ProgressListener(StreamingQueryListener):
    """Calls ``report(rows so far, batch id)`` after every micro-batch."""

    def __init__(self, report: Callable[[int, int], None]):
        self.report = report
        self.rows = 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.report(self.rows, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
