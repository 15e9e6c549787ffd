"""Document files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunekit.functions.text import decode_bytes
from tunekit.operators.fields import name_matches
from tunekit.operators.parsing import Parsers


def _select(files: DataFrame, pattern: str | None, parsers: Parsers) -> DataFrame:
    path = F.col("path")
    files = files.filter(parsers.is_supported(path))
    return files.filter(name_matches(path, pattern)) if pattern else files


def list_documents(
    spark: SparkSession,
    path: str,
    pattern: str | None = None,
    recursive: bool = True,
    parsers: Parsers | None = None,
) -> DataFrame:
    """Supported files under a path, sorted; their contents are not read."""
    parsers = parsers or Parsers()
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return (
        _select(found, pattern, parsers)
        .select(
            F.col("path").alias("source_path"),
            parsers.doc_type(F.col("path")).alias("doc_type"),
            "length",
            "modificationTime",
        )
        .orderBy("source_path")
    )


def decoded(files: DataFrame, parsers: Parsers) -> DataFrame:
    """``source_path, raw_text`` from ``binaryFile`` rows; paged files have no text."""
    text = F.when(~parsers.is_paged(F.col("path")), decode_bytes(F.col("content")))
    return files.select(F.col("path").alias("source_path"), text.alias("raw_text"))


def read_documents(
    spark: SparkSession,
    path: str,
    pattern: str | None = None,
    recursive: bool = True,
    parsers: Parsers | None = None,
) -> DataFrame:
    """``source_path, raw_text`` of every supported file. Name filters run before contents are read.

    Names that start with a dot or underscore are not listed by Spark.
    """
    parsers = parsers or Parsers()
    reader = spark.read.format("binaryFile").option(
        "recursiveFileLookup", str(recursive).lower()
    )
    return decoded(_select(reader.load(path), pattern, parsers), parsers)


def read_paged_bytes(
    spark: SparkSession,
    path: str,
    pattern: str | None = None,
    recursive: bool = True,
    parsers: Parsers | None = None,
) -> DataFrame:
    """``source_path, bytes`` of paged files, input of ``extract_pages``."""
    parsers = parsers or Parsers()
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return (
        _select(files, pattern, parsers)
        .filter(parsers.is_paged(F.col("path")))
        .select(F.col("path").alias("source_path"), F.col("content").alias("bytes"))
    )


def stream_documents(
    spark: SparkSession,
    path: str,
    pattern: str | None = None,
    parsers: Parsers | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """The same as a stream of new files, ``max_files`` per micro-batch."""
    parsers = parsers or Parsers()
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(max_files))
        .load(path)
    )
    return decoded(_select(files, pattern, parsers), parsers)
