"""Documents to training rows, as stages that each write a table and read it again.

Each stage takes all rows that the one before kept, and its decisions take effect; all but the last
return the columns of documents. Rows without ``doc_id`` pass every stage that decides by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunekit.functions.arrays import quoted
from tunekit.llm import langid, unigram
from tunekit.llm.decontaminate import contaminated
from tunekit.llm.linedup import without_repeated_lines
from tunekit.llm.parityjoin import similar_documents
from tunekit.llm.spark_tools import fresh, maybe_member, membership, stage
from tunekit.llm.vocabulary import read_pieces

MIN_SCORE = 0.5


def _columns(docs: DataFrame, *without: str) -> list[Column]:
    """The columns of documents by their exact names, but some."""
    return [quoted(c) for c in docs.columns if c.lower() not in without]


def _without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in ids; only rows that a fixed-size filter can't clear are shuffled."""
    filtered = membership(ids, "doc_id")
    clear = maybe_member(docs, "doc_id", filtered, member=False)
    return clear.unionAll(maybe_member(docs, "doc_id", filtered).join(ids, "doc_id", "left_anti").select(*_columns(docs)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those whose language is a guess; learns from the rows that aren't held out."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    lang, score = fresh(docs, "__lang"), fresh(docs, "__score")
    kept = langid.identify(docs, model, lang=lang, confidence=score).where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE))
    return kept.select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs; a text of which nothing is left goes."""
    runs = fresh(docs, "__runs")
    cut = without_repeated_lines(docs, runs=runs).where((F.size(runs) == 0) | (F.col("text") != ""))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*_columns(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id stays."""
    groups = stage(similar_documents(docs), "pipeline-groups")
    return _without_ids(docs, groups.where("component_id != doc_id").select("doc_id").distinct())


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = stage(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True), "pipeline-leaks")
    return _without_ids(docs, found.where("doc_id IS NOT NULL").select("doc_id").distinct())


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of every text, their number and whether decoding them gives the text back; input columns of these names are replaced."""
    coded = unigram.encode(docs, unigram.build(read_pieces()))
    return coded.select(*_columns(docs, "ids", "decoded", "n_pieces", "round_trip"), "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), F.expr("decoded <=> text").alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
