"""The four jobs as lazy compositions. Only the staging and writing helpers run anything."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tunekit.functions.text import has_text
from tunekit.operators import prompts as P
from tunekit.operators.chunking import ChunkConfig, chunk_documents
from tunekit.operators.entries import fields_of
from tunekit.operators.fields import require_field
from tunekit.operators.inference import (
    BatchModel,
    FailureBudget,
    Model,
    check_budget,
    infer,
    infer_staged,
    plan_requests,
    set_field,
)
from tunekit.operators.limits import first_rows
from tunekit.operators.parsing import (
    Parsers,
    extract_pages,
    parse_documents,
    with_page_content,
)
from tunekit.operators.quality import (
    CHECKED_LOCALE,
    Quality,
    first_n_passing,
    quality_filter,
    request_count,
    update_pass_rate,
    with_quality,
)
from tunekit.operators.responses import parse_replies
from tunekit.operators.validation import valid_entries
from tunekit.plans.waves import record_progress, store_pass_rate, stored_pass_rate
from tunekit.sources.documents import read_documents, read_paged_bytes
from tunekit.sources.shared import work_dir
from tunekit.sources.writers import convert

__all__ = [
    "DocumentJob",
    "augment",
    "augment_preview",
    "chunk_requests",
    "convert",
    "document_entries",
    "documents_to_dataset",
    "first_passing",
    "generate",
    "topic_requests",
]


def _replies(
    requests: DataFrame,
    model: Model,
    staging: str | None,
    keys: Sequence[str],
    waves: int,
    partitions: int | None,
) -> DataFrame:
    if staging is None:
        return infer(requests, model, partitions=partitions)
    return infer_staged(requests, model, staging, keys, waves=waves, partitions=partitions)


# --- topics to entries ----------------------------------------------------------------------


def topic_requests(
    topics: DataFrame, dataset_type: str = "sft", locale: str = "en", batch_size: int = 5, sent: int = 0
) -> DataFrame:
    """Prompted requests for rows ``(topic, count)``; their numbers go on from those already ``sent``."""
    topics = topics.filter(has_text(F.col("topic")))
    topic, number, size = F.col("topic"), F.col("batch_number"), F.col("batch_size")
    return (
        plan_requests(topics, batch_size)
        .withColumn("batch_number", number + sent)
        .withColumn("system_prompt", P.topic_system_prompt(topic, size, dataset_type, locale))
        .withColumn("user_prompt", P.topic_user_prompt(topic, number, size, dataset_type, locale))
    )


def generate(
    spark: SparkSession,
    topic: str,
    count: int,
    model: Model,
    dataset_type: str = "sft",
    locale: str = "en",
    batch_size: int = 5,
    quality: Quality | None = None,
    estimated_pass_rate: float = 0.7,
    staging: str | None = None,
    waves: int = 1,
    partitions: int | None = None,
    max_rounds: int = 20,
    rates: str | None = None,
    progress: str | None = None,
    budget: FailureBudget | None = None,
) -> DataFrame:
    """``count`` entries about a topic: over-request, infer, parse, check, keep the first ``count``
    in request order.

    The model runs when this is called, in rounds: each asks for what is still lacking, by the pass rate
    seen so far, until enough entries have passed; then nothing more is sent. It ends with less after
    ``max_rounds``, or after two rounds from which nothing passed. With ``rates`` the first round starts
    from the rate that the last run with this model, type and locale left in that table, and the new one
    is added to it. With ``progress`` every round adds a row to that table (``plans.waves.progress_of``).
    """
    if not topic.strip():
        raise ValueError("topic must not be blank")
    if count < 1:
        raise ValueError("count must be positive")
    checked = locale == CHECKED_LOCALE
    rate = stored_pass_rate(spark, rates, model.name, dataset_type, locale, estimated_pass_rate)
    root = work_dir(spark, "generated")
    sent = passed = seen = barren = 0
    parts: list[DataFrame] = []
    for number in range(max_rounds):
        asked = request_count(count - passed, rate) if checked else count - passed
        topics = spark.range(1).select(F.lit(topic.strip()).alias("topic"), F.lit(asked).cast("bigint").alias("count"))
        requests = topic_requests(topics, dataset_type, locale, batch_size, sent)
        began = time.monotonic()
        answered = _answered_round(requests, model, staging, f"{root}/replies-{number}", waves, partitions, budget)
        entries = parse_replies(answered.filter(F.col("error").isNull()), dataset_type, keep=("batch_number",))
        if checked:
            scored = with_quality(entries, dataset_type, quality)
        else:
            scored = entries.withColumn("qc_passed", F.lit(True))
        scored = scored.select("batch_number", "entry_index", *fields_of(dataset_type), "qc_passed")
        own = Observation()
        counted = scored.observe(own, F.count(F.lit(1)).alias("checked"), F.count_if("qc_passed").alias("passed"))
        counted.write.parquet(f"{root}/entries-{number}")
        parts.append(spark.read.schema(scored.schema).parquet(f"{root}/entries-{number}"))
        asks = answered.agg(F.count(F.lit(1)), F.count("error")).first()
        if progress is not None:
            record_progress(spark, progress, f"generate {topic.strip()}", number, asks[0], asks[1], time.monotonic() - began, own.get["checked"], own.get["passed"])
        sent, passed, seen = sent + asks[0], passed + own.get["passed"], seen + own.get["checked"]
        if checked:
            rate = update_pass_rate(own.get["passed"], own.get["checked"], rate)
        barren = 0 if own.get["passed"] else barren + 1
        if passed >= count or barren == 2:
            break
    if checked and rates is not None:
        store_pass_rate(spark, rates, model.name, dataset_type, locale, seen, passed, rate)
    rows = reduce(DataFrame.unionAll, parts)
    return first_n_passing(rows, count).select("batch_number", "entry_index", *fields_of(dataset_type))


def _answered_round(
    requests: DataFrame, model: Model, staging: str | None, place: str, waves: int, partitions: int | None, budget: FailureBudget | None
) -> DataFrame:
    """Replies that are written before they are read: staged by request, or just kept for this run."""
    if staging is not None:
        return infer_staged(requests, model, staging, ("topic", "batch_number"), waves=waves, partitions=partitions, budget=budget)
    if budget is not None and isinstance(model, BatchModel):
        model = replace(model, budget=budget)
    answered = infer(requests, model, partitions=partitions)
    answered.write.parquet(place)
    answered = requests.sparkSession.read.schema(answered.schema).parquet(place)
    if budget is not None:
        check_budget(budget, answered)
    return answered


def first_passing(
    requests: DataFrame,
    order: str,
    n: int,
    model: Model,
    scored_of: Callable[[DataFrame], DataFrame],
    estimated_pass_rate: float = 0.7,
    per_request: float = 1.0,
    partitions: int | None = None,
    max_rounds: int = 20,
    progress: str | None = None,
    budget: FailureBudget | None = None,
) -> DataFrame:
    """The first ``n`` rows that pass, in order of their requests, without paying for the rest.

    Requests (columns ``order``, ``system_prompt, user_prompt`` and any more) are sent in rounds in that
    order, each as large as the pass rate so far makes likely to be enough; ``order`` must tell rows apart.
    ``scored_of`` turns answered requests into rows with ``order`` and ``qc_passed``, ``per_request`` of them
    for each request about. Requests are evaluated once a round, so stage them if that is expensive.
    """
    spark = requests.sparkSession
    root, rate, last = work_dir(spark, "rounds"), estimated_pass_rate, None
    passed = 0
    parts: list[DataFrame] = []
    for number in range(max_rounds):
        asked = max(1, math.ceil(request_count(n - passed, rate) / per_request))
        todo = requests if last is None else requests.filter(F.col(order) > F.lit(last))
        began = time.monotonic()
        answered = _answered_round(first_rows(todo, [order], asked), model, None, f"{root}/replies-{number}", 1, partitions, budget)
        scored = scored_of(answered)
        own = Observation()
        scored.observe(own, F.count(F.lit(1)).alias("checked"), F.count_if("qc_passed").alias("passed")).write.parquet(f"{root}/rows-{number}")
        parts.append(spark.read.schema(scored.schema).parquet(f"{root}/rows-{number}"))
        sent, failed, last = answered.agg(F.count(F.lit(1)), F.count("error"), F.max(order)).first()
        if progress is not None:
            record_progress(spark, progress, "first passing", number, sent, failed, time.monotonic() - began, own.get["checked"], own.get["passed"])
        passed += own.get["passed"]
        rate = update_pass_rate(own.get["passed"], own.get["checked"], rate)
        if passed >= n or sent < asked:
            break
    return first_n_passing(reduce(DataFrame.unionAll, parts), n, (order,))


# --- dataset rows with one field filled ------------------------------------------------------


def augment(
    df: DataFrame,
    target: str,
    instruction: str,
    model: Model,
    context_fields: Sequence[str] = (),
    locale: str = "en",
    create_new_field: bool = False,
    staging: str | None = None,
    key_cols: Sequence[str] = (),
    waves: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Every input row once, ``target`` replaced by the model's value or kept on failure, plus
    ``error``. With ``staging``, ``key_cols`` must identify a row."""
    if not instruction.strip() or not target.strip():
        raise ValueError("target and instruction must not be blank")
    target = target.strip()
    require_field(df, target, create_new_field)
    if staging is not None and not key_cols:
        raise ValueError("staging needs key_cols")
    system, user = P.augment_prompts(
        dict(df.dtypes), target, instruction.strip(), tuple(context_fields), locale
    )
    requests = df.withColumn("system_prompt", system).withColumn("user_prompt", user)
    answered = _replies(requests, model, staging, key_cols, waves, partitions)
    return set_field(answered, target).drop("system_prompt", "user_prompt", "raw_content")


def augment_preview(
    df: DataFrame,
    order: Sequence[str],
    target: str,
    instruction: str,
    model: Model,
    preview_count: int = 3,
    **options,
) -> DataFrame:
    """``original, augmented`` structs of the first rows; only those rows reach the model."""
    if not 1 <= preview_count <= 10:
        raise ValueError("preview_count must be in 1..10")
    rows = first_rows(df, order, preview_count)
    original = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    done = augment(
        rows.withColumn("_original", original), target, instruction, model, **options
    )
    columns = df.columns if target in df.columns else [*df.columns, target]
    return done.select(
        *order,
        F.col("_original").alias("original"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("augmented"),
    )


# --- documents to entries --------------------------------------------------------------------


@dataclass(frozen=True)
class DocumentJob:
    """Settings of the document job."""

    dataset_type: str = "sft"
    locale: str = "en"
    entries_per_chunk: int = 3
    chunks: ChunkConfig = field(default_factory=ChunkConfig)
    qc_enabled: bool = True
    quality: Quality = field(default_factory=Quality)
    html_method: str = "regex"

    def __post_init__(self) -> None:
        fields_of(self.dataset_type)
        if not 1 <= self.entries_per_chunk <= 10:
            raise ValueError("entries_per_chunk must be in 1..10")


def chunk_requests(
    documents: DataFrame, job: DocumentJob, key: str = "source_path"
) -> DataFrame:
    """Prompted chunks of parsed documents (columns ``key, content`` and optionally
    ``doc_type, sections, metadata``)."""
    chunks = chunk_documents(documents, job.chunks, keep=(key,))
    return chunks.withColumn("system_prompt", P.chunk_system_prompt(job.locale)).withColumn(
        "user_prompt",
        P.chunk_prompt(F.col("content"), job.dataset_type, job.entries_per_chunk, job.locale),
    )


def document_entries(
    answered: DataFrame, job: DocumentJob, key: str = "source_path"
) -> DataFrame:
    """Valid, quality-checked entries of answered chunk requests. Row-local from end to end."""
    entries = parse_replies(
        answered.filter(F.col("error").isNull()),
        job.dataset_type,
        strict=True,
        keep=(key, "chunk_index"),
    )
    valid = valid_entries(entries, job.dataset_type)
    return quality_filter(valid, job.dataset_type, job.locale, job.quality, job.qc_enabled)


def documents_to_dataset(
    spark: SparkSession,
    path: str,
    model: Model,
    job: DocumentJob | None = None,
    pattern: str | None = None,
    recursive: bool = True,
    parsers: Parsers | None = None,
    pages_of: Callable[[bytes], Iterable[tuple[int, str | None, str | None]]] | None = None,
    staging: str | None = None,
    waves: int = 1,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(files, answered chunks, entries)`` of a directory; feed them to ``file_results``.

    ``pages_of`` reads paged files; without it each of them is a failed file.

    With ``staging`` the model ran once when this returns and all three may be read repeatedly;
    without it, consume only one of the last two.
    """
    job = job or DocumentJob()
    parsers = parsers or Parsers()
    texts = read_documents(spark, path, pattern, recursive, parsers)
    if pages_of is not None:
        texts = texts.filter(~parsers.is_paged(F.col("source_path")))
    parsed = parse_documents(texts, parsers, html_method=job.html_method)
    if pages_of is not None:
        paged = read_paged_bytes(spark, path, pattern, recursive, parsers)
        parsed = parsed.unionByName(with_page_content(extract_pages(paged, pages_of)))
    if staging is not None:
        # Parsed once: the file table and the requests both read the staged documents.
        place, schema = work_dir(spark, "parsed"), parsed.schema
        parsed.write.parquet(place)
        parsed = spark.read.schema(schema).parquet(place)
    requests = chunk_requests(parsed.filter(F.col("error").isNull()), job)
    answered = _replies(
        requests, model, staging, ("source_path", "chunk_index"), waves, partitions
    )
    return parsed.select("source_path", "error"), answered, document_entries(answered, job)
