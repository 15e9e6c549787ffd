"""Running a user's model over prompt rows, and resuming where a run stopped."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tunekit.functions.text import strip
from tunekit.operators.prompts import value_text
from tunekit.sources.shared import bounded_batches, work_dir

DEFAULT_NAMES = ("column", "batch")
REPLY_TYPE = "raw_content string, error string"

# Failure classes and the words that mark them.
ERROR_CLASSES = (
    ("model_not_found", ("model", "not found")),
    ("model_loading_timeout", ("model loading timeout",)),
    ("context_length_exceeded", ("context length exceeded",)),
)


def class_of_error(message: str) -> str:
    """:func:`error_class` of one message."""
    text = message.lower()
    for name, words in ERROR_CLASSES:
        if all(w in text for w in words):
            return name
    return "connection" if "connection" in text or "refused" in text else "other"


@dataclass(frozen=True)
class FailureBudget:
    """When a job gives up on its model.

    One failure of a ``fatal`` class is enough: a task that sees one sends no further request, and the job
    ends with the wave. So does a wave of at least ``least`` requests of which more than ``share`` failed.
    Failures of other classes cost their own rows only.
    """

    fatal: tuple[str, ...] = ("model_not_found", "model_loading_timeout", "connection")
    share: float | None = None
    least: int = 100

    def __post_init__(self) -> None:
        if self.share is not None and not 0 <= self.share < 1:
            raise ValueError("share must be at least 0 and below 1")


class ModelStopped(RuntimeError):
    """A job ended by its failure budget; the replies so far are staged, and a rerun goes on from there."""

    def __init__(self, kind: str, wave: int, example: str | None):
        super().__init__(f"stopped after wave {wave}: {kind}: {example}")
        self.kind, self.wave, self.example = kind, wave, example


NOT_SENT = "Not sent after: "


@dataclass(frozen=True)
class ColumnModel:
    """A model that is a Column expression of (system prompt, user prompt)."""

    reply: Callable[[Column, Column], Column]
    error: Callable[[Column, Column], Column] | None = None
    name: str = "column"

    def replies(self, system: Column, user: Column) -> Column:
        error = F.lit(None) if self.error is None else self.error(system, user)
        error = error.cast("string")
        return F.struct(
            F.when(error.isNull(), self.reply(system, user)).alias("raw_content"),
            error.alias("error"),
        )


@dataclass(frozen=True)
class BatchModel:
    """A Python model called on Arrow batches of prompts.

    ``load`` runs once per task and returns ``call(system_prompts, user_prompts) -> replies``.
    ``call`` gets slices of ``batch_size`` prompts, up to ``concurrency`` at a time; a slice that
    raises is tried again one prompt at a time, so one bad prompt fails alone. With an
    ``output_schema`` (see ``entries.output_schema``) ``call`` gets it as its third argument, for
    models that can be held to a form. With a ``budget`` a task answers what is left with the failure
    that ended it instead of calling.
    """

    load: Callable[[], Callable[..., Sequence[str]]]
    name: str = "batch"
    batch_size: int = 1
    concurrency: int = 5
    output_schema: str | None = None
    budget: FailureBudget | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.concurrency <= 20:
            raise ValueError("concurrency must be in 1..20")
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")

    def replies(self, system: Column, user: Column) -> Column:
        load, size, width = self.load, self.batch_size, self.concurrency
        extra = () if self.output_schema is None else (self.output_schema,)
        fatal = () if self.budget is None else self.budget.fatal

        def answer(call, rows: list[tuple[str, str]], ended: list[str]) -> list[tuple[str | None, str | None]]:
            if ended:
                return [(None, NOT_SENT + ended[0])] * len(rows)
            try:
                texts = call([s for s, _ in rows], [u for _, u in rows], *extra)
                if len(texts) != len(rows):
                    raise ValueError(f"model returned {len(texts)} replies for {len(rows)} prompts")
                return [
                    (t, None) if isinstance(t, str) else (None, "Invalid response format")
                    for t in texts
                ]
            except Exception as exc:
                message = str(exc) or type(exc).__name__
                if class_of_error(message) in fatal:
                    ended.append(message)
                    return [(None, message)] * len(rows)
                if len(rows) > 1:
                    return [reply for row in rows for reply in answer(call, [row], ended)]
                return [(None, message)]

        def run(
            batches: Iterator[tuple[pd.Series, pd.Series]],
        ) -> Iterator[pd.DataFrame]:
            call, ended = load(), []
            with ThreadPoolExecutor(width) as pool:
                for systems, users in batches:
                    rows = list(zip(systems, users, strict=True))
                    slices = [rows[i : i + size] for i in range(0, len(rows), size)]
                    done = [r for part in pool.map(lambda s: answer(call, s, ended), slices) for r in part]
                    yield pd.DataFrame(done, columns=["raw_content", "error"], dtype=object)

        run.__annotations__ = {
            "batches": Iterator[tuple[pd.Series, pd.Series]],
            "return": Iterator[pd.DataFrame],
        }
        bounded_batches()
        # A reply may differ per call, so Catalyst must neither repeat nor move the call.
        return F.pandas_udf(run, REPLY_TYPE).asNondeterministic()(system, user)


Model = ColumnModel | BatchModel


def infer(
    df: DataFrame,
    model: Model,
    system_col: str = "system_prompt",
    user_col: str = "user_prompt",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``raw_content`` and ``error``. Filter before this: nothing is pushed below it.

    ``partitions`` spreads rows evenly first; parallel calls = running tasks x model concurrency.
    """
    if partitions:
        df = df.repartition(partitions)
    return (
        df.withColumn("_reply", model.replies(F.col(system_col), F.col(user_col)))
        .withColumn("raw_content", F.col("_reply.raw_content"))
        .withColumn("error", F.col("_reply.error"))
        .drop("_reply")
    )


def error_class(error: Column) -> Column:
    """Class of a failure message; NULL for no failure."""
    text = F.lower(error)
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for name, words in ERROR_CLASSES:
        found = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            found = found & F.contains(text, F.lit(word))
        out = out.when(found, name)
    connection = F.contains(text, F.lit("connection")) | F.contains(text, F.lit("refused"))
    return out.when(connection, "connection").otherwise("other")


def request_id(key_cols: Sequence[str], model_name: str) -> Column:
    """Stable id of a request: model, row key and both prompts. Equal prompts of different rows stay
    apart, so a repeated document does not become one hot key."""
    parts = [F.lit(model_name)] + [
        F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
        for c in (*key_cols, "system_prompt", "user_prompt")
    ]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _staged(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _check(budget: FailureBudget, wave: int, sent: int, failed: int, fatal: str | None, example: str | None) -> None:
    if fatal is not None:
        raise ModelStopped(class_of_error(fatal), wave, fatal.removeprefix(NOT_SENT))
    if budget.share is not None and sent >= budget.least and failed > budget.share * sent:
        raise ModelStopped(f"{failed} of {sent} requests failed", wave, example)


def check_budget(budget: FailureBudget, replies: DataFrame, wave: int = 0) -> None:
    """Raise :class:`ModelStopped` if some replies use the budget up."""
    fatal = error_class(F.col("error")).isin(*budget.fatal)
    found = replies.agg(F.count(F.lit(1)), F.count("error"), F.min(F.when(fatal, F.col("error"))), F.min("error")).first()
    _check(budget, wave, *found)


_SLOTS = 1 << 20


def infer_staged(
    df: DataFrame,
    model: Model,
    staging: str,
    key_cols: Sequence[str],
    waves: int = 1,
    retry_failed: bool = True,
    partitions: int | None = None,
    report: Callable[[int, int, int], None] | None = None,
    budget: FailureBudget | None = None,
    progress: Callable[[int, int, int, float], None] | None = None,
) -> DataFrame:
    """Like :func:`infer`, but replies land in a Parquet table and a rerun skips what it holds.

    The input is evaluated once and written to the shared folder, cut into ``waves`` by a hash of the
    request id. Each wave reads its own part, leaves out the ids that are answered, and is one committed
    write, so a lost driver costs at most one wave. ``key_cols`` must identify a row; the model needs a
    name of its own (with its version), as its replies are found again by it. A request that was tried
    more than once has the reply of its last success, or else its last failure. After each wave
    ``report(wave, requests sent, failures)`` is called with what its write observed, and ``progress`` with
    that and the seconds it took (``plans.waves.progress_writer`` makes a table of it).

    With a ``budget`` the job ends in :class:`ModelStopped` after a wave that uses it up.
    """
    if waves < 1:
        raise ValueError("waves must be positive")
    if model.name in DEFAULT_NAMES:
        raise ValueError("name the model (and its version): replies are staged under that name")
    if budget is not None and isinstance(model, BatchModel):
        model = replace(model, budget=budget)
    spark = df.sparkSession
    path = work_dir(spark, "requests")
    slot = F.pmod(F.xxhash64("request_id"), F.lit(_SLOTS))
    requests = df.withColumn("request_id", request_id(key_cols, model.name)).withColumn("_slot", slot)
    requests = requests.withColumn("_wave", F.floor(F.col("_slot") * waves / _SLOTS).cast("int"))
    requests.write.partitionBy("_wave").parquet(path)
    requests = spark.read.schema(requests.schema).parquet(path)
    before = _staged(spark, staging)
    attempt = 1 if before is None else (before.agg(F.max("attempt")).first()[0] or 0) + 1
    for wave in range(waves):
        todo = requests.filter(F.col("_wave") == wave).select("request_id", "_slot", "system_prompt", "user_prompt")
        if before is not None:
            # A wave's replies lie in files of its own range of slots.
            low, high = (-(-w * _SLOTS // waves) for w in (wave, wave + 1))
            done = before.filter((F.col("_slot") >= low) & (F.col("_slot") < high))
            if retry_failed:
                done = done.filter(F.col("error").isNull())
            todo = todo.join(done.select("request_id"), "request_id", "left_anti")
        # Rows with equal keys and prompts are one request.
        replies = infer(todo.dropDuplicates(["request_id"]), model, partitions=partitions).select(
            "request_id", "_slot", F.lit(attempt).alias("attempt"), "raw_content", "error"
        )
        seen, began = Observation(), time.monotonic()
        fatal = error_class(F.col("error")).isin(*(budget.fatal if budget is not None else ()))
        replies.observe(
            seen,
            F.count(F.lit(1)).alias("sent"),
            F.count("error").alias("failed"),
            F.min(F.when(fatal, F.col("error"))).alias("fatal"),
            F.min("error").alias("example"),
        ).write.mode("append").parquet(staging)
        sent, failed = seen.get["sent"], seen.get["failed"]
        if report is not None:
            report(wave, sent, failed)
        if progress is not None:
            progress(wave, sent, failed, time.monotonic() - began)
        if budget is not None:
            _check(budget, wave, sent, failed, seen.get["fatal"], seen.get["example"])
    replies = spark.read.parquet(staging).drop("_slot")
    tried = F.struct(F.col("error").isNull().alias("good"), "attempt")
    best = replies.groupBy("request_id").agg(F.max(tried).alias("_best"))
    best = best.select("request_id", F.col("_best.attempt").alias("attempt"))
    chosen = replies.join(best, ["request_id", "attempt"])
    return requests.drop("_slot", "_wave").join(
        chosen.select("request_id", "raw_content", "error"), "request_id", "left"
    ).drop("request_id")


# --- request planning -----------------------------------------------------------------------

SMALL_COUNT = 3
_BLOCK = 10_000


def plan_requests(
    topics: DataFrame, batch_size: int = 5, keep: tuple[str, ...] = ("topic",)
) -> DataFrame:
    """Requests ``(*keep, batch_number, batch_size)`` for topic rows ``(*keep, count)``.

    Counts up to three are asked for one at a time, larger ones in batches with a short last one.
    A topic with a huge count is spread by blocks before its requests are listed.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    per = F.when(F.col("count") <= SMALL_COUNT, 1).otherwise(batch_size).cast("bigint")
    n = F.ceil(F.col("count") / per)
    blocks = (
        topics.filter(F.col("count") > 0)
        .select(
            *keep,
            F.col("count").cast("bigint").alias("_count"),
            per.alias("_per"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(_BLOCK).cast("bigint"))).alias("_from"),
            n.alias("_n"),
        )
    )
    blocks = blocks.repartition(*keep, "_from")
    first = F.col("_from")
    return (
        blocks.select(
            *keep,
            "_count",
            "_per",
            F.explode(F.sequence(first, F.least(first + _BLOCK, F.col("_n")) - 1)).alias("_i"),
        )
        .select(
            *keep,
            (F.col("_i") + 1).alias("batch_number"),
            F.least(F.col("_per"), F.col("_count") - F.col("_i") * F.col("_per")).alias("batch_size"),
        )
    )


# --- augmentation ---------------------------------------------------------------------------


def set_field(
    df: DataFrame, target: str, replies: str = "raw_content", error: str = "error"
) -> DataFrame:
    """Write the stripped reply into ``target``; a failed row keeps what it had."""
    value = F.when(F.col(error).isNull(), strip(F.col(replies)))
    dtypes = dict(df.dtypes)
    if target in dtypes:
        value = F.coalesce(value, value_text(target, dtypes[target]))
    return df.withColumn(target, value)


def drop_null_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop rows that hold no value at all."""
    return df.dropna(how="all", subset=list(columns) if columns is not None else None)
