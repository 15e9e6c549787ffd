"""Language quality control. Every entry is scored inside its row; no shuffle, no join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions.arrays import bind, let
from tunekit.functions.text import UNICODE, WS, has_text, strip, text_preview, token_windows
from tunekit.operators.entries import fields_of
from tunekit.operators.limits import first_rows
from tunekit.operators.prompts import MAINLAND_TO_TAIWAN
from tunekit.sources.shared import bounded_batches

# Window of the classifier in tokens (384 less two special ones), shared tokens
# between windows, pass threshold, and the funnel's rates.
WINDOW_TOKENS = 382
WINDOW_OVERLAP = 128
DEFAULT_CONFIDENCE = 0.9
DEFAULT_PASS_RATE = 0.7
MIN_PASS_RATE = 0.1
MIN_BUFFER, MAX_BUFFER = 1.2, 3.0
CHECKED_LOCALE = "zh-tw"
REJECTED_LABEL, ACCEPTED_LABEL = "Mainland Traditional", "Taiwan Traditional"

# Characters of the texts a tokenizer gets at once (a longer text is alone), as it returns an object for every token.
CALL_CHARS = 1 << 17

FIELD_TEXTS = "array<struct<field:string,text:string>>"


@dataclass(frozen=True)
class BatchTokenizer:
    """A Python tokenizer. ``load`` runs once per task and returns ``call(texts)``: for each text the
    ``(start, end)`` places of its tokens in characters, in order; ``batch_size`` texts at a time, fewer
    where they have more than ``CALL_CHARS`` characters together.

    Only windows come back from Python, as places in the text, so their words and spaces are the text's own.
    """

    load: Callable[[], Callable[[list[str]], Sequence[Sequence[tuple[int, int]]]]]
    batch_size: int = 64

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")

    def spans(self, texts: Column, width: int, overlap: int) -> Column:
        """Windows of every text of an array, as ``array<array<struct<start,end>>>``; NULL for a text that fits."""
        load, size, step = self.load, self.batch_size, width - overlap
        if width < 1 or overlap < 0 or step < 1:
            raise ValueError("window width must be positive and overlap in [0, width)")
        kind = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

        def windows(places: Sequence[tuple[int, int]]) -> list[dict] | None:
            n = len(places)
            if n <= width:
                return None
            firsts = range(0, step * -(-(n - width) // step) + 1, step)
            return [{"start": places[i][0], "end": places[min(i + width, n) - 1][1]} for i in firsts]

        def portions(texts: list[str]) -> Iterator[list[str]]:
            held, chars = [], 0
            for text in texts:
                if held and (len(held) == size or chars + len(text) > CALL_CHARS):
                    yield held
                    held, chars = [], 0
                held.append(text)
                chars += len(text)
            if held:
                yield held

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            call = load()
            for rows in batches:
                rows = rows.to_pylist()
                found: list = []
                for texts in portions([t or "" for row in rows if row is not None for t in row]):
                    places = call(texts)
                    if len(places) != len(texts):
                        raise ValueError("as many token lists as texts are needed")
                    found += [windows(p) for p in places]
                    del places  # many times as large as the texts
                left = iter(found)
                yield pa.array([None if row is None else [next(left) for _ in row] for row in rows], kind)

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        bounded_batches()
        return F.arrow_udf(run, "array<array<struct<start:int,end:int>>>")(texts)


Tokenizer = str | BatchTokenizer


def windows_of_texts(texts: Column, tokenizer: Tokenizer, width: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP) -> Column:
    """The windows of every text of an array of texts."""
    if isinstance(tokenizer, str):
        return F.transform(texts, lambda t: text_windows(t, tokenizer, width, overlap))

    def cut(text: Column, spans: Column) -> Column:
        several = F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.coalesce(several, F.array(text))

    return F.zip_with(texts, tokenizer.spans(texts, width, overlap), cut)


def text_windows(
    text: Column,
    tokenizer: Tokenizer = "whitespace",
    width: int = WINDOW_TOKENS,
    overlap: int = WINDOW_OVERLAP,
) -> Column:
    """Overlapping windows of a text; a text that fits is one window, unchanged.

    ``whitespace`` counts words, ``char`` counts characters (for scripts without spaces); a
    :class:`BatchTokenizer` counts its own tokens, such as the sub-words of a classifier.
    """
    if isinstance(tokenizer, BatchTokenizer):
        return F.get(windows_of_texts(F.array(text), tokenizer, width, overlap), F.lit(0))
    if tokenizer == "whitespace":
        tokens, joiner = F.split(strip(text), rf"{UNICODE}{WS}+", -1), " "
        surely_fits = F.length(text) < 2 * width
    elif tokenizer == "char":
        tokens, joiner = F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0)), ""
        surely_fits = F.length(text) <= width
    else:
        raise ValueError("tokenizer must be 'whitespace', 'char' or a BatchTokenizer")
    cut = F.transform(
        token_windows(tokens, width, overlap), lambda w: F.array_join(w, joiner)
    )
    several = let(cut, lambda ws: F.when(F.size(ws) > 1, ws).otherwise(F.array(text)))
    return F.when(surely_fits, F.array(text)).otherwise(several)


def entry_fields(dataset_type: str) -> Column:
    """``array<struct<field,text>>`` to check. Blank fields are skipped, blank messages are not."""
    if dataset_type == "sft_conv":
        return F.transform(
            F.col("conversations"),
            lambda m, i: F.struct(
                F.concat(F.lit("conversations["), i.cast("string"), F.lit("].content")).alias("field"),
                m["content"].alias("text"),
            ),
        ).cast(FIELD_TEXTS)
    return F.filter(
        F.array(
            *[
                F.struct(F.lit(name).alias("field"), F.col(name).alias("text"))
                for name in fields_of(dataset_type)
            ]
        ),
        lambda f: has_text(f["text"]),
    ).cast(FIELD_TEXTS)


@dataclass(frozen=True)
class LexiconScorer:
    """Deterministic scorer: a window with a listed word is of the rejected variety."""

    words: tuple[str, ...] = tuple(MAINLAND_TO_TAIWAN)
    tokenizer: Tokenizer = "char"

    def mean_scores(self, windows: Column) -> Column:
        """Mean acceptance per field from ``array<array<string>>``."""
        def score(window: Column) -> Column:
            hits = [F.contains(window, F.lit(word)) for word in self.words]
            return F.when(reduce(or_, hits, F.lit(False)), 0.0).otherwise(1.0)

        def mean(ws: Column) -> Column:
            total = F.aggregate(ws, F.lit(0.0), lambda acc, w: acc + score(w))
            return total / F.size(ws)

        return F.transform(windows, mean)


@dataclass(frozen=True)
class BatchScorer:
    """A Python classifier. ``load`` runs once per task and returns ``call(texts) -> probabilities``
    of the accepted label, on up to ``batch_size`` windows at a time. A batch that raises, or returns
    another number of scores, is tried again text by text; a text without a score passes, as the
    check must not lose what it cannot judge."""

    load: Callable[[], Callable[[list[str]], Sequence[float]]]
    tokenizer: Tokenizer = "char"
    batch_size: int = 256

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")

    def mean_scores(self, windows: Column) -> Column:
        load, size = self.load, self.batch_size

        def scored(call, texts: list[str]) -> list[float | None]:
            try:
                scores = [float(x) for x in call(texts)]
                if len(scores) != len(texts):
                    raise ValueError("as many scores as texts are needed")
                return scores
            except Exception:
                if len(texts) == 1:
                    return [None]
                return [s for t in texts for s in scored(call, [t])]

        def mean(scores: list[float | None]) -> float | None:
            return None if None in scores or not scores else sum(scores) / len(scores)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            call = load()
            for rows in batches:
                flat = [w for row in rows if row is not None for ws in row for w in ws]
                slices = (flat[i : i + size] for i in range(0, len(flat), size))
                scores = iter([s for part in slices for s in scored(call, part)])
                yield pd.Series(
                    [
                        None
                        if row is None
                        else [mean([next(scores) for _ in ws]) for ws in row]
                        for row in rows
                    ]
                )

        bounded_batches()
        # Keeps Catalyst from pushing a later filter below the call, which would score twice.
        return F.pandas_udf(run, "array<double>").asNondeterministic()(windows)


Scorer = LexiconScorer | BatchScorer


def accepted_probability(logits: Sequence[float]) -> float:
    """Softmax of (rejected, accepted) logits, for classifiers that return logits."""
    peak = max(logits)
    weights = [math.exp(x - peak) for x in logits]
    return weights[1] / sum(weights)


@dataclass(frozen=True)
class Quality:
    """What is checked and how strictly. Without a scorer every entry passes."""

    scorer: Scorer | None = field(default_factory=LexiconScorer)
    threshold: float = DEFAULT_CONFIDENCE
    width: int = WINDOW_TOKENS
    overlap: int = WINDOW_OVERLAP

    def __post_init__(self) -> None:
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must be in 0..1")


def with_quality(df: DataFrame, dataset_type: str, quality: Quality | None = None) -> DataFrame:
    """Add ``qc_fields, qc_passed, failed_fields``.

    A field passes when the accepted label is the likelier one and its mean probability over the
    windows reaches the threshold; an entry passes when no field failed.
    """
    quality = quality or Quality()
    if quality.scorer is None:
        return df.withColumn("qc_passed", F.lit(True)).withColumn(
            "failed_fields", F.array().cast("array<string>")
        )
    scorer = quality.scorer
    columns = df.columns
    fields = bind(df, "_fields", entry_fields(dataset_type))
    texts = F.transform("_fields", lambda f: F.coalesce(f["text"], F.lit("")))
    cut = bind(fields, "_windows", windows_of_texts(texts, scorer.tokenizer, quality.width, quality.overlap))
    scored = bind(cut, "_scores", scorer.mean_scores(F.col("_windows")))

    def result(f: Column, i: Column) -> Column:
        p = F.get(F.col("_scores"), i)
        accepted = p > 0.5
        return F.struct(
            f["field"].alias("field"),
            text_preview(f["text"]).alias("text_preview"),
            F.when(accepted, ACCEPTED_LABEL).otherwise(REJECTED_LABEL).alias("label"),
            F.greatest(p, 1.0 - p).alias("confidence"),
            p.alias("accepted_probability"),
            (1.0 - p).alias("rejected_probability"),
            F.size(F.get(F.col("_windows"), i)).alias("num_windows"),
            (accepted & (p >= quality.threshold)).alias("ok"),
        )

    failed = F.transform(F.filter("qc_fields", lambda f: ~f["ok"]), lambda f: f["field"])
    checked = bind(scored, "qc_fields", F.transform("_fields", result)).withColumn(
        "failed_fields", failed
    )
    return checked.withColumn("qc_passed", F.size("failed_fields") == 0).select(
        *columns, "qc_fields", "qc_passed", "failed_fields"
    )


def quality_scores(scored: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row per checked field of :func:`with_quality` output."""
    return scored.select(*keep, F.explode("qc_fields").alias("_f")).select(*keep, "_f.*")


def quality_filter(
    df: DataFrame,
    dataset_type: str,
    locale: str,
    quality: Quality | None = None,
    enabled: bool = True,
) -> DataFrame:
    """Entries that pass; the check applies to one locale only and is a no-op elsewhere."""
    if not enabled or locale != CHECKED_LOCALE:
        return df
    columns = df.columns
    return with_quality(df, dataset_type, quality).filter("qc_passed").select(*columns)


def quality_stats(scored: DataFrame, estimated_pass_rate: float = DEFAULT_PASS_RATE) -> DataFrame:
    """One row: checked, passed, failed, discarded, pass rate and the blended estimate (percent)."""
    total, passed = F.count(F.lit(1)), F.count_if("qc_passed")
    estimate = clamp_pass_rate(estimated_pass_rate)
    return scored.agg(
        total.alias("total_checked"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        (total - passed).alias("discarded"),
        F.coalesce(F.try_divide(passed, total) * 100, F.lit(0.0)).alias("pass_rate"),
        (
            F.coalesce(0.7 * F.try_divide(passed, total) + 0.3 * estimate, F.lit(estimate)) * 100
        ).alias("estimated_pass_rate"),
    )


def clamp_pass_rate(rate: float) -> float:
    return max(MIN_PASS_RATE, min(1.0, rate))


def request_count(target: int, estimated_pass_rate: float = DEFAULT_PASS_RATE) -> int:
    """How many entries to ask for so that about ``target`` survive the check."""
    buffer = max(MIN_BUFFER, min(MAX_BUFFER, 1.0 / clamp_pass_rate(estimated_pass_rate)))
    return int(target * buffer + 0.5)


def request_count_column(target: Column, estimated_pass_rate: Column) -> Column:
    """The same for rows of targets."""
    rate = F.greatest(F.lit(MIN_PASS_RATE), F.least(F.lit(1.0), estimated_pass_rate))
    buffer = F.greatest(F.lit(MIN_BUFFER), F.least(F.lit(MAX_BUFFER), 1.0 / rate))
    return F.floor(target * buffer + 0.5).cast("bigint")


def update_pass_rate(passed: int, total: int, estimated_pass_rate: float) -> float:
    """Blend the observed rate into the estimate; unchanged when nothing was checked."""
    return 0.7 * passed / total + 0.3 * estimated_pass_rate if total else estimated_pass_rate


def first_n_passing(
    scored: DataFrame, n: int, order: tuple[str, ...] = ("batch_number", "entry_index")
) -> DataFrame:
    """First ``n`` passing entries in request order."""
    return first_rows(scored.filter("qc_passed"), order, n)
