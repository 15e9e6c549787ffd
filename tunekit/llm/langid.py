"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the two- and three-character sequences of the lower-cased text with at least one letter,
every other character counting as one kind of gap, hashed to ``BUCKETS`` buckets. Counts cover all
training rows: a task adds up its own counts and Spark sums them per language and bucket, so that what
reaches the driver is at most languages x BUCKETS numbers, whatever the number of rows. The matrix of
log probabilities is broadcast and texts are scored in blocks with numpy.

The score is the posterior probability of the chosen language. A text that is null or has no letter is
``und`` with score 0; so is every text when there is nothing to learn from. Equal likelihoods go to the
language that is first by name. A very long text is taken in portions. Rows with a null language train nothing; repeated rows count as often
as they occur. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tunekit.llm.arrays import constants
from tunekit.llm.spark_tools import bounded_batches, fresh

BUCKETS = 1 << 15
SMOOTHING = 0.5
CHARS = 1 << 17
UNKNOWN = "und"
_M = constants(6, 17)


@cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram of some texts, in portions: memory is ten bytes a character and a portion's share."""
    lowered = [(t or "").lower() + "\n" for t in texts]
    ends = np.cumsum([len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    del lowered
    shift = np.uint64(64 - 15)
    for low in range(0, len(codes), CHARS):
        part = codes[low : low + CHARS + 2]
        owner = np.searchsorted(ends, np.arange(low, low + len(part)), side="right")
        letter = _letters()[part]
        x = np.where(letter, part, 0).astype(np.uint64)
        for n, at in ((2, 0), (3, 2)):
            size = max(min(CHARS, len(part) - n + 1), 0)
            h = np.full(size, (_M[5:6] * np.uint64(n))[0], dtype=np.uint64)
            some = np.zeros(size, dtype=bool)
            for i in range(n):
                h += x[i : i + size] * _M[at + i]
                some |= letter[i : i + size]
            some &= owner[:size] == owner[n - 1 : n - 1 + size]
            h = h[some]
            yield owner[:size][some], ((h ^ (h >> np.uint64(29))) * _M[0] >> shift).astype(np.int64)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of ``grams`` at once, and which texts have a letter (and so an n-gram)."""
    owners, found = zip(*grams(texts))
    owner = np.concatenate(owners)
    return owner, np.concatenate(found), np.bincount(owner, minlength=len(texts)) > 0


def _blocks(texts: list[str | None]):
    """(first row, texts) of consecutive rows of about CHARS characters, or one longer row."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHARS or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _count(batches):
    """Counts of one task; bucket -1 counts texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, texts in _blocks(batch.column(0).to_pylist()):
            own = langs[first : first + len(texts)]
            mine = {lang: np.array([x == lang for x in own]) for lang in set(own)}
            has = np.zeros(len(texts), bool)
            for owner, bucket in grams(texts):
                has[owner] = True
                for lang, rows in mine.items():
                    counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[:-1] += np.bincount(bucket[rows[owner]], minlength=BUCKETS)
            for lang, rows in mine.items():
                counts[lang][-1] += np.count_nonzero(has & rows)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < BUCKETS, at, -1).astype(np.int32)), pa.array(total[at])], schema=_COUNTS
        )


@dataclass(frozen=True)
class Model:
    """Languages in order of name, log probabilities per language and bucket, log priors."""

    languages: list[str]
    log_p: np.ndarray
    prior: np.ndarray


def train(rows: DataFrame) -> Model:
    """A model from the columns text and lang."""
    bounded_batches(rows.sparkSession)
    known = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    totals = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    texts = totals[totals["bucket"] < 0].set_index("lang")["n"].to_dict()
    languages = sorted(texts)
    counts = np.zeros((len(languages), BUCKETS))
    seen = totals[(totals["bucket"] >= 0) & totals["lang"].isin(languages)]
    counts[seen["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), seen["bucket"].to_numpy(dtype=np.int64)] = seen["n"].to_numpy(dtype=float)
    counts += SMOOTHING
    prior = np.array([texts[x] for x in languages], dtype=float)
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(prior / prior.sum()) if len(prior) else prior)


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of some texts."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total, has = np.repeat(model.prior[:, None], len(texts), axis=1), np.zeros(len(texts), bool)
    for owner, bucket in grams(texts):
        has[owner] = True
        for i, p in enumerate(model.log_p):
            total[i] += np.bincount(owner, weights=p[bucket], minlength=len(texts))
    best = total.argmax(axis=0)
    share = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has)], np.where(has, share, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", confidence: str = "score") -> DataFrame:
    """The rows with the predicted language and its probability; input columns of these names (in any case) are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for _, block in _blocks(texts.to_pylist()):
            a, b = score(block, shared.value)
            langs += a
            scores.append(b)
        share = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(share, pa.float64())], names=["lang", "score"])

    column: Column = predict(F.col(f"`{text}`").cast("string"))
    both = fresh(docs, "__language")
    made = docs.withColumn(both, column)
    return made.withColumns({lang: F.col(both)["lang"], confidence: F.col(both)["score"]}).drop(both)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 on division by 3 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
