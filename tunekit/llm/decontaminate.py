"""Benchmark decontamination by spaced-seed hashing.

A training text holds a benchmark item if some 13 consecutive words of both agree in at least 11
places (no insertions). The 13 positions are four blocks; each of six fixed masks looks at two blocks
and ignores the others. Two substitutions touch at most two blocks, so at least one mask sees two equal
windows: hashing both sides under all masks and joining on the hash misses nothing, and each hit is
verified position by position. By default an item of 8 to 12 words is matched whole and exactly, and one
with fewer words matches nothing. With ``short_items`` every item that has a word is searched, and masks
are scaled to its width: whole items of 10 to 12 words may differ in two places, of 5 to 9 words in one
(three blocks, masks of two), shorter ones are matched exactly. ``unsearchable`` gives the items left.

Words are runs of letters, digits and non-ASCII characters, lower-cased; in scripts written without
spaces each character is a word. Benchmark hashes go into a
filter of fixed size (2 MB), which tasks that read the texts get by broadcast; a text's windows that
pass are merged to segments, and equal segments of different texts are matched once. So a passage
that a third of all texts hold costs one match, and the joins carry segments, not texts.

Null texts and ids: a null text has no words; a null ``doc_id`` or ``item_id`` is reported as null.
Repeated rows are reported once per (doc_id, item_id). Extra columns are ignored. With an empty table
on either side nothing matches.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType

from tunekit.llm.arrays import SPACE, constants, groups, mix, word_hashes
from tunekit.llm.spark_tools import FILTER_BITS, bounded_batches, fold_slots, stage

WIDTH, SUBSTITUTIONS, SHORTEST = 13, 2, 8
BLOCKS = [(0, 4), (4, 7), (7, 10), (10, 13)]
_M = constants(WIDTH, 31)
_SALT = constants(64, 37)

# Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")

SEPARATOR = SPACE.copy()
SEPARATOR[:128] = True
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def words_of(texts: list[str | None]):
    """(first row, word hashes, where each row's words begin) of blocks of texts."""
    spaced = ((t or "") if (t or "").isascii() else _UNSPACED.sub(r" \g<0> ", t) for t in texts)
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in spaced]
    ends = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    for lo, hi in groups(ends):
        hashes, at = word_hashes(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], SEPARATOR)
        yield lo, hashes, at


def allowed(width: int, short_items: bool) -> int:
    """How many words of a window may differ."""
    if width == WIDTH:
        return SUBSTITUTIONS
    return (2 if width >= 10 else 1 if width >= 5 else 0) if short_items else 0


def masks(width: int, short_items: bool) -> list[list[tuple[int, int]]]:
    """The blocks each mask sees; as many substitutions as are allowed leave one mask without any."""
    free = allowed(width, short_items)
    if not free:
        return [[(0, width)]]
    n = free + 2
    blocks = BLOCKS if width == WIDTH else [(width * k // n, width * (k + 1) // n) for k in range(n)]
    return [[blocks[a], blocks[b]] for a, b in combinations(range(n), 2)]


def seeds(words: np.ndarray, width: int = WIDTH, short_items: bool = False) -> np.ndarray:
    """Masked hashes of all windows of a width: one row per mask."""
    n, looks = len(words) - width + 1, masks(width, short_items)
    if n <= 0:
        return np.zeros((len(looks), 0), np.uint64)

    def part(a, b):
        total = np.zeros(n, np.uint64)
        for o in range(a, b):
            total += words[o : o + n] * _M[o]
        return total

    blocks = {x: part(*x) for look in looks for x in look}
    return np.stack([mix(sum((blocks[x] for x in look), np.zeros(n, np.uint64)) + _SALT[32 + k] + _SALT[width]) for k, look in enumerate(looks)])


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = None
    for shift in (0, 24):
        slot = ((h >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        found = (bits[slot >> 6] >> (slot & 63)) & 1 == 1
        ok = found if ok is None else ok & found
    return ok


_ITEMS = pa.schema([("item", pa.int64()), ("n_words", pa.int32()), ("width", pa.int32()), ("seed", pa.int64()), ("at", pa.int32()), ("words", pa.binary())])


def _item_seeds(short_items: bool):
    shortest = 1 if short_items else SHORTEST

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, hashes, at in words_of(batch.column(1).to_pylist()):
                for i in range(len(at) - 1):
                    words = hashes[at[i] : at[i + 1]]
                    width = min(WIDTH, len(words))
                    if width < shortest:
                        continue
                    for row in seeds(words, width, short_items):
                        for j, h in enumerate(row.view(np.int64).tolist()):
                            out.append((ids[first + i], len(words), width, h, j, words[j : j + width].tobytes()))
            for x in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_pylist([dict(zip(_ITEMS.names, r)) for r in out[x : x + 50_000]], schema=_ITEMS)

    return run


_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("segment", pa.int64()), ("words", pa.binary())])


def _segments(bits, widths: list[int], short_items: bool):
    """Merged windows of each text that pass the filter under some mask."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, hashes, at in words_of(batch.column(1).to_pylist()):
                covered = np.zeros(len(hashes) + 1, np.int64)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for width in widths:
                    found = seeds(hashes, width, short_items)
                    ok = np.zeros(found.shape[1], bool)
                    for h in found:
                        ok |= _in_filter(bits.value, h)
                    hit = np.flatnonzero(ok)
                    hit = hit[row[hit] == row[hit + width - 1]] if len(hit) else hit
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + width, -1)
                inside = np.cumsum(covered)[:-1] > 0
                edge = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
                start = np.flatnonzero(inside & (edge | ~np.r_[False, inside[:-1]]))
                stop = np.flatnonzero(inside & (np.r_[edge[1:], True] | ~np.r_[inside[1:], False])) + 1 if len(row) else start
                for a, b in zip(start, stop):
                    words = hashes[a:b]
                    name = mix(np.array([np.bitwise_xor.reduce(mix(words + np.arange(b - a, dtype=np.uint64) * _SALT[0]))], np.uint64)).view(np.int64)[0]
                    out.append((ids[first + row[a]], int(a - at[row[a]]), int(name), words.tobytes()))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_SEGMENTS.names, r)) for r in out], schema=_SEGMENTS)

    return run


_SEEDS = pa.schema([("segment", pa.int64()), ("pos", pa.int32()), ("width", pa.int32()), ("seed", pa.int64()), ("window", pa.binary())])


def _segment_seeds(bits, widths: list[int], short_items: bool):
    def run(batches):
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(raw, np.uint64)
                for width in widths:
                    for h in seeds(words, width, short_items):
                        for i in np.flatnonzero(_in_filter(bits.value, h)):
                            out.append((name, int(i), width, int(h.view(np.int64)[i]), words[i : i + width].tobytes()))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_SEEDS.names, r)) for r in out], schema=_SEEDS)

    return run


@F.arrow_udf(IntegerType())
def _agreements(x: pa.Array, y: pa.Array) -> pa.Array:
    equal = [int(np.count_nonzero(np.frombuffer(a.as_buffer(), np.uint64) == np.frombuffer(b.as_buffer(), np.uint64))) for a, b in zip(x, y)]
    return pa.array(equal, pa.int32())


def _without_words(batches):
    for batch in batches:
        bare = [False] * len(batch)
        for first, _, at in words_of(batch.column(1).to_pylist()):
            bare[first : first + len(at) - 1] = (np.diff(at) == 0).tolist()
        yield batch.filter(pa.array(bare, pa.bool_())).select([0])


def unsearchable(benchmark: DataFrame) -> DataFrame:
    """item_id of the benchmark items that have no word and so are found in no text."""
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_without_words, "item_id long")


def contaminated(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """One row per text and benchmark item it holds.

    docs has doc_id and text, benchmark item_id and text. Columns: doc_id, item_id, first_word and
    end_word (where in the text), item_words_found and item_words (how many of the item's words are in
    matching windows), best_agreement (most equal words in a window).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    test = stage(items.mapInArrow(_item_seeds(short_items), "item long, n_words int, width int, seed long, at int, words binary").distinct(), "seeds")
    widths = sorted(r.width for r in test.select("width").distinct().collect())  # at most WIDTH
    low = FILTER_BITS - 1
    bits = spark.sparkContext.broadcast(
        fold_slots(test, [F.col("seed").bitwiseAND(F.lit(low)), F.shiftright("seed", 24).bitwiseAND(F.lit(low))])
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    segments = stage(texts.mapInArrow(_segments(bits, widths, short_items), "doc_id long, start int, segment long, words binary"), "segments")
    different = segments.groupBy("segment").agg(F.first("words").alias("words"))
    found = different.mapInArrow(_segment_seeds(bits, widths, short_items), "segment long, pos int, width int, seed long, window binary")
    hits = found.join(test, ["seed", "width"]).select("segment", "pos", "item", "n_words", "at", "width", "window", "words").distinct()
    hits = hits.withColumn("equal", _agreements("window", "words"))
    need = F.array(*(F.lit(w - allowed(w, short_items)) for w in range(1, WIDTH + 1)))
    hits = hits.where(F.col("equal") >= F.element_at(need, F.col("width")))
    matched = hits.groupBy("segment", "item", "n_words").agg(
        F.min("pos").alias("first"),
        F.max(F.col("pos") + F.col("width")).alias("end"),
        F.max("equal").alias("equal"),
        F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("width") - 1)))).alias("found"),
    )
    return (
        segments.select("doc_id", "start", "segment")
        .join(matched, "segment")
        .groupBy("doc_id", F.col("item").alias("item_id"))
        .agg(
            F.min(F.col("start") + F.col("first")).alias("first_word"),
            F.max(F.col("start") + F.col("end")).alias("end_word"),
            F.size(F.array_distinct(F.flatten(F.collect_set("found")))).alias("item_words_found"),
            F.max("n_words").alias("item_words"),
            F.max("equal").alias("best_agreement"),
        )
    )
