"""Removal of every byte in a 100-byte string that also starts earlier, by refinement of suffix buckets.

Suffixes are put in buckets by their first bytes, and buckets are refined by the identifiers of
later offsets until all suffixes of a bucket agree in 100 bytes; then every member but the earliest
is a later copy. Identifiers are 64-bit names of content, so that equal strings have equal names in
every task. Suffixes leave as soon as they are alone.

1. Initial buckets: q-grams of 32 bytes. Of the 69 q-grams in a 100-byte string the least by hash is
   its anchor (leftmost on a tie); the choice depends on the string alone, so equal strings have equal
   anchors at equal offsets. Consecutive suffixes with the same anchor are a run of at most 69, a third
   of a hundredth of all offsets being anchors. A task emits per run the anchor's bucket and the
   identifier of the run's whole span (its suffixes with all their 100 bytes).
2. A bucket with one run is done: no string of that run is repeated. In other buckets runs are sorted
   by span: of equal spans all but the first are later copies, whole. The first runs of different
   spans in one bucket go on.
3. Of the runs that go on, each suffix gets the identifiers of its first 64 bytes (from the buckets of
   offsets 0 and 32) and of its 100 bytes (from those of offsets 0 and 36), the buckets being reused
   recursively. Suffixes are sorted in these last buckets; all but the first are later copies.

Later copies become byte intervals, which are merged per document. Texts are shuffled only for
documents that have runs to go on or bytes to remove, chosen with a filter of fixed size.

Nulls and ties: a null text is empty. Rows with a null ``doc_id`` have no rank: they keep all bytes and
are no earlier copy of anything. Rows that share a ``doc_id`` count as one document given more than
once: equal starts are not earlier, and what is removed from one is removed from the others at the
same offsets. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tunekit.llm.arrays import PIECE, Substrings, constants, groups, mix, sliding_min, text_bytes
from tunekit.llm.places import FOUND_DDL, by_document, dealt, interval_rows, merged, sorted_places, spread, unpacked
from tunekit.llm.spark_tools import bounded_batches, maybe_member, membership, partitions, stage

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
_C = constants(4, 29)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_SPAN = np.dtype([("bucket", "u8"), ("span", "u8"), ("doc", "i8"), ("start", "u4"), ("more", "u4")])
_SUFFIX = np.dtype([("bucket", "u8"), ("doc", "i8"), ("start", "u4")])
HELD = 400_000


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, row ends within them, first row, offset in that row): whole rows, or overlapping parts of a longer one."""
    for lo, hi in groups(ends):
        first, last = int(ends[lo]), int(ends[hi])
        if last - first <= PIECE:
            yield data[first:last], ends[lo : hi + 1] - first, lo, 0
        else:
            for at in range(0, last - first - LENGTH + 1, PIECE):
                part = data[first + at : min(first + at + PIECE + LENGTH - 1, last)]
                yield part, np.array([0, len(part)]), lo, at


def anchored_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last suffix, bucket and span identifier of every run of suffixes with a common anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Substrings(data)
    grams = mix(hashes.grams(GRAM))
    anchor = (sliding_min((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), WINDOW) & _LOW).astype(np.int64)
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    new[ends[:-1][ends[:-1] < len(new)]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(ends, first, side="right") - 1
    last = np.minimum(np.r_[first[1:], len(new)] - 1, ends[row + 1] - LENGTH)
    keep = last >= first
    row, first, last = row[keep], first[keep], last[keep]
    at = anchor[first]
    span = hashes.of(first, last + LENGTH) * _C[0] + (at - first).astype(np.uint64) * _C[1] + (last - first).astype(np.uint64) * _C[2]
    return row, first, last, grams[at], mix(span)


def suffix_buckets(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The bucket of the 100 bytes at each start, from the buckets of 32 and 64 bytes at later offsets."""
    grams = mix(Substrings(data).grams(GRAM))
    two = mix(grams[:-GRAM] * _C[0] + grams[GRAM:] * _C[1])
    later = LENGTH - 2 * GRAM
    return mix(two[start] * _C[2] + two[start + later] * _C[3])


_SPAN_END = lambda x: x["start"].astype(np.int64) + x["more"] + LENGTH
_SUFFIX_END = lambda x: x["start"].astype(np.int64) + LENGTH


def _runs(shards: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            data, ends = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part, rows, lo, at in _pieces(data, ends):
                row, first, last, bucket, span = anchored_runs(part, rows)
                x = np.empty(len(row), dtype=_SPAN)
                x["bucket"], x["span"], x["doc"] = bucket, span, ids[lo + row]
                x["start"], x["more"] = first - rows[row] + at, last - first
                held.append(x)
                size += len(x)
                if size > HELD:
                    yield from dealt(np.concatenate(held), ["bucket", "span"], shards, _SPAN_END)
                    held, size = [], 0
        if size:
            yield from dealt(np.concatenate(held), ["bucket", "span"], shards, _SPAN_END)

    return run


def _refine_spans(batches):
    """Step 2 on the buckets of one task; intervals found before pass through."""
    held = []
    for batch in batches:
        done = batch.filter(batch.column("packed").is_null())
        if len(done):
            yield done
        held += unpacked(batch, _SPAN)
    if not held:
        return
    x = np.concatenate(held)
    del held
    order = np.argsort(x["bucket"])
    bucket = x["bucket"][order]
    same = np.r_[False, bucket[1:] == bucket[:-1], False]
    x = x[order[same[1:] | same[:-1]]]
    x, later = sorted_places(x, ["bucket", "span"])
    yield from interval_rows(x["doc"][later], x["start"][later], _SPAN_END(x[later]), False)
    new = np.r_[True, (x["bucket"][1:] != x["bucket"][:-1]) | (x["span"][1:] != x["span"][:-1])][: len(x)]
    x = x[new]
    same = np.r_[False, x["bucket"][1:] == x["bucket"][:-1], False]
    x = x[(same[1:] | same[:-1])[: len(x)]]
    yield from interval_rows(x["doc"], x["start"], x["start"].astype(np.int64) + x["more"] + 1, True)


def _suffixes(shards: int):
    """Step 3, first half: the buckets of all suffixes of the open runs of (doc_id, text, starts, ends)."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            starts, stops = batch.column(2), batch.column(3)
            for part, rows, lo, at in _pieces(data, ends):
                pick = []
                for i in range(len(rows) - 1):
                    s, e = (np.asarray(c[lo + i].values.to_numpy(zero_copy_only=False), np.int64) for c in (starts, stops))
                    s, e = np.maximum(s - at, 0), np.minimum(e - at, int(rows[i + 1] - rows[i]) - LENGTH + 1)
                    if at or len(rows) == 2:
                        e = np.minimum(e, PIECE)  # the next part has the rest
                    _, s, e = merged(np.zeros(np.count_nonzero(e > s), np.int64), s[e > s], e[e > s]) if np.any(e > s) else (s[:0],) * 3
                    n = e - s
                    if len(n):
                        pick.append((i, np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())))
                if not pick:
                    continue
                start = np.concatenate([p + rows[i] for i, p in pick])
                x = np.empty(len(start), dtype=_SUFFIX)
                x["bucket"] = suffix_buckets(part, start)
                x["doc"] = np.concatenate([np.full(len(p), ids[lo + i]) for i, p in pick])
                x["start"] = np.concatenate([p + at for _, p in pick])
                held.append(x)
                size += len(x)
                if size > HELD:
                    yield from dealt(np.concatenate(held), ["bucket"], shards, _SUFFIX_END)
                    held, size = [], 0
        if size:
            yield from dealt(np.concatenate(held), ["bucket"], shards, _SUFFIX_END)

    return run


def _refine_suffixes(batches):
    held = []
    for batch in batches:
        done = batch.filter(batch.column("packed").is_null())
        if len(done):
            yield done
        held += unpacked(batch, _SUFFIX)
    if held:
        x, later = sorted_places(np.concatenate(held), ["bucket"])
        yield from interval_rows(x["doc"][later], x["start"][later], _SUFFIX_END(x[later]), False)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(batches):
    """Texts without their removed bytes, from (doc_id, text, starts, ends)."""
    for batch in batches:
        data, ends = text_bytes(batch.column(1))
        out = []
        for i, doc in enumerate(batch.column(0).to_pylist()):
            text = data[ends[i] : ends[i + 1]]
            keep, spans = np.ones(len(text), dtype=bool), 0
            if batch.column(2)[i].is_valid:
                s, e = (np.asarray(batch.column(c)[i].values.to_numpy(zero_copy_only=False), np.int64) for c in (2, 3))
                s, e = s[s < len(text)], np.minimum(e[s < len(text)], len(text))
                if len(s):
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                    spans = len(s)
                    for a, b in zip(s, e):
                        keep[a:b] = False
            kept = text[keep].tobytes()
            out.append({"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
        yield pa.RecordBatch.from_pylist(out, schema=_KEPT)


def removed_intervals(docs: DataFrame) -> DataFrame:
    """Byte intervals (doc_id, start, end) of later copies, not yet merged, of (doc_id, text)."""
    shards = partitions(docs.sparkSession)
    spans = docs.mapInArrow(_runs(shards), FOUND_DDL)
    found = stage(spread(spans, shards).mapInArrow(_refine_spans, FOUND_DDL).drop("shard", "packed"), "bytes-spans")
    runs = found.where("open").select("doc_id", "start", "end")
    wanted = by_document(runs)
    texts = maybe_member(docs, "doc_id", membership(runs, "doc_id")).join(wanted.hint("shuffle_hash"), "doc_id")
    suffixes = texts.select("doc_id", "text", "starts", "ends").mapInArrow(_suffixes(shards), FOUND_DDL)
    more = spread(suffixes, shards).mapInArrow(_refine_suffixes, FOUND_DDL).drop("shard", "packed")
    return stage(found.where("NOT open").unionAll(more).select("doc_id", "start", "end"), "bytes-removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    removed = removed_intervals(docs)
    touched = membership(removed, "doc_id")
    cut = maybe_member(docs, "doc_id", touched).join(by_document(removed).hint("shuffle_hash"), "doc_id", "left")
    cut = cut.select("doc_id", "text", "starts", "ends").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    kept = F.coalesce("text", F.lit("")).cast("binary")
    none = F.lit(0).cast("long")
    whole = maybe_member(docs, "doc_id", touched, member=False).select(
        "doc_id", F.octet_length(kept).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept")
    )
    return cut.unionAll(whole)
