"""Places in texts, dealt by name: all but the first place of each name are later copies.

A place is a document, a start and a width; its name is made of 64-bit content hashes. Tasks report the
later copies they see at once and send only the first place of each name on, packed by shard, so a
name that a third of all texts have comes at most once from each task. Later copies become intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("open", pa.bool_()), ("shard", pa.int32()), ("packed", pa.binary())])
FOUND_DDL = "doc_id long, start long, end long, open boolean, shard int, packed binary"


def found_rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in FOUND], schema=FOUND)


def interval_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, open_: bool) -> Iterator[pa.RecordBatch]:
    """Rows of intervals; removed ones (open false) are merged where they overlap."""
    if not open_ and len(doc):
        doc, start, end = merged(doc, start, end)
    for x in range(0, len(doc), 50_000):
        part = slice(x, x + 50_000)
        size = len(doc[part])
        yield found_rows(doc_id=pa.array(doc[part].astype(np.int64)), start=pa.array(start[part].astype(np.int64)), end=pa.array(end[part].astype(np.int64)), open=pa.array(np.full(size, open_)))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal unions of overlapping or touching intervals of each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    rank = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + rank * (1 << 33)) - rank * (1 << 33)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    return doc[first], start[first], reach[np.r_[first[1:], len(doc)] - 1]


def sorted_places(x: np.ndarray, by: list[str]) -> np.ndarray:
    """x sorted by the names, document and start, and which rows aren't the first of theirs."""
    x = x[np.lexsort([x["start"], x["doc"], *(x[c] for c in reversed(by))])]
    same = np.ones(max(len(x) - 1, 0), dtype=bool)
    for c in by:
        same &= x[c][1:] == x[c][:-1]
    later = np.r_[False, same][: len(x)]
    if len(x):  # the same start of a document given twice is no later copy
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(x))))
        later &= (x["doc"] != x["doc"][head]) | (x["start"] != x["start"][head])
    return x, later


def dealt(x: np.ndarray, by: list[str], shards: int, width: Callable) -> Iterator[pa.RecordBatch]:
    """Later copies within the task at once; the first of each name packed by shard."""
    x, later = sorted_places(x, by)
    yield from interval_rows(x["doc"][later], x["start"][later], width(x[later]), False)
    head = np.ones(len(x), dtype=bool)
    head[1:] = False
    for c in by:
        head[1:] |= x[c][1:] != x[c][:-1]
    x = x[head]
    shard = ((x["bucket"] >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    x, shard = x[order], shard[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    rows = [b"".join(np.ascontiguousarray(x[c][a:b]).tobytes() for c in x.dtype.names) for a, b in zip(cuts[:-1], cuts[1:])]
    yield found_rows(shard=pa.array(shard[cuts[:-1]]), packed=pa.array(rows, pa.binary()))


def unpacked(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[np.ndarray]:
    for row in batch.column("packed").drop_null():
        raw = row.as_py()
        n, at = len(raw) // kind.itemsize, 0
        out = np.empty(n, dtype=kind)
        for c in kind.names:
            out[c] = np.frombuffer(raw, kind[c], n, at)
            at += n * kind[c].itemsize
        yield out


def spread(df: DataFrame, shards: int) -> DataFrame:
    """Packed rows to the task of their shard, intervals to any."""
    return df.repartitionById(shards, F.coalesce("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int")))


def by_document(intervals: DataFrame) -> DataFrame:
    """Per document the starts and ends of its intervals, in arrays as long as the document allows."""
    both = intervals.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("all"))
    return both.select("doc_id", F.col("all.start").alias("starts"), F.col("all.end").alias("ends"))
