"""Files that hold one JSON array each, read from all ranges of a file at once.

The text is taken in pieces that end with ``}``, so a file may be one line of any length. A piece is summed up
by what it does to the state in or outside a string and to the depth of brackets; an item of the array ends
where a ``}`` outside strings leads back to depth 1. What lies between two such places is a run of items:
an object, and before it any items that hold none. A run must begin with a comma (the first of a file
with ``[``), the last piece must end with the array, and each run must be valid JSON between brackets;
together that is what makes a whole file one valid array, without anything that holds more than a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunekit.sources.shared import work_dir
from tunekit.sources.splits import HEAD, TAIL, THROUGH, WHOLE, Known, in_one_range_each, joined, pieces, ranges, starts, summarise

SEPARATOR = "}"
INVALID, NO_ARRAY = "Invalid JSON", "File holds no JSON array"

_TO_QUOTE = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_STRING = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)


def piece_step(piece: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and how much deeper it ends."""
    if inside:
        end = _TO_QUOTE.match(piece)
        if end is None:
            return True, 0
        piece = piece[end.end() :]
    if b'"' in piece:
        piece = _STRING.sub(b"", piece)
        quote = piece.find(b'"')
        inside = quote >= 0
        piece = piece[:quote] if inside else piece
    else:
        inside = False
    return inside, piece.count(b"{") + piece.count(b"[") - piece.count(b"}") - piece.count(b"]")


def runs(values: Iterator[bytes], inside: bool, depth: int, first: bool, more: bool) -> Iterator[tuple[int, bytes]]:
    """(kind, text) of the runs of items in a range; the end of a file, if there is anything, comes as the last one.

    Where the depth falls below 1 before the end, the file is no array: the run is given as it stands, which
    isn't valid, and the rest of the range is left.
    """
    if depth < 1 and not first:
        yield WHOLE, b""
        return
    held: list[bytes] = []
    began = first or (depth == 1 and not inside)
    piece = next(values, None)
    while piece is not None:
        after = next(values, None)
        inside, change = piece_step(piece, inside)
        depth += change
        held.append(piece)
        if after is None and not more:
            break
        if not inside:
            depth -= 1
            if depth < 1:
                yield WHOLE, b"}".join([*held, b""])
                return
            if depth == 1:
                held.append(b"")
                yield WHOLE if began else HEAD, b"}".join(held)
                held, began = [], True
        piece = after
    if held:
        if more:
            held.append(b"")  # the separator after the last piece belongs to it
        yield (WHOLE if not more else TAIL) if began else (HEAD if not more else THROUGH), b"}".join(held)


_WS = " \t\n\r"
_RUN = pa.schema([("file", pa.string()), ("items", pa.string()), ("error", pa.string())])


def _items(text: str, first: bool, last: bool) -> tuple[str | None, str | None]:
    """Items of a run, as the inside of an array (None for no items), or what is wrong."""
    text = text.strip(_WS)
    if first:
        if not text:
            return None, None  # a file of blanks has no items
        if not text.startswith("["):
            return None, NO_ARRAY if text[0] in '{"-0123456789tfn' else INVALID
        text = text[1:].lstrip(_WS)
    if last:
        if not text.endswith("]"):
            return None, INVALID
        text = text[:-1].rstrip(_WS)
        if not text:
            return None, None
    if not first:
        if not text.startswith(","):
            return None, INVALID
        text = text[1:].lstrip(_WS)
    return (text, None) if text else (None, INVALID)


def item_runs(spark: SparkSession, path: str | Sequence[str], recursive: bool = False, names: str | None = None, joined_files: bool = False) -> DataFrame:
    """(file, items, error): each row some items of a file's array as the text between its brackets, or what is wrong with the file.

    The text of items isn't checked here. With ``joined_files`` the files under a path are one array, in
    order of their names, each of them ending with a ``}`` but the last one.
    """
    parts = pieces(spark, path, SEPARATOR, recursive, names, unit="path" if joined_files else "file")
    small = not joined_files and in_one_range_each(spark, path, recursive, names)
    summary = None if small else starts(summarise(parts, piece_step, -1))
    known = spark.sparkContext.broadcast(Known(summary, {}))

    def cut(batches) -> Iterator[tuple[dict, bool, bool, int, bytes]]:
        """(range, whether a run is the first of its file, and the last, kind, text)."""
        for about, values in ranges(batches, "file", "block"):
            start = known.value.start(about["split"], about["block"]["place"])
            first = start.first
            found = iter(runs(values, start.inside, start.depth, start.first, start.more))
            run = next(found, None)
            while run is not None:
                after = next(found, None)
                yield about, first, after is None and not start.more, *run
                first, run = False, after

    def whole(batches):
        for rows in _packed((about["file"], first, last, raw) for about, first, last, kind, raw in cut(batches) if kind == WHOLE):
            yield rows

    out = parts.mapInArrow(whole, "file string, items string, error string")
    if summary is None or summary.where("NOT first AND (inside OR depth <> 1)").isEmpty():
        return out

    def fragments(batches):
        for about, first, last, kind, raw in cut(batches):
            if kind != WHOLE:
                # The first range of a file and the last one mark what they begin and end.
                row = {"file": about["file"], "block": about["block"], "head": int(first) + 2 * int(last), "kind": kind, "raw": raw.decode("utf-8", "replace")}
                yield pa.RecordBatch.from_pylist([row], schema=_FRAGMENT)

    place = work_dir(spark, "fragments")
    parts.mapInArrow(fragments, "file string, block struct<name: string, place: long>, head int, kind int, raw string").write.parquet(place)
    cut_runs = joined(spark.read.parquet(place), "", F.bit_or("head"))

    def rejoined(batches):
        rows = (r for b in batches for r in zip(b.column("file").to_pylist(), b.column("head").to_pylist(), b.column("raw").to_pylist()))
        yield from _packed((file, bool(head & 1), bool(head & 2), raw.encode()) for file, head, raw in rows)

    return out.unionByName(cut_runs.mapInArrow(rejoined, "file string, items string, error string"))


_FRAGMENT = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.struct([("name", pa.string()), ("place", pa.int64())])),
        ("head", pa.int32()),
        ("kind", pa.int32()),
        ("raw", pa.string()),
    ]
)
_BATCH = 1 << 21


def _packed(found: Iterator[tuple[str, bool, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    files, items, errors, size = [], [], [], 0
    for file, first, last, raw in found:
        text, error = _items(raw.decode("utf-8", "replace"), first, last)
        if text is None and error is None:
            continue
        files.append(file), items.append(text), errors.append(error)
        size += len(raw)
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (files, items, errors)], schema=_RUN)
            files, items, errors, size = [], [], [], 0
    if files:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (files, items, errors)], schema=_RUN)
