"""Delimited text with line breaks inside quotes, read from all ranges of a file at once.

A quote opens a cell only at the cell's beginning (after blanks) and closes it where no second quote
follows; elsewhere quotes are ordinary characters. That is the rule of Python's ``csv`` module, which also
takes the cells out of a row, so that cutting rows and reading them agree. Bytes that aren't UTF-8 become
U+FFFD, and NUL characters are removed. A quote that is never closed runs to the end of its file.

The first row that isn't empty is the header; a file's header must lie in its first range. Columns of files
with different headers are put side by side by name. A cell without a name is ``_c<place>``, and of equal
names (in any case) all but the first get their places appended.
"""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tunekit.sources.shared import work_dir
from tunekit.sources.splits import HEAD, TAIL, THROUGH, WHOLE, Known, Step, in_one_range_each, joined, pieces, ranges, starts, summarise

BATCH_CHARS = 1 << 21

_CLOSE = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')


def line_step(sep: str) -> Step:
    """Whether a line ends inside a quoted cell, by whether it starts inside one."""
    cut = re.escape(sep.encode())
    opened = re.compile(rb'(?:\A|' + cut + rb') *"')

    def step(line: bytes, inside: bool) -> tuple[bool, int]:
        if b'"' not in line:
            return inside, 0
        at = 0
        while True:
            if not inside:
                found = opened.search(line, at)
                if found is None:
                    return False, 0
                at = found.end()
            closed = _CLOSE.match(line, at)
            if closed is None:
                return True, 0
            # What follows a closed cell belongs to it up to the next separator.
            inside, at = False, closed.end()

    return step


def records(lines: Iterator[bytes], step: Step, inside: bool, more: bool) -> Iterator[tuple[int, bytes]]:
    """(kind, raw row) of a range. What is open at the end of a file is a row."""
    held: list[bytes] = []
    began = not inside
    for line in lines:
        end, _ = step(line, inside)
        if inside or end:
            held.append(line)
        if not inside and not end:
            yield WHOLE, line
        elif inside and not end:
            yield WHOLE if began else HEAD, b"\n".join(held)
            held, began = [], True
        inside = end
    if held:
        yield (WHOLE if not more else TAIL) if began else THROUGH, b"\n".join(held)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace("\0", "")


def cells_of(rows: Sequence[str], sep: str) -> list[list[str]]:
    """The cells of some whole rows; a row without any (an empty line) gives none."""
    csv.field_size_limit(sys.maxsize)
    try:
        found = list(csv.reader(rows, delimiter=sep, skipinitialspace=True))
    except csv.Error as exc:
        lone = next((r for r in rows if "\r" in r.rstrip("\r")), "")
        raise ValueError(f"{exc} (rows ended by carriage returns alone are read with multiline=False): {lone[:80]}") from exc
    if len(found) == len(rows):
        return found
    return [next(csv.reader([r], delimiter=sep, skipinitialspace=True), []) for r in rows]


def names_of(header: str, sep: str) -> list[str]:
    """Column names of a header row."""
    cells = cells_of([header], sep)[0]
    seen: set[str] = set()
    out = []
    for i, cell in enumerate(cells):
        name = cell or f"_c{i}"
        while name.lower() in seen:
            name += str(i)
        seen.add(name.lower())
        out.append(name)
    return out


def _first_row(step: Step):
    def head(lines: Iterator[bytes]) -> tuple[bytes | None, Iterator[bytes]]:
        """The first row that isn't empty, and all lines again."""
        taken, held, inside = [], [], False
        for line in lines:
            taken.append(line)
            inside, _ = step(line, inside)
            if held or line.strip(b"\r"):
                held.append(line)
            if held and not inside:
                return b"\n".join(held), chain(taken, lines)
        if inside:
            raise ValueError("the header of a delimited file is longer than the file's first range")
        return None, iter(taken)

    return head


@dataclass(frozen=True)
class Layout:
    """Distinct headers with their places among all columns, and what to do with surplus cells."""

    sep: str
    headers: list[str]
    columns: list[str]
    extra: str | None

    def places(self, head: int) -> list[int]:
        at = {c.lower(): i for i, c in enumerate(self.columns)}
        return [at[name.lower()] for name in names_of(self.headers[head], self.sep)]


def _batches(rows: Iterator[tuple[int, str]], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (header number, raw row)."""
    places = [layout.places(h) for h in range(len(layout.headers))]
    width = len(layout.columns) + (layout.extra is not None)
    names = [*layout.columns, *([layout.extra] if layout.extra is not None else [])]

    def batch(held: list[tuple[int, str]]) -> pa.RecordBatch:
        out: list[list[str | None]] = []
        for (head, raw), cells in zip(held, cells_of([r for _, r in held], layout.sep)):
            if not cells:
                continue
            row: list[str | None] = [None] * width
            own = places[head]
            for at, cell in zip(own, cells):
                row[at] = cell
            if len(cells) > len(own):
                if layout.extra is None:
                    raise ValueError(f"Row with more cells than its header (name a column for them with extra=): {raw[:80]}")
                row[-1] = json.dumps(cells[len(own) :], ensure_ascii=False, separators=(",", ":"))
            out.append(row)
        columns = [pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * width
        return pa.RecordBatch.from_arrays(columns, names=names)

    held, size = [], 0
    for head, raw in rows:
        held.append((head, raw))
        size += len(raw) + 16
        if size > BATCH_CHARS:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], sep: str, extra: str | None = None, one_header: bool = False, recursive: bool = False, names: str | None = None
) -> tuple[DataFrame, Layout]:
    """The cells of all rows as they stand, and the layout found; without any header there are no columns.

    The files are read once for the state at the start of each range and for headers when this is called
    (and once more for rows that a range's end cuts, if there are any), and once when the result is used.
    Where every file is one range, the first time looks for headers only.
    """
    step = line_step(sep)
    lines = pieces(spark, path, "\n", recursive, names)
    summary, heads = None, None
    if in_one_range_each(spark, path, recursive, names):
        some = lines.select("value", "file", F.monotonically_increasing_id().alias("seq")).where(F.length(F.rtrim("value", F.lit("\r"))) > 0)
        heads = some.groupBy("file").agg(F.min_by("value", "seq").alias("head"))
        if any(step(r["head"].encode(), False)[0] for r in heads.select("head").distinct().collect()):
            heads = None  # a header of several lines
    if heads is None:
        summary = starts(summarise(lines, step, 0, _first_row(step)))
        heads = summary.where("head IS NOT NULL")
    found = heads.select("head", F.xxhash64("head").alias("hash")).distinct().orderBy("head").collect()
    headers = [r["head"].rstrip("\r") for r in found]
    if one_header and len({tuple(names_of(_text(h.encode()), sep)) for h in headers}) > 1:
        raise ValueError(f"files with different headers under {path}")
    headers = [h.replace("\0", "") for h in headers]
    columns: dict[str, str] = {}
    for header in headers:
        for name in names_of(header, sep):
            columns.setdefault(name.lower(), name)
    layout = Layout(sep, headers, list(columns.values()), extra)
    schema = StructType()
    for name in [*layout.columns, *([extra] if extra is not None else [])]:
        schema = schema.add(name, StringType())
    if not headers:
        return spark.createDataFrame([], schema), layout
    known = spark.sparkContext.broadcast(Known(summary, {r["hash"]: i for i, r in enumerate(found)}))
    numbers = {h: i for i, h in enumerate(r["head"] for r in found)}
    head_of = _first_row(step)

    def cut(batches) -> Iterator[tuple[dict, int, int, bytes]]:
        for about, values in ranges(batches, "file_hash", "block"):
            start = known.value.start(about["split"], about["block"]["place"])
            number = start.head
            if start.first:
                head, values = head_of(values)
                number = -1 if head is None else numbers[head.decode("utf-8", "replace")]
            skip = start.first
            for kind, raw in records(values, step, start.inside, start.more):
                if skip and raw.strip(b"\r"):
                    skip = False
                    continue
                yield about, number, kind, raw

    def rows(batches):
        yield from _batches(((n, _text(raw)) for _, n, kind, raw in cut(batches) if kind == WHOLE), layout)

    narrow = lines.select("value", "block", "split", F.xxhash64("file").alias("file_hash"))
    out = narrow.mapInArrow(rows, schema)
    if summary is None or summary.where("inside").isEmpty():
        return out, layout

    def fragments(batches):
        for about, number, kind, raw in cut(batches):
            if kind != WHOLE:
                row = {"file": about["file_hash"], "block": about["block"], "head": number, "kind": kind, "raw": raw.decode("utf-8", "replace")}
                yield pa.RecordBatch.from_pylist([row], schema=_FRAGMENT)

    place = work_dir(spark, "fragments")
    narrow.mapInArrow(fragments, "file long, block struct<name: string, place: long>, head int, kind int, raw string").write.parquet(place)
    whole = joined(spark.read.parquet(place), "\n")

    def parsed(batches):
        yield from _batches((r for b in batches for r in zip(b.column("head").to_pylist(), map(_plain, b.column("raw").to_pylist()))), layout)

    return out.unionByName(whole.select("head", "raw").mapInArrow(parsed, schema)), layout


def _plain(text: str) -> str:
    return text.replace("\0", "")


_FRAGMENT = pa.schema(
    [
        ("file", pa.int64()),
        ("block", pa.struct([("name", pa.string()), ("place", pa.int64())])),
        ("head", pa.int32()),
        ("kind", pa.int32()),
        ("raw", pa.string()),
    ]
)
