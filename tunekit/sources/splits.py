"""Records that don't end where lines end, read from all byte ranges of a file at once.

Whether a quote or bracket counts depends on everything before it, so a range of a file can't be cut into
records by itself. It can be summed up, though: a range turns each of two states at its start (outside or
inside a quoted string) into a state at its end, and moves the bracket depth by some number. Summaries
compose, so a running composition over the ranges of a file gives the state at the start of each:

1. ``summarise`` reads all ranges in parallel and stages one short row each;
2. ``starts`` composes them by window functions over these rows (as many a file as it has ranges);
3. a task that knows the state at its range's start cuts whole records out of it;
4. the records that the end of a range cuts in two come from ``joined``: only ranges that start or end
   inside a record give a fragment, and fragments are few and put together by file and place.

Files are read by Spark's text source with a separator that every record ends with, so anything Spark can
read will do. What tasks get to know about ranges is broadcast: 17 bytes for each range behind the first
of a file and for that first one, thus at most 34 bytes for every ``spark.sql.files.maxPartitionBytes`` of
input, whatever the number of files.

All passes must see the same ranges. Spark derives them from the files, the session's settings and the
number of cores; the last is fixed here by ``spark.sql.files.minPartitionNum``, where it is unset. A range
that no summary knows raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunekit.sources.shared import bounded_batches, work_dir

WHOLE, HEAD, TAIL, THROUGH = 0, 1, 2, 3  # a record, the end of one, the beginning of one, neither end of one

Step = Callable[[bytes, bool], tuple[bool, int]]  # piece, inside -> inside at its end, change of depth


def pieces(spark: SparkSession, path: str | Sequence[str], separator: str, recursive: bool = False, names: str | None = None, unit: str = "file") -> DataFrame:
    """``value`` (between two separators) with its ``file``, the file's place ``block``, and ``split``, a number for the range.

    With ``unit="path"`` all files count as one, in order of their names: ``file`` is then the path, and
    ``block`` a struct of name and place.
    """
    bounded_batches(spark)
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", str(recursive).lower())
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    file, place = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = reader.text(path).select("value", file.alias("file"), place.alias("place"))
    block = F.struct(F.lit("").alias("name"), F.col("place")) if unit == "file" else F.struct(F.col("file").alias("name"), F.col("place"))
    unit_file = F.col("file") if unit == "file" else F.lit(str(path))
    return rows.select("value", unit_file.alias("file"), block.alias("block"), F.xxhash64("file", "place").alias("split"))


def in_one_range_each(spark: SparkSession, path: str | Sequence[str], recursive: bool = False, names: str | None = None) -> bool:
    """Whether every file is so small that Spark never cuts it: no longer than the cost of opening one, or than a partition. Only the listing is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if names is not None:
        reader = reader.option("pathGlobFilter", names)
    longest = reader.load(path if isinstance(path, str) else list(path)).agg(F.max("length")).first()[0] or 0
    conf = spark._jsparkSession.sessionState().conf()
    return longest <= min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())


def ranges(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """The ranges of a task: values of some columns, and its pieces (to be used up before the next range)."""

    def rows():
        for batch in batches:
            split = batch.column("split").to_numpy()
            edges = np.flatnonzero(np.r_[True, split[1:] != split[:-1]]) if len(split) else []
            for a, b in zip(edges, [*edges[1:], len(split)]):
                about = {c: batch.column(c)[a].as_py() for c in ("split", *columns)}
                yield about["split"], about, batch.column("value").slice(a, b - a).cast(pa.binary()).to_pylist()

    for _, parts in groupby(rows(), key=lambda r: r[0]):
        first = next(parts)
        rest = (x for part in parts for x in part[2])
        yield first[1], (x for xs in (first[2], rest) for x in xs)


def summarise(rows: DataFrame, step: Step, after: int, head: Callable[[Iterator[bytes]], tuple[bytes | None, Iterator[bytes]]] | None = None) -> DataFrame:
    """A staged row for each range: its file and place, ``end0, depth0`` for a start outside a string and ``end1, depth1`` for one inside.

    ``after`` is what a separator outside a string does to the depth. ``head`` may look at the first pieces
    of the first range of a file and return something to keep in the column of that name.
    """
    schema = "file string, block struct<name: string, place: long>, split long, end0 boolean, end1 boolean, depth0 long, depth1 long, head string"

    def run(batches):
        for about, values in ranges(batches, "file", "block"):
            kept = None
            if head is not None and about["block"]["place"] == 0:
                kept, values = head(values)
            ends, depths = [False, True], [0, 0]
            for piece in values:
                if ends[0] == ends[1]:
                    inside, change = step(piece, ends[0])
                    change += 0 if inside else after
                    ends, depths = [inside, inside], [depths[0] + change, depths[1] + change]
                else:
                    for i in (0, 1):
                        ends[i], change = step(piece, ends[i])
                        depths[i] += change + (0 if ends[i] else after)
            row = {**about, "end0": ends[0], "end1": ends[1], "depth0": depths[0], "depth1": depths[1], "head": None if kept is None else kept.decode("utf-8", "replace")}
            yield pa.RecordBatch.from_pylist([row], schema=_SUMMARY)

    path = work_dir(rows.sparkSession, "ranges")
    rows.mapInArrow(run, schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


_SUMMARY = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.struct([("name", pa.string()), ("place", pa.int64())])),
        ("split", pa.int64()),
        ("end0", pa.bool_()),
        ("end1", pa.bool_()),
        ("depth0", pa.int64()),
        ("depth1", pa.int64()),
        ("head", pa.string()),
    ]
)


def starts(summary: DataFrame) -> DataFrame:
    """file, split, first, more (whether ranges come before and after it in its file), inside and depth at its start, head of its file.

    A range either sets the state, keeps it or turns it around. So the state at the start of one is that
    set by the last one that sets it, turned around as often as ranges between the two do.
    """
    file = Window.partitionBy("file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("end0") == F.col("end1"), F.col("end0") & ~F.col("end1")
    rows = summary.withColumn("_turns", F.sum(turns.cast("long")).over(file.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_set", F.last(F.when(sets, F.struct("end0", "_turns")), ignorenulls=True).over(before))
    since = F.coalesce(F.lag("_turns").over(file), F.lit(0)) - F.coalesce(F.col("_set._turns"), F.lit(0))
    rows = rows.withColumn("inside", F.coalesce(F.col("_set.end0"), F.lit(False)) != (since % 2 == 1))
    rows = rows.withColumn("_moves", F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0")))
    return rows.select(
        "file",
        "split",
        F.lag("split").over(file).isNull().alias("first"),
        F.lead("split").over(file).isNotNull().alias("more"),
        "inside",
        F.coalesce(F.sum("_moves").over(before), F.lit(0)).alias("depth"),
        F.first("head", ignorenulls=True).over(Window.partitionBy("file")).alias("head"),
    )


@dataclass(frozen=True)
class Start:
    inside: bool
    depth: int
    first: bool
    more: bool
    head: int


class Known:
    """What a task looks up about a range: sorted numbers of ranges and their starts."""

    def __init__(self, rows: DataFrame | None, heads: dict[int, int]):
        if rows is None:  # every file is one range
            self.split = np.zeros(0, np.int64)
            return
        table = rows.select("split", "inside", "depth", "first", "more", F.xxhash64("head").alias("head")).where("more OR NOT first").toArrow()
        split = table.column("split").to_numpy()
        order = np.argsort(split)
        self.split = split[order]
        flags = [table.column(c).to_numpy(zero_copy_only=False).astype(np.int8)[order] for c in ("inside", "first", "more")]
        self.flags = flags[0] | flags[1] << 1 | flags[2] << 2
        self.depth = table.column("depth").to_numpy()[order].astype(np.int32)
        self.head = np.array([heads.get(h, -1) for h in table.column("head").to_numpy()[order].tolist()], np.int32)

    def start(self, split: int, place: int) -> Start:
        i = int(np.searchsorted(self.split, split))
        if i < len(self.split) and self.split[i] == split:
            f = int(self.flags[i])
            return Start(bool(f & 1), int(self.depth[i]), bool(f & 2), bool(f & 4), int(self.head[i]))
        if place:
            raise RuntimeError("a range of a file was not there when the file was first looked at: its size or the session's settings for ranges have changed")
        return Start(False, 0, True, False, -1)


def joined(fragments: DataFrame, separator: str, head: Column | None = None) -> DataFrame:
    """(file, head, raw) records put together from (file, block, head, kind, raw) fragments; ``head`` is the largest if nothing else is said."""
    place = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    began = F.sum((F.col("kind") == TAIL).cast("long")).over(place)
    parts = fragments.withColumn("chain", began).groupBy("file", "chain").agg(
        (F.max("head") if head is None else head).alias("head"), F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == TAIL).alias("last"), "raw"))).alias("parts")
    )
    return parts.select("file", "head", F.array_join(F.col("parts.raw"), separator).alias("raw"))
