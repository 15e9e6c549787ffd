"""Dataset writers. Output is a directory of part files, published by Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunekit.functions.arrays import quoted
from tunekit.functions.text import remove_nul
from tunekit.sources.datasets import FORMATS, FormatError, _suffix, read_dataset
from tunekit.sources.one_array import write_json_array
from tunekit.sources.shared import bounded_batches

MODES = ("errorifexists", "overwrite", "append")


class EmptyDataset(ValueError):
    pass


def _ordered(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Restore row order across files (range partitioning plus a sort) and drop the order columns."""
    return df.orderBy(*order).drop(*order) if order else df


def flat_columns(df: DataFrame) -> DataFrame:
    """Columns sorted by name, nested values as JSON text, NUL characters removed."""
    cells: list[Column] = []
    for name, dtype in sorted(df.dtypes):
        cell = F.col(f"`{name}`")
        if dtype.startswith(("struct", "array", "map", "variant")):
            cell = F.to_json(cell)
        cells.append(remove_nul(cell.cast("string")).alias(name.replace("\x00", "")))
    return df.select(*cells)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", nulls: bool = True) -> None:
    """One object per line; without ``nulls`` NULL fields are left out, and an all-NULL column is lost."""
    df.write.mode(mode).option("ignoreNullFields", str(not nulls).lower()).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", nulls: bool = True) -> None:
    """Every part file is one JSON array, so parts are written in parallel; ``nulls`` as in :func:`write_jsonl`."""

    def bracket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            if batch.num_rows:
                leads = pa.array([lead] + [","] * (batch.num_rows - 1), pa.string())
                lead = ","
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(leads, batch.column(0).cast(pa.string()), "")], names=["value"])
        if lead == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    options = {"ignoreNullFields": str(not nulls).lower()}
    row = F.struct(*[quoted(c) for c in df.columns])
    text = df.select(F.to_json(row, options).alias("value"))
    bounded_batches(df.sparkSession)
    text.mapInArrow(bracket, "value string").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Header, every cell quoted (a bare leading blank would be lost on reading), quotes doubled,
    NULL as an empty cell."""
    (
        flat_columns(df)
        .write.mode(mode)
        .option("header", "true")
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("quoteAll", "true")
        .csv(path)
    )


def write_dataset(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    mode: str = "errorifexists",
    order: tuple[str, ...] = (),
    allow_empty: bool = False,
    nulls: bool = True,
    one_array: bool = False,
) -> None:
    """Write any supported format; without ``fmt`` the path's suffix decides, else JSON Lines.

    With ``one_array`` the files of a JSON dataset make one array together (:mod:`tunekit.sources.one_array`)
    instead of one each.

    An empty dataset is refused; appending nothing is a no-op. The check computes a first row, so
    pass ``allow_empty`` for the output of a model whose replies were not staged.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    fmt = fmt or FORMATS.get(_suffix(path), "jsonl")
    if fmt not in FORMATS.values():
        raise FormatError(f"Unsupported format: {fmt}")
    if not allow_empty and df.isEmpty():
        if mode == "append":
            return
        raise EmptyDataset("no rows to write")
    df = _ordered(df, order)
    if fmt == "jsonl":
        write_jsonl(df, path, mode, nulls)
    elif fmt == "json":
        (write_json_array if one_array else write_json)(df, path, mode, nulls)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        write_csv(df, path, "," if fmt == "csv" else "\t", mode)


def convert(
    spark: SparkSession,
    source: str,
    target: str,
    source_fmt: str | None = None,
    target_fmt: str | None = None,
    mode: str = "errorifexists",
    schema: T.StructType | str | None = None,
    strict: bool = True,
    multiline: bool = True,
    nulls: bool = True,
) -> None:
    """Read one format, write another; the options are those of the reader and the writer."""
    df = read_dataset(spark, source, source_fmt, schema, strict, multiline=multiline)
    write_dataset(df, target, target_fmt, mode, nulls=nulls)
