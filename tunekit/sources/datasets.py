"""Dataset readers: JSON Lines, JSON arrays, CSV, TSV and Parquet, with detection by name or content."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunekit.functions import json_text as J
from tunekit.functions.arrays import bind, quoted
from tunekit.functions.text import extension, has_text, is_blank, remove_nul, strip
from tunekit.operators.fields import union_datasets
from tunekit.operators.limits import head_rows
from tunekit.sources.delimited import read_delimited
from tunekit.sources.json_arrays import item_runs
from tunekit.sources.shared import work_dir

# Dataset format by file extension, and extensions whose content decides.
FORMATS = {
    ".jsonl": "jsonl",
    ".json": "json",
    ".csv": "csv",
    ".tsv": "tsv",
    ".parquet": "parquet",
}
SNIFFED = (".txt", ".data")

ORDER_COLUMNS = ("_file", "_block", "_seq")


class FormatError(ValueError):
    pass


def format_of_name(path: Column) -> Column:
    """Format by extension, 'sniff' where the content decides, NULL for anything else."""
    ext = extension(path)
    out = F.when(ext.isin(*SNIFFED), "sniff")
    for suffix, name in FORMATS.items():
        out = out.when(ext == suffix, name)
    return out


def format_of_line(first_line: Column) -> Column:
    """Format by a file's first line: a JSON object is JSON Lines, then comma, then tab."""
    line = strip(F.coalesce(first_line, F.lit("")))
    return (
        F.when(J.is_object(J.parse(line)), "jsonl")
        .when(F.contains(line, F.lit(",")), "csv")
        .when(F.contains(line, F.lit("\t")), "tsv")
        .otherwise("jsonl")
    )


def with_row_order(df: DataFrame) -> DataFrame:
    """Add ``_file, _block, _seq``: sorting by them restores the order of rows in the files.

    A parallel scan has no line numbers; a split of a file is read in order by one task.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime`` of the files under a path; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "length", "modificationTime")
    )


def detect_format(spark: SparkSession, path: str) -> str:
    """Format of one path. A directory is decided by its files and must hold one format."""
    suffix = _suffix(path)
    if suffix in FORMATS:
        return FORMATS[suffix]
    if suffix in SNIFFED:
        return _sniff(spark, path)
    kinds = [
        r[0]
        for r in list_files(spark, path)
        .select(F.coalesce(format_of_name(F.col("path")), F.lit("")))
        .distinct()
        .collect()
    ]
    found = sorted(k for k in kinds if k)
    if not found:
        raise FormatError(f"Unsupported file format: {suffix or path}")
    if len(found) > 1:
        raise FormatError(f"{path} mixes formats: {', '.join(found)}; use read_directory")
    return _sniff(spark, path) if found[0] == "sniff" else found[0]


def _sniff(spark: SparkSession, path: str) -> str:
    # Only the first rows of the first split are read.
    first = spark.read.text(path).limit(1).select(format_of_line(F.col("value"))).first()
    return first[0] if first else "jsonl"


# --- JSON Lines ------------------------------------------------------------------------------


def parse_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON Lines rows: ``value`` (VARIANT object) and, for a bad line, ``error``. Blank lines go."""
    rest = [c for c in lines.columns if c != text_col]
    full = lines.filter(~is_blank(F.col(text_col)))
    parsed = bind(full, "_v", J.parse(strip(F.col(text_col))))
    error = F.when(F.col("_v").isNull(), "Invalid JSON").when(
        ~J.is_object(F.col("_v")),
        F.concat(F.lit("Line is no JSON object but "), J.kind(F.col("_v"))),
    )
    return parsed.select(
        *rest,
        F.when(error.isNull(), F.col("_v")).alias("value"),
        error.alias("error"),
        F.when(error.isNotNull(), F.col(text_col)).alias("bad_line"),
    )


def scan_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every non-blank line with its order columns; see :func:`parse_lines`."""
    return parse_lines(with_row_order(spark.read.text(path)))


def read_jsonl_variant(
    spark: SparkSession, path: str | Sequence[str], strict: bool = True
) -> DataFrame:
    """Free-form JSON Lines rows as one VARIANT column; strict mode raises at the first bad line."""
    rows = scan_jsonl(spark, path)
    if strict:
        return rows.select(
            F.when(
                F.col("error").isNotNull(),
                F.raise_error(F.concat(F.col("error"), F.lit(" in "), F.col("_file"))),
            )
            .otherwise(F.col("value"))
            .alias("value"),
            *ORDER_COLUMNS,
        )
    return rows.filter(F.col("error").isNull()).drop("error", "bad_line")


def quarantined_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return scan_jsonl(spark, path).filter(F.col("error").isNotNull()).drop("value")


def bad_line_numbers(spark: SparkSession, files: str | Sequence[str]) -> DataFrame:
    """``file, line, error`` (lines from 1) of bad lines.

    Lines are counted per split of a file; the splits before a line's own and its place within that
    give its number, so a file of any size is read in parallel.
    """
    rows = with_row_order(spark.read.text(files))
    splits = rows.groupBy("_file", "_block").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bad = parse_lines(rows).filter(F.col("error").isNotNull())
    line = F.col("_before") + F.col("_seq") - F.col("_first") + 1
    return bad.join(splits, ["_file", "_block"]).select(F.col("_file").alias("file"), line.alias("line"), "error")


def is_valid_jsonl(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """One row: whether every non-blank line is JSON (of any kind), with the counts."""
    text = F.col(text_col)
    checked, bad = F.count_if(~is_blank(text)), F.count_if(
        ~is_blank(text) & J.parse(strip(text)).isNull()
    )
    return lines.agg((bad == 0).alias("valid"), checked.alias("lines"), bad.alias("bad_lines"))


# --- typed readers ---------------------------------------------------------------------------


def _inferred(reader, path: str | Sequence[str]) -> T.StructType:
    """The fields Spark finds in the valid records, in one pass over the files."""
    found = reader.option("maxStringLen", J.STRICT["maxStringLen"]).json(path).schema
    return T.StructType([f for f in found.fields if f.name != "_corrupt_record"])


def _refused(error: Column, *about: Column) -> Column:
    return F.raise_error(F.concat_ws(" ", error, F.lit("in"), F.col("_file"), *about))


def _as_schema(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def read_jsonl(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Typed JSON Lines. Without a schema Spark infers it in one extra pass over the files.

    Every line must be one JSON object from end to end. A strict read fails at a line that isn't, with
    its file and beginning; else such lines are left out (see :func:`quarantined_lines`).
    """
    return _typed_lines(spark, spark.read.text(path), schema, strict, lambda: _inferred(spark.read, path))


def _typed_lines(spark, lines, schema, strict, infer) -> DataFrame:
    schema = _as_schema(spark, schema) if schema is not None else infer()
    rows = lines.select("value", F.col("_metadata.file_path").alias("_file")).filter(~is_blank(F.col("value")))
    text = strip(F.col("value"))
    good = J.is_valid(text) & F.startswith(text, F.lit("{"))
    if strict:
        bad = F.when(J.is_valid(text), "Line holds no JSON object").otherwise("Invalid JSON")
        text = F.when(good, text).otherwise(_refused(bad, F.lit("at:"), F.left(text, F.lit(80))))
    else:
        rows = rows.filter(good)
    options = J.STRICT | {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return bind(rows, "_row", F.from_json(text, schema, options)).select("_row.*")


def read_json(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    strict: bool = True,
    joined_files: bool = False,
) -> DataFrame:
    """Files that hold one JSON array of objects each, of any size (:mod:`tunekit.sources.json_arrays`).

    With ``joined_files`` the files are one array together, as ``write_json_array`` leaves them.

    A strict read fails at a file that holds anything else, or something after its array (a file of no
    bytes has no items); else such files, and items that are no objects, are left out, which takes
    another pass to find such files.
    """
    return _typed_arrays(spark, item_runs(spark, path, joined_files=joined_files), schema, strict)


def _typed_arrays(spark: SparkSession, runs: DataFrame, schema: T.StructType | str | None, strict: bool) -> DataFrame:
    text = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    if schema is None:
        # A run is a line when the line breaks between its values are blanks; strings hold none.
        place = work_dir(spark, "items")
        runs.filter(F.col("items").isNotNull()).select(F.translate(text, "\n\r", "  ")).write.text(place)
        schema = _inferred(spark.read, place)
    schema = _as_schema(spark, schema)
    rows = runs.withColumnRenamed("file", "_file")
    error = F.coalesce(F.col("error"), F.when(~J.is_valid(text), "Invalid JSON"))
    if strict:
        text = F.when(error.isNull(), text).otherwise(_refused(error))
    else:
        bad = rows.filter(error.isNotNull()).select("_file").distinct()
        rows = rows.join(bad, "_file", "left_anti")
    options = J.STRICT | {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    found = F.from_json(text, T.ArrayType(schema), options)
    if not strict:
        # One item that is no object makes the whole array NULL.
        objects = F.filter(J.items(J.parse(F.when(found.isNull(), text))), J.is_object)
        found = F.coalesce(found, F.transform(objects, lambda v: F.from_json(F.to_json(v), schema, options)))
    items = bind(rows, "_items", found).select("_file", F.explode("_items").alias("_row"))
    if strict:
        items = items.withColumn("_row", F.when(F.col("_row").isNotNull(), F.col("_row")).otherwise(_refused(F.lit("Item is no JSON object"))))
    return items.filter(F.col("_row").isNotNull()).select("_row.*")


def clean_cells(df: DataFrame) -> DataFrame:
    """NUL characters removed, blank cells NULL, rows of only blank cells dropped."""
    cells = []
    for name in df.columns:
        text = remove_nul(F.col(f"`{name}`"))
        cells.append(F.when(has_text(text), text).alias(name.replace("\x00", "")))
    return df.select(*cells).dropna(how="all")


RAW = "_raw_row"


def _csv_reader(spark: SparkSession, sep: str):
    return (
        spark.read.option("header", "true")
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("enforceSchema", "false")
        .option("maxCharsPerColumn", "-1")
    )


def _cells(raw: Column, sep: str) -> Column:
    """All cells of one delimited row, quotes taken off."""
    cut = re.escape(sep)
    found = F.regexp_extract_all(raw, F.lit(rf'(?:^|{cut})[ \t]*("(?:[^"]|"")*"|[^{cut}]*)'), F.lit(1))
    return F.transform(
        found,
        lambda c: F.when(F.startswith(c, F.lit('"')), F.regexp_replace(F.regexp_replace(c, r'^"|"\s*$', ""), '""', '"')).otherwise(c),
    )


def _one_header(reader, path: str | Sequence[str], sep: str, extra: str | None) -> DataFrame:
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, RAW]])
    raw = reader.schema(schema).option("columnNameOfCorruptRecord", RAW).csv(path)
    # Spark hands over the text of rows with another number of cells than the header.
    more = F.slice(_cells(F.col(RAW), sep), len(names) + 1, 1 << 20)
    some = F.coalesce(F.size(more) > 0, F.lit(False))
    if extra is None:
        refused = F.raise_error(F.concat(F.lit("Row with more cells than its header (name a column for them with extra=): "), F.left(F.col(RAW), F.lit(80))))
        return clean_cells(raw.filter(F.when(some, refused).otherwise(F.lit(True))).select(*map(quoted, names)))
    return clean_cells(raw.select(*map(quoted, names), F.when(some, F.to_json(more)).alias(extra)))


def _refuse_cut_rows(lines: DataFrame, sep: str) -> None:
    """Raise for a line that opens a quoted cell and doesn't close it."""
    text = F.col("value")
    odd = (F.length(text) - F.length(F.translate(text, '"', ""))) % 2 == 1
    cut = lines.filter(odd & text.rlike(rf'(?:^|{re.escape(sep)}) *"')).select(F.col("_metadata.file_path"), F.left(text, F.lit(80))).first()
    if cut is not None:
        raise FormatError(f"{cut[0]}: a quoted cell goes on behind its line, read it with multiline=True: {cut[1]}")


def csv_headers(spark: SparkSession, path: str | Sequence[str], recursive: bool = False, names: str = "*") -> DataFrame:
    """``header, files``: the first lines of the files under a path and the files that have each."""
    lines = (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", names)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumn("seq", F.monotonically_increasing_id())
        .filter(F.col("block") == 0)
    )
    first = lines.groupBy("file").agg(F.min_by("value", "seq").alias("header"))
    return first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files"))


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    multiline: bool = True,
    extra: str | None = None,
    one_header: bool = False,
) -> DataFrame:
    """Delimited text with a header; every cell is a string.

    ``multiline`` allows line breaks inside quotes, in files of any size (:mod:`tunekit.sources.delimited`).
    Without it Spark's reader for single lines is used, and a row that goes on behind its line raises.
    Files with different headers give the union of their columns; with ``one_header`` all must be
    equal. A row with more cells than its header raises, or, with ``extra``, keeps the surplus as a
    JSON array in a column of that name.
    """
    if multiline:
        return clean_cells(read_delimited(spark, path, sep, extra, one_header)[0])
    _refuse_cut_rows(spark.read.text(path), sep)
    if not one_header and len(spark.read.text(path).inputFiles()) > 1:
        found = csv_headers(spark, path)
        if found.count() > 1:
            parts = [_one_header(_csv_reader(spark, sep), r["files"], sep, extra) for r in found.orderBy("header").collect()]
            return union_datasets(parts, ordinal=None)
    return _one_header(_csv_reader(spark, sep), path, sep, extra)


def read_dataset(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    strict: bool = True,
    warn_empty: bool = False,
    multiline: bool = True,
    extra: str | None = None,
) -> DataFrame:
    """Read any supported format; ``fmt`` overrides detection (several paths need it). ``multiline`` and ``extra`` are those of :func:`read_csv`."""
    fmt = fmt or detect_format(spark, path)
    if fmt == "jsonl":
        df = read_jsonl(spark, path, schema, strict)
    elif fmt == "json":
        df = read_json(spark, path, schema, strict)
    elif fmt in ("csv", "tsv"):
        df = read_csv(spark, path, "," if fmt == "csv" else "\t", multiline, extra)
    elif fmt == "parquet":
        df = spark.read.option("mergeSchema", "true").parquet(*([path] if isinstance(path, str) else path))
    else:
        raise FormatError(f"Unsupported format: {fmt}")
    if warn_empty and df.isEmpty():
        warnings.warn(f"{path} is empty", stacklevel=2)
    return df


def read_directory(
    spark: SparkSession, path: str, recursive: bool = True, strict: bool = True, multiline: bool = True, extra: str | None = None
) -> DataFrame:
    """A directory of mixed formats: one scan per format present, over the union of fields."""
    listed = list_files(spark, path, recursive).select(
        "path", format_of_name(F.col("path")).alias("fmt")
    )
    kinds = sorted(r[0] for r in listed.select("fmt").distinct().collect() if r[0])
    if not kinds:
        raise FormatError(f"No supported dataset file under {path}")
    suffixes = {v: k for k, v in FORMATS.items()}
    deep = str(recursive).lower()
    parts = []
    for fmt in kinds:
        if fmt == "sniff":
            parts += _read_sniffed(spark, path, recursive)
            continue
        names = "*" + _any_case(suffixes[fmt])

        def reader(names: str = names):
            return spark.read.option("recursiveFileLookup", deep).option("pathGlobFilter", names)

        if fmt == "jsonl":
            parts.append(_typed_lines(spark, reader().text(path), None, strict, lambda r=reader: _inferred(r(), path)))
        elif fmt == "json":
            parts.append(_typed_arrays(spark, item_runs(spark, path, recursive, names), None, strict))
        elif fmt == "parquet":
            parts.append(reader().option("mergeSchema", "true").parquet(path))
        elif multiline:
            cells, _ = read_delimited(spark, path, "," if fmt == "csv" else "\t", extra, recursive=recursive, names=names)
            parts.append(clean_cells(cells))
        else:
            for row in csv_headers(spark, path, recursive, names).orderBy("header").collect():
                parts.append(read_csv(spark, row["files"], "," if fmt == "csv" else "\t", multiline, extra, one_header=True))
    return union_datasets(_aligned(parts), ordinal=None)


def sniffed_formats(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``file, fmt`` of every ``.txt`` and ``.data`` file, by its first line, in one job."""
    names = "{" + ",".join("*" + _any_case(s) for s in SNIFFED) + "}"
    lines = (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", names)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .withColumn("seq", F.monotonically_increasing_id())
        .filter(F.col("block") == 0)
    )
    first = lines.groupBy("file").agg(F.min_by("value", "seq").alias("line"))
    return first.select("file", format_of_line(F.col("line")).alias("fmt"))


def _read_sniffed(spark: SparkSession, path: str, recursive: bool) -> list[DataFrame]:
    """One scan per format found; the driver holds file names only."""
    files: dict[str, list[str]] = {}
    for row in sniffed_formats(spark, path, recursive).collect():
        files.setdefault(row["fmt"], []).append(row["file"])
    readers = {
        "jsonl": lambda names: read_jsonl(spark, names),
        "csv": lambda names: read_csv(spark, names, ","),
        "tsv": lambda names: read_csv(spark, names, "\t"),
    }
    return [readers[fmt](sorted(names)) for fmt, names in sorted(files.items())]


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _aligned(parts: list[DataFrame]) -> list[DataFrame]:
    """Columns whose type differs between parts become text, nested ones as JSON."""
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for name, dtype in part.dtypes:
            kinds.setdefault(name, set()).add(dtype)
    mixed = {name for name, found in kinds.items() if len(found) > 1}
    out = []
    for part in parts:
        cells = []
        for name, dtype in part.dtypes:
            cell = F.col(f"`{name}`")
            if name in mixed and dtype.startswith(("struct", "array", "map")):
                cell = F.to_json(cell)
            elif name in mixed:
                cell = cell.cast("string")
            cells.append(cell.alias(name))
        out.append(part.select(*cells))
    return out


# --- mirrored datasets -----------------------------------------------------------------------


def read_mirror(
    spark: SparkSession,
    root: str,
    name: str,
    config: str = "default",
    split: str = "train",
    max_entries: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A named dataset from local or object-store files laid out as ``root/name/config/split``.

    ``max_entries`` of None or 0 reads everything; a limit stops scanning early.
    """
    df = read_dataset(spark, f"{root}/{name}/{config}/{split}", fmt)
    return head_rows(df, max_entries) if max_entries else df


def describe_mirror(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet"
) -> DataFrame:
    """``config, split, rows, fields`` of a mirrored dataset, from file paths and footers."""
    base = f"{root}/{name}"
    reader = spark.read.option("recursiveFileLookup", "true")
    if fmt == "parquet":
        df = reader.option("mergeSchema", "true").parquet(base)
    elif fmt in ("jsonl", "json"):
        df = reader.option("multiLine", str(fmt == "json").lower()).json(base)
    elif fmt in ("csv", "tsv"):
        df = reader.option("header", "true").option("sep", "," if fmt == "csv" else "\t").option("escape", '"').option("multiLine", "true").csv(base)
    else:
        raise FormatError(f"Unsupported mirror format: {fmt}")
    fields = ", ".join(f"{n}: {t}" for n, t in df.dtypes)
    where = F.col("_metadata.file_path")
    return (
        df.select(
            F.element_at(F.split(where, "/"), -3).alias("config"),
            F.element_at(F.split(where, "/"), -2).alias("split"),
        )
        .groupBy("config", "split")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("fields", F.lit(fields))
    )
