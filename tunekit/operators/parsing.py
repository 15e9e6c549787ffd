"""Document parsing: one pass over decoded files, every type handled inside its row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions import html as H
from tunekit.functions import json_text as J
from tunekit.functions.arrays import bind
from tunekit.functions.text import extension, file_name, has_text, strip
from tunekit.operators import sections as S
from tunekit.sources.shared import bounded_batches

METADATA_TYPE = "map<string,string>"

# Document type by extension, and programming language by extension.
CODE_LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".rb": "ruby",
}
DOC_TYPES = {
    ".md": "markdown",
    ".markdown": "markdown",
    ".html": "html",
    ".htm": "html",
    ".txt": "text",
    ".json": "json",
    ".pdf": "pdf",
    **{ext: "code" for ext in CODE_LANGUAGES},
}


PagesOf = Callable[[bytes], Iterable[tuple[int, str | None, str | None]]]


class UnsupportedFormat(ValueError):
    def __init__(self, ext: str, supported: Iterable[str]):
        self.supported = sorted(supported)
        super().__init__(f"Unsupported format: {ext}. Supported: {', '.join(self.supported)}")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_extension(ext: str) -> str:
    ext = ext.lower()
    return ext if ext.startswith(".") else "." + ext


@dataclass
class Parsers:
    """Parsers by extension: the built-in types plus what the user registers.

    A registered parser maps the decoded text Column to the content Column; its sections default to
    one section over all lines. A registered page parser is a Python function from a file's bytes to its
    pages, for formats that no expression can read (:func:`page_rows`).
    """

    doc_types: dict[str, str] = field(default_factory=lambda: dict(DOC_TYPES))
    custom: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = field(
        default_factory=dict
    )
    paged: dict[str, PagesOf] = field(default_factory=dict)

    def register(
        self,
        extensions: Iterable[str],
        doc_type: str,
        to_content: Callable[[Column], Column],
        to_sections: Callable[[Column], Column] = S.single_section,
    ) -> Parsers:
        for ext in map(normalize_extension, extensions):
            self.doc_types[ext] = doc_type
            self.custom[ext] = (to_content, to_sections)
        return self

    def register_pages(self, extensions: Iterable[str], doc_type: str, pages_of: PagesOf) -> Parsers:
        for ext in map(normalize_extension, extensions):
            self.doc_types[ext] = doc_type
            self.custom.pop(ext, None)
            self.paged[ext] = pages_of
        return self

    def supported(self) -> list[str]:
        return sorted(self.doc_types)

    def is_supported(self, path: Column) -> Column:
        return extension(path).isin(*self.supported())

    def doc_type(self, path: Column) -> Column:
        """Document type of a path, NULL when no parser is registered for its extension."""
        return _lookup(self.doc_types, extension(path))

    def is_paged(self, path: Column) -> Column:
        """Whether a path is a paged document: it has a page parser, or is of a paged type without a text parser of its own."""
        own = extension(path).isin(*self.custom) if self.custom else F.lit(False)
        registered = extension(path).isin(*self.paged) if self.paged else F.lit(False)
        return F.coalesce(((self.doc_type(path) == "pdf") | registered) & ~own, F.lit(False))

    def require(self, path: str) -> str:
        """Document type of one path, or an error that lists the supported formats."""
        name = path.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        ext = name[dot:].lower() if 0 < dot < len(name) - 1 else ""
        if ext not in self.doc_types:
            raise UnsupportedFormat(ext, self.doc_types)
        return self.doc_types[ext]


def code_language(path: Column) -> Column:
    return F.coalesce(_lookup(CODE_LANGUAGES, extension(path)), F.lit("unknown"))


def _html_metadata(content: Column, terminated: bool) -> Column:
    pairs = F.array(
        F.struct(F.lit("title").alias("key"), H.html_title(content, terminated).alias("value")),
        F.struct(F.lit("description").alias("key"), H.html_description(content, terminated).alias("value")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def parse_documents(
    df: DataFrame,
    parsers: Parsers | None = None,
    path_col: str = "source_path",
    text_col: str = "raw_text",
    html_method: str = "regex",
    html_terminated: bool = False,
) -> DataFrame:
    """Add ``doc_type, content, metadata, sections, error`` and drop the raw text.

    All types share one scan: each branch sees its own rows' text and NULL for the others, so
    neither the regexes nor the entity decoder run on foreign documents. Rows that cannot be parsed
    keep NULL content and an ``error``. ``html_terminated`` decodes only entities that end in a semicolon.
    """
    parsers = parsers or Parsers()
    path, raw = F.col(path_col), F.col(text_col)
    typed = df.withColumn("_ext", extension(path)).withColumn("doc_type", parsers.doc_type(path))

    custom_exts = list(parsers.custom)
    builtin = ~F.col("_ext").isin(*custom_exts) if custom_exts else F.lit(True)

    def only(name: str) -> Column:
        return F.when(builtin & (F.col("doc_type") == name), raw)

    typed = bind(typed, "_leaves", J.string_leaves(only("json")))
    content = (
        F.when(builtin & F.col("doc_type").isin("markdown", "text", "code"), raw)
        .when(builtin & (F.col("doc_type") == "html"), H.html_text(only("html"), html_method, html_terminated))
        .when(
            builtin & (F.col("doc_type") == "json"),
            F.array_join("_leaves", "\n"),
        )
    )
    paged = F.col("_ext").isin(*parsers.paged) if parsers.paged else F.lit(False)
    for ext, (to_content, _) in parsers.custom.items():
        content = content.when(F.col("_ext") == ext, to_content(F.when(F.col("_ext") == ext, raw)))

    no_metadata = F.create_map().cast(METADATA_TYPE)
    metadata = (
        F.when(builtin & (F.col("doc_type") == "markdown"), S.markdown_metadata(only("markdown")))
        .when(builtin & (F.col("doc_type") == "html"), _html_metadata(only("html"), html_terminated))
        .when(builtin & (F.col("doc_type") == "json"), S.json_metadata(only("json")))
        .when(
            builtin & (F.col("doc_type") == "code"),
            F.create_map(
                F.lit("language"),
                code_language(path),
                F.lit("extension"),
                F.col("_ext"),
                F.lit("filename"),
                file_name(path),
            ),
        )
        .otherwise(no_metadata)
    )
    parsed = bind(typed.withColumn("metadata", metadata), "content", content)

    body = F.col("content")
    found = (
        F.when(builtin & (F.col("doc_type") == "markdown"), S.markdown_sections(body))
        .when(builtin & (F.col("doc_type") == "text"), S.text_sections(body))
        .when(builtin & (F.col("doc_type") == "code"), S.code_sections(body, code_language(path)))
        .when(builtin & (F.col("doc_type") == "html"), S.single_section(body))
        .when(builtin & (F.col("doc_type") == "json"), S.leaf_section(body, F.size("_leaves")))
    )
    for ext, (_, to_sections) in parsers.custom.items():
        found = found.when(F.col("_ext") == ext, to_sections(body))

    listing = ", ".join(parsers.supported())
    error = (
        F.when(
            F.col("doc_type").isNull(),
            F.concat(F.lit("Unsupported format: "), F.col("_ext"), F.lit(f". Supported: {listing}")),
        )
        .when(builtin & ((F.col("doc_type") == "pdf") | paged), "Paged document: needs a page extractor")
        .when(body.isNull() & (F.col("doc_type") == "json"), "Invalid JSON")
        .when(body.isNull(), "Parser returned no content")
    )
    rest = [c for c in df.columns if c != text_col]
    return parsed.withColumn("sections", found).withColumn("error", error).select(
        *rest, "doc_type", "content", "metadata", "sections", "error"
    )


# --- paged documents -------------------------------------------------------------------------

PAGES_TYPE = "array<struct<page:int,text:string,error:string>>"
PAGE_BYTES = 1 << 20  # text that is held before it is handed on


def page_rows(
    files: DataFrame,
    pages_of: PagesOf | Parsers,
    path_col: str = "source_path",
    bytes_col: str = "bytes",
) -> DataFrame:
    """``source_path, doc_type, page, text, error``: a row for every page, handed on as the parser yields it.

    ``pages_of`` yields ``(page, text, error)``, pages counting from 1; with ``Parsers`` each file goes to the
    page parser of its extension. Only about ``PAGE_BYTES`` of text are held at a time, so a file may have
    any number of pages if its parser yields them one by one. A file that fails has a row with page NULL
    and the error, behind the pages that came before it.
    """
    by_ext = pages_of.paged if isinstance(pages_of, Parsers) else {}
    kinds = pages_of.doc_types if isinstance(pages_of, Parsers) else {}
    kind = pa.schema([("source_path", pa.string()), ("doc_type", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def pages(path: str, ext: str, data: bytes | None) -> Iterator[tuple]:
        doc_type = kinds.get(ext, "pdf")
        try:
            if by_ext and ext not in by_ext:
                raise ValueError(f"no page parser for {ext or 'this name'}")
            for page, text, failure in (by_ext.get(ext) or pages_of)(bytes(data or b"")):
                yield path, doc_type, page, text, failure
        except Exception as exc:
            yield path, doc_type, None, None, f"Failed to parse {path}: {exc}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                path, ext, data = (batch.column(c)[i].as_py() for c in range(3))
                for row in pages(path, ext, data):
                    held.append(row)
                    size += len(row[3] or "") + 100
                    if size > PAGE_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in held], schema=kind)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in held], schema=kind)

    bounded_batches(files.sparkSession)
    rows = files.select(F.col(path_col).alias("source_path"), extension(F.col(path_col)).alias("ext"), F.col(bytes_col).alias("bytes"))
    return rows.mapInArrow(run, "source_path string, doc_type string, page int, text string, error string")


def page_documents(pages: DataFrame) -> DataFrame:
    """Every page of :func:`page_rows` as a parsed document of its own, for chunking without a row that holds a whole file.

    ``source_path, page, doc_type, content, metadata, sections, error``; blank pages are left out, and a page
    or file that failed has NULL content and its error.
    """
    text = F.when(F.col("error").isNull(), F.col("text"))
    section = F.struct(
        F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"),
        strip(text).alias("content"),
        F.lit(1).alias("level"),
        (F.col("page") - 1).alias("start_line"),
        (F.col("page") - 1).alias("end_line"),
    ).cast(S.SECTION_TYPE)
    return pages.filter(F.col("error").isNotNull() | has_text(F.col("text"))).select(
        "source_path",
        "page",
        "doc_type",
        text.alias("content"),
        F.create_map(F.lit("page"), F.col("page").cast("string")).cast(METADATA_TYPE).alias("metadata"),
        F.when(text.isNotNull(), F.array(section)).alias("sections"),
        "error",
    )


def extract_pages(
    files: DataFrame,
    pages_of: Callable[[bytes], Iterable[tuple[int, str | None, str | None]]],
    path_col: str = "source_path",
    bytes_col: str = "bytes",
) -> DataFrame:
    """``source_path, pages, error`` from a user's extractor of one file's bytes.

    The extractor yields ``(page, text, error)``, pages counting from 1. A file it cannot open has
    NULL pages and an error.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch[path_col], batch[bytes_col], strict=True):
                pages, error = None, None
                try:
                    pages = [
                        {"page": page, "text": text, "error": failure}
                        for page, text, failure in pages_of(bytes(data))
                    ]
                except Exception as exc:
                    error = f"Failed to parse {path}: {exc}"
                yield pd.DataFrame(
                    {"source_path": [path], "pages": [pages], "error": [error]}, dtype=object
                )

    bounded_batches(files.sparkSession)
    return files.select(path_col, bytes_col).mapInPandas(
        run, f"source_path string, pages {PAGES_TYPE}, error string"
    )


def with_page_content(df: DataFrame, pages_col: str = "pages") -> DataFrame:
    """Replace an array of pages by ``doc_type, content, metadata, sections``; no shuffle.

    Blank pages are skipped; a failed page leaves a notice in the content but no section.
    """
    pages = F.col(pages_col)

    def usable(p: Column) -> Column:
        return has_text(p["text"]) & p["error"].isNull()

    def shown(p: Column) -> Column:
        notice = F.concat(
            F.lit("[Error extracting page "),
            p["page"].cast("string"),
            F.lit(": "),
            p["error"],
            F.lit("]"),
        )
        return F.when(p["error"].isNotNull(), notice).when(usable(p), p["text"])

    def section(title: Column, body: Column, level: int, line: Column) -> Column:
        return F.struct(
            title.alias("title"),
            strip(body).alias("content"),
            F.lit(level).alias("level"),
            line.alias("start_line"),
            line.alias("end_line"),
        ).cast(S.SECTION_TYPE)

    content = F.array_join(
        F.filter(F.transform(pages, shown), lambda text: text.isNotNull()), "\n\n"
    )
    sections = F.transform(
        F.filter(pages, usable),
        lambda p: section(
            F.concat(F.lit("Page "), p["page"].cast("string")), p["text"], 1, p["page"] - 1
        ),
    )
    whole = F.array(section(F.lit(None).cast("string"), F.col("content"), 0, F.lit(0)))
    rest = [c for c in df.columns if c != pages_col]
    read = pages.isNotNull()
    return bind(df, "content", content).select(
        *rest,
        F.lit("pdf").alias("doc_type"),
        "content",
        F.when(
            read, F.create_map(F.lit("page_count"), F.size(pages).cast("string"))
        ).alias("metadata"),
        F.when(read, F.when(F.size(sections) > 0, sections).otherwise(whole)).alias("sections"),
    )


def assemble_pages(pages: DataFrame, key: str = "source_path") -> DataFrame:
    """One document per key from a table of page rows ``(key, page, text, error)``.

    Only for pages that already live apart: this shuffles them by key, and the result row of a key
    holds all its pages.
    """
    page = F.struct("page", "text", "error").cast("struct<page:int,text:string,error:string>")
    return with_page_content(
        pages.groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    )
