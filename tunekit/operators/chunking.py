"""Splitting documents into chunks: fixed windows, semantic pieces, and the greedy merge of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions.arrays import indexes, let, running_states, running_sum
from tunekit.functions.text import (
    BLANK_LINE,
    UNICODE,
    WS,
    has_text,
    match_spans,
    split_with_offsets,
    strip,
    windows,
)

STRATEGIES = ("fixed_size", "semantic", "hybrid")

CHUNK_TYPE = (
    "struct<content:string,start_char:bigint,end_char:bigint,strategy:string,"
    "section_title:string,section_level:int,definition:string,language:string>"
)


@dataclass(frozen=True)
class ChunkConfig:
    chunk_size: int = 2000
    chunk_overlap: int = 200
    strategy: str = "hybrid"

    def __post_init__(self) -> None:
        if self.chunk_size < 100:
            raise ValueError("chunk_size must be at least 100")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be in [0, chunk_size)")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")


def _chunk(
    content: Column,
    start: Column,
    end: Column,
    strategy: str,
    title: Column | None = None,
    level: Column | None = None,
    definition: Column | None = None,
    language: Column | None = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        content.alias("content"),
        start.alias("start_char"),
        end.alias("end_char"),
        F.lit(strategy).alias("strategy"),
        (null if title is None else title).alias("section_title"),
        (null if level is None else level).alias("section_level"),
        (null if definition is None else definition).alias("definition"),
        (null if language is None else language).alias("language"),
    ).cast(CHUNK_TYPE)


def _restyle(chunk: Column, content: Column, start: Column, end: Column, strategy: str) -> Column:
    return _chunk(
        content,
        start,
        end,
        strategy,
        chunk["section_title"],
        chunk["section_level"],
        chunk["definition"],
        chunk["language"],
    )


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, consecutive ones sharing ``overlap``."""
    return F.transform(
        windows(text, size, overlap),
        lambda w: _chunk(
            w["content"], w["start"], w["start"] + F.length(w["content"]), "fixed_size"
        ),
    )


def paragraph_chunks(text: Column) -> Column:
    """Paragraphs between blank lines, stripped, at their true offsets."""
    return F.transform(
        split_with_offsets(text, BLANK_LINE),
        lambda p: _chunk(
            p["content"], p["start"], p["start"] + F.length(p["content"]), "paragraph"
        ),
    )


def _laid_end_to_end(texts: Column, keep, build) -> Column:
    """Place texts one after another with one separator each; offsets are ordinal, not source
    positions, because headings are rewritten."""

    def place(ts: Column) -> Column:
        ends = running_sum(F.transform(ts, lambda t: (F.length(t) + 1).cast("bigint")))
        return let(
            ends,
            lambda es: F.transform(
                F.filter(indexes(ts), lambda i: keep(F.get(ts, i))),
                lambda i: build(i, F.get(ts, i), F.get(es, i) - F.length(F.get(ts, i)) - 1),
            ),
        )

    return let(texts, place)


def markdown_chunks(sections: Column) -> Column:
    """One chunk per non-blank section, its heading put back on top."""

    def text_of(s: Column) -> Column:
        marks = F.when(
            s["level"] > 0, F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "))
        ).otherwise("")
        titled = F.concat(marks, s["title"], F.lit("\n\n"), s["content"])
        return F.when(F.length(s["title"]) > 0, titled).otherwise(s["content"])

    return let(
        sections,
        lambda secs: _laid_end_to_end(
            F.transform(secs, text_of),
            has_text,
            lambda i, text, start: _chunk(
                strip(text),
                start,
                start + F.length(text),
                "markdown_section",
                title=F.get(secs, i)["title"],
                level=F.get(secs, i)["level"],
            ),
        ),
    )


def code_chunks(sections: Column, language: Column) -> Column:
    """One chunk per non-blank code section, unstripped."""
    return let(
        sections,
        lambda secs: _laid_end_to_end(
            F.transform(secs, lambda s: s["content"]),
            has_text,
            lambda i, text, start: _chunk(
                text,
                start,
                start + F.length(text),
                "code_section",
                definition=F.get(secs, i)["title"],
                language=F.coalesce(language, F.lit("unknown")),
            ),
        ),
    )


def semantic_chunks(
    content: Column,
    doc_type: Column | None,
    sections: Column | None,
    language: Column,
    size: int,
    overlap: int,
) -> Column:
    """Pieces at natural boundaries; a piece longer than ``size`` is cut into fixed windows."""
    pieces = paragraph_chunks(content)
    if doc_type is not None and sections is not None:
        sectioned = F.size(sections) > 0
        pieces = (
            F.when((doc_type == "markdown") & sectioned, markdown_chunks(sections))
            .when((doc_type == "code") & sectioned, code_chunks(sections, language))
            .otherwise(pieces)
        )

    def fit(piece: Column) -> Column:
        whole = _restyle(
            piece, piece["content"], piece["start_char"], piece["end_char"], "semantic"
        )
        cut = F.transform(
            windows(piece["content"], size, overlap),
            lambda w: _restyle(
                piece,
                w["content"],
                piece["start_char"] + w["start"],
                piece["start_char"] + w["start"] + F.length(w["content"]),
                "semantic_fixed",
            ),
        )
        return F.when(F.length(piece["content"]) <= size, F.array(whole)).otherwise(cut)

    return F.flatten(F.transform(pieces, fit))


def merge_small(chunks: Column, size: int, joiner: str = "\n\n") -> Column:
    """Append neighbours while the joined text stays within ``size``.

    Only lengths go through the fold; the texts are joined once the boundaries are known.
    """
    gap = len(joiner)

    def extend(open_length: Column, length: Column) -> Column:
        fits = (open_length > 0) & (open_length + length + gap <= size)
        return F.when(fits, open_length + length + gap).otherwise(length)

    def merge(cs: Column) -> Column:
        lengths = F.transform(cs, lambda c: F.length(c["content"]).cast("bigint"))

        def by_start(starts: Column) -> Column:
            def group(at: Column, k: Column) -> Column:
                until = F.coalesce(F.get(starts, k + 1), F.size(cs))
                members = F.slice(cs, at + 1, until - at)
                first = F.get(cs, at)
                joined = F.array_join(F.transform(members, lambda c: c["content"]), joiner)
                return let(
                    joined,
                    lambda text: _restyle(
                        first,
                        strip(text),
                        first["start_char"],
                        first["start_char"] + F.length(text),
                        "hybrid_semantic",
                    ),
                )

            return F.filter(F.transform(starts, group), lambda c: c["content"] != "")

        return let(
            lengths,
            lambda ls: let(
                running_states(ls, extend),
                # The open length equals the piece's own length exactly where a chunk begins.
                lambda open_lengths: let(
                    F.filter(indexes(cs), lambda i: F.get(open_lengths, i) == F.get(ls, i)),
                    by_start,
                ),
            ),
        )

    return let(chunks, merge)


def split_content(
    config: ChunkConfig,
    content: Column,
    doc_type: Column | None = None,
    sections: Column | None = None,
    language: Column | None = None,
) -> Column:
    """Array of chunks of one document; empty for blank content."""
    language = F.lit(None).cast("string") if language is None else language
    size, overlap = config.chunk_size, config.chunk_overlap
    if config.strategy == "fixed_size":
        out = fixed_chunks(content, size, overlap)
    else:
        out = semantic_chunks(content, doc_type, sections, language, size, overlap)
        if config.strategy == "hybrid":
            out = merge_small(out, size)
    return F.when(has_text(content), out).otherwise(F.array().cast(f"array<{CHUNK_TYPE}>"))


def chunk_documents(
    df: DataFrame,
    config: ChunkConfig | None = None,
    content_col: str = "content",
    keep: tuple[str, ...] = ("source_path",),
) -> DataFrame:
    """Rows ``(*keep, chunk_index, content, start_char, end_char, strategy, …)``; no shuffle.

    Uses ``doc_type``, ``sections`` and ``metadata['language']`` when the input has them.
    """
    config = config or ChunkConfig()
    has = set(df.columns)
    chunks = split_content(
        config,
        F.col(content_col),
        F.col("doc_type") if "doc_type" in has else None,
        F.col("sections") if "sections" in has else None,
        F.col("metadata")["language"] if "metadata" in has else None,
    )
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "_c")).select(
        *keep, "chunk_index", "_c.*"
    )


# --- boundary search ------------------------------------------------------------------------


def boundaries(text: Column) -> Column:
    """Safe split positions, sorted and distinct: after blank lines, at headings, at code fences."""

    def line_start(span: Column) -> Column:
        return span["start"] + 1

    found = F.concat(
        F.transform(match_spans(text, BLANK_LINE), lambda s: s["end"]),
        F.transform(match_spans(text, rf"{UNICODE}\n#{{1,6}}{WS}"), line_start),
        F.transform(match_spans(text, "\n```"), line_start),
    )
    return F.array_sort(F.array_distinct(found))


def nearest_boundary(bounds: Column, target: Column, chunk_size: int) -> Column:
    """Last boundary at or before the target, else the first after it, within a quarter chunk;
    the target itself when there is none."""
    reach = chunk_size // 4
    near = F.filter(bounds, lambda b: (b >= target - reach) & (b <= target + reach))
    before = F.array_max(F.filter(near, lambda b: b <= target))
    return F.coalesce(before, F.array_min(near), target)
