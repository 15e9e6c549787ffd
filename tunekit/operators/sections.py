"""Sections and metadata of one document, computed inside its row (no shuffle of lines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunekit.functions import json_text as J
from tunekit.functions.arrays import indexes, let, positions_where
from tunekit.functions.text import UNICODE, WS, is_blank, lines_of, lstrip, strip

SECTION_TYPE = "struct<title:string,content:string,level:int,start_line:int,end_line:int>"

_HEADING = rf"{UNICODE}^{WS}*#{{1,6}}( |\z)"

# What counts as a definition line, per language. ``kind`` is a group number or a
# literal word; ``name`` is a group number. \s and \w cover Unicode.
DEFINITION_LINES: dict[str, list[tuple[str, int | str, int]]] = {
    "python": [(r"^(def|class)\s+(\w+)", 1, 2)],
    "javascript": [
        (r"^(function|class)\s+(\w+)", 1, 2),
        (r"^(const|let|var)\s+(\w+)\s*=\s*(function|\(|async)", "function", 2),
    ],
    "typescript": [
        (r"^(function|class)\s+(\w+)", 1, 2),
        (r"^(const|let|var)\s+(\w+)\s*=\s*(function|\(|async)", "function", 2),
    ],
    "java": [
        (
            r"^(public|private|protected)?\s*(static)?\s*(class|void|\w+)\s+(\w+)\s*[\({]",
            3,
            4,
        )
    ],
    "go": [
        (r"^func\s+(\([^)]+\)\s+)?(\w+)", "func", 2),
        (r"^type\s+(\w+)\s+(struct|interface)", "type", 1),
    ],
    "rust": [(r"^(pub\s+)?(fn|struct|enum|impl|trait)\s+(\w+)", 2, 3)],
    "c": [(r"^(class|struct)\s+(\w+)", 1, 2)],
    "cpp": [(r"^(class|struct)\s+(\w+)", 1, 2)],
    "ruby": [(r"^(def|class|module)\s+(\w+)", 1, 2)],
}


def _section(title: Column, content: Column, level: Column, start: Column, end: Column) -> Column:
    return F.struct(
        title.alias("title"),
        content.alias("content"),
        level.cast("int").alias("level"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
    ).cast(SECTION_TYPE)


def _no_title() -> Column:
    return F.lit(None).cast("string")


def _joined(lines: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, F.greatest(count, F.lit(0))), "\n")


def single_section(content: Column) -> Column:
    """One untitled section over all lines."""
    last = F.size(lines_of(content)) - 1
    return F.array(_section(_no_title(), content, F.lit(0), F.lit(0), last))


def leaf_section(content: Column, leaves: Column) -> Column:
    """One untitled section over JSON leaves, counted as one line each (-1 as its end for none)."""
    return F.array(_section(_no_title(), content, F.lit(0), F.lit(0), leaves - 1))


def markdown_sections(content: Column) -> Column:
    """Sections at ATX headings; the text before the first heading is an untitled section."""

    def build(lines: Column, heads: Column) -> Column:
        first = F.coalesce(F.get(heads, F.lit(0)), F.size(lines))
        preamble = _section(
            _no_title(), strip(_joined(lines, F.lit(0), first)), F.lit(0), F.lit(0), first - 1
        )

        def at(head: Column, k: Column) -> Column:
            line = F.get(lines, head)
            until = F.coalesce(F.get(heads, k + 1), F.size(lines))
            return _section(
                strip(F.regexp_replace(line, rf"{UNICODE}^{WS}*#{{1,6}}", "")),
                strip(_joined(lines, head + 1, until - head - 1)),
                F.length(F.regexp_extract(line, rf"{UNICODE}^{WS}*(#{{1,6}})", 1)),
                head,
                until - 1,
            )

        # A section needs a line below its heading or a title; the preamble needs a line.
        kept = F.filter(
            F.concat(F.array(preamble), F.transform(heads, at)),
            lambda s: F.when(s["title"].isNull(), s["end_line"] >= 0).otherwise(
                (s["title"] != "") | (s["end_line"] > s["start_line"])
            ),
        )
        whole = _section(
            _no_title(),
            strip(F.array_join(lines, "\n")),
            F.lit(0),
            F.lit(0),
            F.size(lines) - 1,
        )
        return F.when(F.size(kept) > 0, kept).otherwise(F.array(whole))

    return let(
        lines_of(content),
        lambda lines: let(
            positions_where(lines, lambda line: line.rlike(_HEADING)),
            lambda heads: build(lines, heads),
        ),
    )


def text_sections(content: Column) -> Column:
    """Sections separated by blank lines.

    In a run of blank lines, every second one closes the empty section opened by the one before, so
    a section starts at its first line or at the blank line above it, depending on the run length.
    """

    def build(lines: Column, full: Column) -> Column:
        last = F.size(lines) - 1
        begins = F.filter(full, lambda i: (i == 0) | is_blank(F.get(lines, i - 1)))
        ends = F.filter(full, lambda i: (i == last) | is_blank(F.get(lines, i + 1)))

        def paragraphs(begins: Column, ends: Column) -> Column:
            def at(begin: Column, k: Column) -> Column:
                end = F.get(ends, k)
                gap = begin - F.coalesce(F.get(ends, k - 1), F.lit(-1)) - 1
                open_above = F.when(k == 0, gap % 2 == 1).otherwise((gap > 0) & (gap % 2 == 0))
                start = begin - F.when(open_above, 1).otherwise(0)
                body = strip(_joined(lines, begin, end - begin + 1))
                return _section(_no_title(), body, F.lit(0), start, end)

            return F.transform(begins, at)

        empty = F.array(_section(_no_title(), F.lit(""), F.lit(0), F.lit(0), last))
        return F.when(F.size(full) == 0, empty).otherwise(
            let(begins, lambda b: let(ends, lambda e: paragraphs(b, e)))
        )

    return let(
        lines_of(content),
        lambda lines: let(
            positions_where(lines, lambda line: ~is_blank(line)), lambda full: build(lines, full)
        ),
    )


def definition_title(line: Column, language: Column) -> Column:
    """``def name``, ``class Name`` … for a definition line of ``language``, else NULL."""
    text = strip(line)
    title = None
    for name, rules in DEFINITION_LINES.items():
        found = None
        for pattern, kind, group in rules:
            regex = UNICODE + pattern.replace(r"\s", WS)
            word = F.lit(kind) if isinstance(kind, str) else F.regexp_extract(text, regex, kind)
            hit = F.concat(word, F.lit(" "), F.regexp_extract(text, regex, group))
            found = F.when(text.rlike(regex), hit) if found is None else found.when(
                text.rlike(regex), hit
            )
        title = F.when(language == name, found) if title is None else title.when(
            language == name, found
        )
    return title


def code_sections(content: Column, language: Column) -> Column:
    """Sections starting at definition lines; the text before the first is untitled."""

    def build(lines: Column, titles: Column, heads: Column) -> Column:
        first = F.coalesce(F.get(heads, F.lit(0)), F.size(lines))
        header = _section(
            _no_title(), _joined(lines, F.lit(0), first), F.lit(0), F.lit(0), first - 1
        )

        def at(head: Column, k: Column) -> Column:
            until = F.coalesce(F.get(heads, k + 1), F.size(lines))
            return _section(
                F.get(titles, head), _joined(lines, head, until - head), F.lit(1), head, until - 1
            )

        return F.filter(
            F.concat(F.array(header), F.transform(heads, at)), lambda s: s["end_line"] >= 0
        )

    return let(
        lines_of(content),
        lambda lines: let(
            F.transform(lines, lambda line: definition_title(line, language)),
            lambda titles: let(
                positions_where(titles, lambda t: t.isNotNull()),
                lambda heads: build(lines, titles, heads),
            ),
        ),
    )


def markdown_metadata(content: Column) -> Column:
    """``map<string,string>`` of front-matter ``key: value`` lines, plus the first ``# `` title."""

    def front_matter(lines: Column) -> Column:
        closing = F.get(
            F.filter(indexes(lines), lambda i: (i > 0) & (strip(F.get(lines, i)) == "---")),
            F.lit(0),
        )
        rows = F.filter(
            F.slice(lines, F.lit(2), F.coalesce(closing - 1, F.lit(0))),
            lambda line: F.contains(line, F.lit(":")),
        )
        pairs = F.array_sort(
            F.transform(
                rows,
                lambda line, i: F.struct(
                    strip(F.substring_index(line, ":", 1)).alias("key"),
                    i.alias("at"),
                    strip(F.regexp_replace(line, r"(?s)^[^:]*:", "")).alias("value"),
                ),
            )
        )
        # Sorted by key and position: the last of each key wins.
        return let(
            pairs,
            lambda ps: F.map_from_entries(
                F.transform(
                    F.filter(
                        ps,
                        lambda p, i: F.coalesce(F.get(ps, i + 1)["key"] != p["key"], F.lit(True)),
                    ),
                    lambda p: F.struct(p["key"], p["value"]),
                )
            ),
        )

    def with_title(lines: Column) -> Column:
        empty = F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")
        )
        given = F.when(F.startswith(content, F.lit("---")), front_matter(lines)).otherwise(empty)
        heading = F.get(
            F.filter(lines, lambda line: F.startswith(strip(line), F.lit("# "))), F.lit(0)
        )
        title = strip(F.substring(strip(heading), 3, 1 << 30))
        return let(
            given,
            lambda m: F.when(
                F.map_contains_key(m, F.lit("title")) | heading.isNull(), m
            ).otherwise(F.map_concat(m, F.create_map(F.lit("title"), title))),
        )

    return let(lines_of(content), with_title)


def json_metadata(text: Column) -> Column:
    """Kind of the root value and the usual descriptive string members of a root object."""
    trimmed = lstrip(text)
    head = F.substring(trimmed, 1, 1)
    root = (
        F.when(head == "{", "dict")
        .when(head == "[", "list")
        .when(head == '"', "str")
        .when(head.isin("t", "f"), "bool")
        .when(head == "n", "NoneType")
        .when(trimmed.rlike(r"[.eE]"), "float")
        .otherwise("int")
    )

    def collect(v: Column) -> Column:
        pairs = [F.struct(F.lit("original_structure").alias("key"), root.alias("value"))]
        for name in ("title", "name", "description", "id"):
            found = J.member(v, name)
            value = F.when(
                F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string")
            )
            pairs.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
        return F.map_from_entries(
            F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
        )

    return let(J.parse(text), lambda v: F.when(v.isNotNull(), collect(v)))
