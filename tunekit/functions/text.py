"""Text functions with Unicode whitespace semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunekit.functions.arrays import let, running_sum

# The code points that count as whitespace.
WHITESPACE_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    ]
)
# The same set as a regex class. It needs the Unicode flag in front of the pattern; one property
# test per character is several times faster than listing the ranges.
UNICODE = "(?U)"
WS = r"[\s\x1c-\x1f]"
BLANK_LINE = rf"{UNICODE}\n{WS}*\n"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any Unicode kind (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == F.lit("")


def has_text(c: Column) -> Column:
    """False for NULL, empty and whitespace-only text; never NULL."""
    return F.coalesce(~is_blank(c), F.lit(False))


def remove_nul(c: Column) -> Column:
    return F.translate(c, "\x00", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none, for dot files and for a trailing dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def text_preview(c: Column, width: int = 100) -> Column:
    return F.when(
        F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))
    ).otherwise(c)


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def decode_bytes(content: Column) -> Column:
    """UTF-8 where valid, otherwise Latin-1 (which accepts every byte)."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return universal_newlines(text)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def _pieces_and_seps(text: Column, pattern: str, body) -> Column:
    return let(
        F.struct(
            F.split(text, pattern, -1).alias("pieces"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("seps"),
        ),
        body,
    )


def match_spans(text: Column, pattern: str) -> Column:
    """Character spans ``array<struct<start,end>>`` of the non-overlapping matches of ``pattern``."""

    def spans(x: Column) -> Column:
        sizes = F.transform(
            x["seps"],
            lambda s, i: (F.length(F.get(x["pieces"], i)) + F.length(s)).cast("bigint"),
        )
        return F.transform(
            running_sum(sizes),
            lambda end, i: F.struct(
                (end - F.length(F.get(x["seps"], i))).alias("start"), end.alias("end")
            ),
        )

    return _pieces_and_seps(text, pattern, spans)


def split_with_offsets(text: Column, pattern: str) -> Column:
    """Split on ``pattern``, strip each part, drop blank parts and keep true character offsets."""

    def parts(x: Column) -> Column:
        sizes = F.transform(
            x["pieces"],
            lambda p, i: (
                F.length(p) + F.coalesce(F.length(F.get(x["seps"], i)), F.lit(0))
            ).cast("bigint"),
        )

        def place(ends: Column) -> Column:
            def one(piece: Column, i: Column) -> Column:
                origin = F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))
                lead = F.length(piece) - F.length(lstrip(piece))
                return F.struct(strip(piece).alias("content"), (origin + lead).alias("start"))

            return F.filter(
                F.transform(x["pieces"], one), lambda p: p["content"] != F.lit("")
            )

        return let(running_sum(sizes), place)

    return _pieces_and_seps(text, pattern, parts)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows ``array<struct<content,start>>``, ending at the first that reaches the end.

    One regex pass emits every window by look-ahead; ``substring`` would scan from the start of the
    text for each window, which is quadratic for long texts.
    """
    step = size - overlap
    if size < 1 or overlap < 0 or step < 1:
        raise ValueError("window size must be positive and overlap in [0, size)")
    pattern = rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"

    def cut(t: Column) -> Column:
        count = F.greatest(F.ceil((F.length(t) - size) / step), F.lit(0)).cast("int") + 1
        found = F.slice(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.lit(1), count)
        return F.transform(
            found, lambda w, i: F.struct(w.alias("content"), (i * step).cast("bigint").alias("start"))
        )

    return let(text, cut)


def token_windows(tokens: Column, width: int, overlap: int) -> Column:
    """The same windows over an array of tokens."""
    step = width - overlap
    if width < 1 or overlap < 0 or step < 1:
        raise ValueError("window width must be positive and overlap in [0, width)")

    def cut(ts: Column) -> Column:
        last = F.greatest(F.ceil((F.size(ts) - width) / step), F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(ts, i * step + 1, F.lit(width))
        )

    return let(tokens, cut)
