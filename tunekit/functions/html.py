"""Plain text and metadata of HTML, as Column expressions."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tunekit.functions.text import strip
from tunekit.sources.shared import bounded_batches

# A private-use code point stands for "a tag was here" between the tag pass and the text pass.
_MARK = "\ue000"

# Rewrites of the regex method, in this order, before entities are decoded.
_REGEX_PASSES = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<(br|p|div|h[1-6]|li|tr)[^>]*>", "\n"),
    (r"<[^>]+>", ""),
)
# What the tree method removes: comments, scripts and styles, the head, then every tag.
_TREE_CUTS = (
    r"(?is)<!--.*?-->",
    r"(?is)<(script|style)(?=[\s/>])[^>]*>.*?</\1\s*>",
    r"(?is)<head(?=[\s/>])[^>]*>.*?</head\s*>",
    r"(?s)<[a-zA-Z/!?][^>]*>",
)


# A reference that ends in its semicolon.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decode_terminated(text: str) -> str:
    def decoded(found: re.Match) -> str:
        reference = found[0]
        return html.unescape(reference) if reference[1] == "#" or reference[1:] in html5 else reference

    return _REFERENCE.sub(decoded, text)


def _entity_decoder(terminated: bool):
    # Named entities follow the HTML5 table with its prefix rules, which no built-in offers.
    one = _decode_terminated if terminated else html.unescape

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return decode


def unescape(c: Column, terminated: bool = False) -> Column:
    """Decode HTML entities; texts without ``&`` are not sent to Python.

    HTML5 also decodes some names without a semicolon (``&amp``, ``&notit;``); with ``terminated`` only
    references that end in one are decoded, and others stay as they are.
    """
    bounded_batches()
    return F.coalesce(_entity_decoder(terminated)(F.when(F.contains(c, F.lit("&")), c)), c)


def html_text(c: Column, method: str = "regex", terminated: bool = False) -> Column:
    """Visible text of a page.

    ``regex``: block tags become line breaks, other tags vanish.
    ``tree``: every text node on its own line, the whole ``head`` dropped.
    ``terminated`` is that of :func:`unescape`, here and below.
    """
    if method == "regex":
        out = c
        for pattern, replacement in _REGEX_PASSES:
            out = F.regexp_replace(out, pattern, replacement)
        out = F.regexp_replace(unescape(out, terminated), r"[ \t]+", " ")
        return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    if method == "tree":
        out = F.translate(c, _MARK, " ")
        for pattern in _TREE_CUTS:
            out = F.regexp_replace(out, pattern, _MARK)
        nodes = F.transform(F.split(unescape(out, terminated), _MARK), strip)
        joined = F.array_join(F.filter(nodes, lambda node: node != F.lit("")), "\n")
        return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))
    raise ValueError(f"unknown method {method!r}: use 'regex' or 'tree'")


def html_title(c: Column, terminated: bool = False) -> Column:
    """Decoded ``<title>``, NULL when the page has none."""
    pattern = r"(?is)<title[^>]*>(.*?)</title>"
    return unescape(F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))), terminated)


def html_description(c: Column, terminated: bool = False) -> Column:
    """Decoded meta description (``name`` before ``content``), NULL when the page has none."""
    pattern = (
        r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""
    )
    return unescape(F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))), terminated)
