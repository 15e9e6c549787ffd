"""JSON carried as text: cleaning model replies, repair, field access and leaf extraction."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tunekit.functions.arrays import let
from tunekit.functions.text import UNICODE, WS, has_text, strip

FENCE = "```"

# Lead-ins that models put before the JSON, removed in this order.
REPLY_PREFIXES = (
    "Here's the JSON:",
    "Here is the JSON:",
    "JSON:",
    "Response:",
    "Output:",
    "Result:",
)


_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def _fix_duplicate_keys() -> None:
    """Set the session's rule for repeated keys of a JSON object: the last one wins, in any session."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(_DUPLICATES, "false") != "true":
        session.conf.set(_DUPLICATES, "true")


def parse(c: Column) -> Column:
    """VARIANT of a JSON text, NULL when it is not valid JSON from end to end.

    The built-in parser stops after the first value and ignores what follows. Here the text becomes
    the first element of an array that must close with a digest of the text, so anything after the
    value makes the array invalid or moves the digest.
    """
    _fix_duplicate_keys()
    digest = F.xxhash64(c)
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit(","), digest.cast("string"), F.lit("]")))
    return let(
        wrapped,
        lambda w: F.when(
            F.try_variant_get(w, "$[1]", "bigint") == digest,
            F.try_variant_get(w, "$[0]", "variant"),
        ),
    )


# Above this many characters a value may be too large for a VARIANT.
LARGE = 4_000_000
# Strict JSON, strings of any length.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxStringLen": str((1 << 31) - 1)}


def is_valid(c: Column) -> Column:
    """Whether a text is valid JSON from end to end, also where it is too large to become a VARIANT."""

    def whole(text: Column) -> Column:
        digest = F.xxhash64(text).cast("string")
        both = F.from_json(F.concat(F.lit("["), text, F.lit(","), digest, F.lit("]")), "array<string>", STRICT)
        return let(both, lambda a: F.coalesce((F.size(a) == 2) & (F.get(a, F.lit(1)) == digest), F.lit(False)))

    large = F.length(c) > LARGE
    return F.coalesce(F.when(large, whole(F.when(large, c))).otherwise(parse(F.when(~large, c)).isNotNull()), F.lit(False))


def kind(v: Column) -> Column:
    """'object', 'array', 'null', or the lower-cased scalar type of a VARIANT."""
    head = F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)
    return F.lower(F.when(head == "VOID", "null").otherwise(head))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def member(v: Column, key: str) -> Column:
    """Member as VARIANT: NULL when the key is absent, VARIANT null when it is there and null."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def items(v: Column) -> Column:
    """Elements of a VARIANT array; NULL for anything else."""
    return F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>"))


def as_text(v: Column) -> Column:
    """Text of a member: strings as they are, ``None``/``True``/``False``, nested values as JSON."""
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(F.is_variant_null(v), F.lit("None"))
        .when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def clean_reply(reply: Column) -> Column:
    """Drop Markdown code fences and known lead-ins around the JSON of a model reply."""
    tail = len(FENCE)

    def between(s: Column, start: Column) -> Column:
        return F.substring(s, start, F.length(s) - tail - start + 1)

    def unfence(s: Column) -> Column:
        fenced_end = F.endswith(s, F.lit(FENCE))
        newline = F.locate("\n", s)
        return (
            F.when(
                F.startswith(s, F.lit(FENCE)) & fenced_end,
                F.when(newline > 0, between(s, newline + 1)).otherwise(between(s, F.lit(tail + 1))),
            )
            .when(
                F.contains(s, F.lit("```json\n")) & fenced_end,
                between(s, F.locate("```json\n", s) + len("```json\n")),
            )
            .when(
                F.contains(s, F.lit("```\n")) & fenced_end,
                between(s, F.locate("```\n", s) + len("```\n")),
            )
            .otherwise(s)
        )

    lead_ins = "".join(f"(?:{prefix}{WS}*)?" for prefix in REPLY_PREFIXES)
    body = strip(let(strip(F.coalesce(reply, F.lit(""))), unfence))
    return F.regexp_replace(body, f"{UNICODE}^{lead_ins}", "")


def repair_json(text: Column) -> Column:
    """Fix trailing commas and single-quoted keys and values."""
    out = F.regexp_replace(text, rf"{UNICODE},{WS}*([}}\]])", "$1")
    out = F.regexp_replace(out, r"'([^']*)':", r'"$1":')
    return F.regexp_replace(out, rf"{UNICODE}:{WS}*'([^']*)'", r': "$1"')


def _parse_or_repair(text: Column) -> Column:
    return let(text, lambda t: F.coalesce(parse(t), parse(repair_json(t))))


def _outermost(text: Column, pattern: str) -> Column:
    """Longest match, NULL for none: without its brackets a text is no object or array, and a parse
    that fails costs a Java exception."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def whole_object(cleaned: Column) -> Column:
    """VARIANT of a reply that is one JSON object from end to end."""
    braced = F.startswith(cleaned, F.lit("{")) & F.endswith(cleaned, F.lit("}"))
    return let(parse(F.when(braced, cleaned)), lambda v: F.when(is_object(v), v))


def reply_object(cleaned: Column) -> Column:
    """First ``{`` to last ``}`` of a cleaned reply as a VARIANT object, repaired if need be."""
    found = _parse_or_repair(_outermost(cleaned, r"(?s)\{.*\}"))
    return let(found, lambda v: F.when(is_object(v), v))


def reply_array(cleaned: Column) -> Column:
    """First ``[`` to last ``]`` of a cleaned reply as ``array<variant>``, repaired if need be."""
    return let(_parse_or_repair(_outermost(cleaned, r"(?s)\[.*\]")), items)


def string_leaves(text: Column) -> Column:
    """Non-blank string values of a JSON text in document order, keys left out; NULL if invalid.

    One pass cuts the text into its string tokens; a token followed by a colon is a key. The
    remaining tokens form one JSON array, so escapes are decoded once.
    """
    token = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'
    values = F.filter(
        F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda t: F.endswith(t, F.lit('"'))
    )
    decoded = F.from_json(
        F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>", STRICT
    )
    return F.when(is_valid(text), F.filter(decoded, has_text))
