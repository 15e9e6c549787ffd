"""Fields of free-form datasets, name filters, and unions."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions import json_text as J
from tunekit.functions.arrays import quoted
from tunekit.functions.text import file_name


class FieldNotFound(ValueError):
    def __init__(self, name: str, available: Sequence[str]):
        self.available = sorted(available)
        listing = ", ".join(self.available) or "none"
        super().__init__(f"Field '{name}' not found in dataset. Available fields: {listing}")


def json_fields(df: DataFrame, json_col: str) -> DataFrame:
    """Distinct top-level keys of JSON object texts, sorted. Keys are deduplicated per task first."""
    return (
        df.select(F.explode(F.json_object_keys(json_col)).alias("field"))
        .distinct()
        .orderBy("field")
    )


def variant_fields(df: DataFrame, variant_col: str = "value") -> DataFrame:
    """The same for a VARIANT column."""
    return json_fields(df.select(F.to_json(variant_col).alias("_j")), "_j")


def require_field(df: DataFrame, target: str, create_new_field: bool = False) -> bool:
    """Check a target field of a typed dataset. A new field needs ``create_new_field``."""
    if create_new_field or target in df.columns:
        return True
    raise FieldNotFound(target, df.columns)


def require_variant_field(
    df: DataFrame, target: str, variant_col: str = "value", create_new_field: bool = False
) -> bool:
    """Check a target field of free-form rows: some row must have it (an empty dataset has none)."""
    if create_new_field:
        return True
    present = df.filter(J.member(F.col(variant_col), target).isNotNull())
    if not present.isEmpty():
        return True
    names = [r["field"] for r in variant_fields(df, variant_col).collect()]
    raise FieldNotFound(target, names)


def glob_to_regex(pattern: str) -> str:
    """Shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored Java regex."""
    body = fnmatch.translate(pattern)
    for tail in (r"\Z", r"\z"):
        body = body.removesuffix(tail)
    # Older translators emulate atomic groups with named ones.
    return "^" + body.replace("(?P<", "(?<").replace("(?P=", r"\k<") + r"\z"


def name_matches(path: Column, pattern: str) -> Column:
    """Case-sensitive match of the file name (not the whole path)."""
    return file_name(path).rlike(glob_to_regex(pattern))


def union_datasets(parts: Sequence[DataFrame], ordinal: str | None = "source_ordinal") -> DataFrame:
    """All rows of all parts over the union of their columns; missing values become NULL.

    ``ordinal`` keeps which part a row came from, which restores the order of the parts.
    """
    if not parts:
        raise ValueError("nothing to union")
    if ordinal:
        parts = [p.withColumn(ordinal, F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def profile(df: DataFrame, order: Sequence[str], sample: int = 3) -> DataFrame:
    """One row: row count, field names, and the first rows as JSON."""
    names = F.array(*[F.lit(c) for c in df.columns])
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    head = (
        df.orderBy(*map(quoted, order))
        .limit(sample)
        .select(
            F.struct(*map(quoted, order)).alias("_at"),
            F.to_json(F.struct(*map(quoted, df.columns))).alias("_row"),
        )
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_head"))
        .select(F.transform("_head", lambda h: h["_row"]).alias("sample"))
    )
    return (
        counted.unionByName(head, allowMissingColumns=True)
        .agg(F.max("rows").alias("rows"), F.first("sample", ignorenulls=True).alias("sample"))
        .select("rows", names.alias("fields"), "sample")
    )
