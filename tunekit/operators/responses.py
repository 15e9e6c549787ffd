"""Model replies to typed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions import json_text as J
from tunekit.functions.arrays import let
from tunekit.operators.entries import entry_of


def lenient_entries(reply: Column, dataset_type: str) -> Column:
    """Entries found in a noisy reply.

    A reply that is one object as a whole is one entry. Otherwise the items of its outermost array
    count, and if none of them is an entry, its outermost object.
    """

    def valid(objects: Column) -> Column:
        return F.filter(
            F.transform(objects, lambda v: entry_of(v, dataset_type, require_keys=True)),
            lambda e: e.isNotNull(),
        )

    def one(v: Column) -> Column:
        return valid(F.when(v.isNotNull(), F.array(v)))

    def search(cleaned: Column) -> Column:
        whole = let(J.whole_object(cleaned), lambda v: F.when(v.isNotNull(), one(v)))
        listed = let(
            valid(J.reply_array(cleaned)), lambda found: F.when(F.size(found) > 0, found)
        )
        return F.coalesce(whole, listed, one(J.reply_object(cleaned)))

    return let(J.clean_reply(reply), search)


def strict_entries(reply: Column, dataset_type: str) -> Column:
    """Entries of a reply that is JSON as a whole: an array of objects or a single object."""

    def read(v: Column) -> Column:
        objects = F.when(J.is_object(v), F.array(v)).otherwise(J.items(v))
        return F.filter(
            F.transform(objects, lambda o: entry_of(o, dataset_type, require_keys=False)),
            lambda e: e.isNotNull(),
        )

    return let(J.parse(reply), read)


def parse_replies(
    df: DataFrame,
    dataset_type: str,
    reply_col: str = "raw_content",
    strict: bool = False,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Rows ``(*keep, entry_index, <entry fields>)``; replies without entries give none."""
    keep = tuple(c for c in df.columns if c != reply_col) if keep is None else keep
    read = strict_entries if strict else lenient_entries
    return df.select(
        *keep, F.posexplode(read(F.col(reply_col), dataset_type)).alias("entry_index", "_e")
    ).select(*keep, "entry_index", "_e.*")
