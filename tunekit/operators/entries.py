"""Dataset types: their columns, the output schema asked of a model, and conversions to and from JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions import json_text as J
from tunekit.functions.arrays import bind, let

# Entry fields in canonical order, and the message roles.
ENTRY_FIELDS: dict[str, tuple[str, ...]] = {
    "sft": ("instruction", "input", "output"),
    "pretrain": ("text",),
    "sft_conv": ("conversations",),
    "dpo": ("prompt", "chosen", "rejected"),
}
ROLES = ("system", "user", "assistant")
MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def fields_of(dataset_type: str) -> tuple[str, ...]:
    if dataset_type not in ENTRY_FIELDS:
        raise ValueError(f"dataset type must be one of {sorted(ENTRY_FIELDS)}")
    return ENTRY_FIELDS[dataset_type]


def entry_ddl(dataset_type: str) -> str:
    """Column DDL of an entry type."""
    kind = MESSAGES_TYPE if dataset_type == "sft_conv" else "string"
    return ", ".join(f"{name} {kind}" for name in fields_of(dataset_type))


def output_schema(dataset_type: str, batch_size: int = 1) -> str:
    """JSON Schema text for structured model output: one object, or an array of them."""

    def obj(properties: dict) -> dict:
        return {"type": "object", "properties": properties, "required": list(properties)}

    text = {"type": "string"}
    message = obj({"role": {"type": "string", "enum": list(ROLES)}, "content": text})
    kinds = {"conversations": {"type": "array", "items": message}}
    entry = obj({name: kinds.get(name, text) for name in fields_of(dataset_type)})
    return json.dumps({"type": "array", "items": entry} if batch_size > 1 else entry)


def messages_of(v: Column) -> Column:
    """Usable messages of a VARIANT array: objects with a known role and some content member."""

    def usable(m: Column) -> Column:
        role = J.member(m, "role")
        known = (F.schema_of_variant(role) == "STRING") & F.try_variant_get(
            role, "$", "string"
        ).isin(*ROLES)
        return F.coalesce(J.is_object(m) & known & J.member(m, "content").isNotNull(), F.lit(False))

    return F.transform(
        F.filter(J.items(v), usable),
        lambda m: F.struct(
            F.try_variant_get(m, "$.role", "string").alias("role"),
            J.as_text(J.member(m, "content")).alias("content"),
        ),
    )


def entry_of(v: Column, dataset_type: str, require_keys: bool) -> Column:
    """Typed entry struct of a VARIANT object, NULL when it is not one.

    ``require_keys``: every field must be present (it may be blank); otherwise missing fields
    become empty text. A conversation needs one usable message either way.
    """
    names = fields_of(dataset_type)
    if dataset_type == "sft_conv":
        return let(
            messages_of(J.member(v, "conversations")),
            lambda ms: F.when(F.size(ms) > 0, F.struct(ms.alias("conversations"))),
        )

    def build(members: Column) -> Column:
        texts = [J.as_text(F.get(members, F.lit(i))) for i in range(len(names))]
        if not require_keys:
            texts = [F.coalesce(t, F.lit("")) for t in texts]
        entry = F.struct(*[t.alias(n) for t, n in zip(texts, names, strict=True)])
        return F.when(F.forall(members, lambda m: m.isNotNull()), entry) if require_keys else entry

    members = F.when(J.is_object(v), F.array(*[J.member(v, name) for name in names]))
    return let(members, lambda ms: F.when(ms.isNotNull(), build(ms)))


def entry_json(dataset_type: str) -> Column:
    """Entry columns as one JSON object text in canonical field order."""
    return F.to_json(F.struct(*fields_of(dataset_type)))


def entries_from_json(df: DataFrame, json_col: str, dataset_type: str) -> DataFrame:
    """Typed columns from JSON object texts; texts that are no entry give no row."""
    rest = [c for c in df.columns if c != json_col]
    parsed = let(
        J.parse(F.col(json_col)), lambda v: entry_of(v, dataset_type, require_keys=False)
    )
    return bind(df, "_e", parsed).filter(F.col("_e").isNotNull()).select(*rest, "_e.*")


def infer_dataset_type(v: Column) -> Column:
    """Type of a free-form VARIANT row by the first key present."""

    def has(key: str) -> Column:
        return J.member(v, key).isNotNull()

    return (
        F.when(has("instruction"), "sft")
        .when(has("text"), "pretrain")
        .when(has("conversations"), "sft_conv")
        .when(has("prompt"), "dpo")
    )


def conversations_from_turns(
    turns: DataFrame, key: str, order: str, role: str = "role", content: str = "content"
) -> DataFrame:
    """One ``conversations`` entry per key from turn rows, in turn order.

    The result row holds the whole conversation, so a group is as large as one entry.
    """
    message = F.struct(
        F.col(order).alias("_at"), F.col(role).alias("role"), F.col(content).alias("content")
    )
    return turns.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(message)),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("conversations")
    )
