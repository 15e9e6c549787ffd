"""Strict entry checks, each with the reason a row was rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions.text import has_text, strip
from tunekit.operators.entries import ROLES, fields_of


def reject_reason(dataset_type: str) -> Column:
    """Why the row is no valid entry of its type; NULL for a valid one."""
    if dataset_type == "sft_conv":
        messages = F.col("conversations")

        def has_role(name: str) -> Column:
            return F.exists(messages, lambda m: m["role"] == name)

        return (
            F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, "no messages")
            .when(F.exists(messages, lambda m: ~is_role(m["role"])), "unknown role")
            .when(F.exists(messages, lambda m: ~has_text(m["content"])), "blank message")
            .when(~has_role("user"), "no user message")
            .when(~has_role("assistant"), "no assistant message")
        )
    names = fields_of(dataset_type)
    reason = F.when(~has_text(F.col(names[0])), f"blank {names[0]}")
    for name in names[1:]:
        reason = reason.when(~has_text(F.col(name)), f"blank {name}")
    if dataset_type == "dpo":
        same = strip(F.col("chosen")) == strip(F.col("rejected"))
        reason = reason.when(same, "chosen equals rejected")
    return reason


def is_role(role: Column) -> Column:
    return F.coalesce(role.isin(*ROLES), F.lit(False))


def with_validity(df: DataFrame, dataset_type: str) -> DataFrame:
    """Add ``reject_reason`` and ``valid``."""
    return df.withColumn("reject_reason", reject_reason(dataset_type)).withColumn(
        "valid", F.col("reject_reason").isNull()
    )


def with_validity_by_type(df: DataFrame, type_col: str = "dataset_type") -> DataFrame:
    """The same for rows of mixed types that carry all entry columns; unknown types are invalid."""
    kind = F.col(type_col)
    reason = None
    for name in ("sft", "pretrain", "sft_conv", "dpo"):
        if not set(fields_of(name)) <= set(df.columns):
            continue
        case = reject_reason(name)
        reason = F.when(kind == name, case) if reason is None else reason.when(kind == name, case)
    unknown = F.lit("unknown dataset type")
    reason = unknown if reason is None else reason.otherwise(unknown)
    return df.withColumn("reject_reason", reason).withColumn(
        "valid", F.col("reject_reason").isNull()
    )


def valid_entries(df: DataFrame, dataset_type: str) -> DataFrame:
    return df.filter(reject_reason(dataset_type).isNull())


def rejected_entries(df: DataFrame, dataset_type: str) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(dataset_type)).filter(
        F.col("reject_reason").isNotNull()
    )


def turns_validity(
    turns: DataFrame, key: str, role: str = "role", content: str = "content"
) -> DataFrame:
    """Conversation validity per key straight from turn rows: partial aggregates, no collected
    conversation, so one key may hold any share of the rows."""
    return turns.groupBy(key).agg(
        (
            F.bool_and(has_text(F.col(content)) & is_role(F.col(role)))
            & F.bool_or(F.col(role) == "user")
            & F.bool_or(F.col(role) == "assistant")
        ).alias("valid"),
        F.count(F.lit(1)).alias("n_messages"),
    )
