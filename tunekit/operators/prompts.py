"""Prompt columns. The wording is this package's own and can be replaced per call."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunekit.functions.arrays import quoted

from tunekit.operators.entries import fields_of

# Words that differ between the two written standards of Chinese.
MAINLAND_TO_TAIWAN = {
    "視頻": "影片",
    "軟件": "軟體",
    "交互": "互動",
    "質量": "品質",
    "信息": "資訊",
    "數據": "資料",
    "網絡": "網路",
    "程序": "程式",
    "服務器": "伺服器",
    "用戶": "使用者",
    "優化": "最佳化",
    "默認": "預設",
}
TAIWAN_TO_MAINLAND = {
    "影片": "视频",
    "軟體": "软件",
    "互動": "交互",
    "品質": "质量",
    "資訊": "信息",
    "資料": "数据",
    "網路": "网络",
    "程式": "程序",
    "伺服器": "服务器",
    "使用者": "用户",
    "最佳化": "优化",
    "預設": "默认",
}
# Placeholders in augmentation prompts.
EMPTY_VALUE = "(empty - create new)"
NO_CONTEXT = "No additional context"


def _pairs(table: dict[str, str]) -> str:
    return "、".join(f"{a}→{b}" for a, b in table.items())


# Guidance by locale, a table that drives every prompt. Replace or extend it per call.
LOCALES: dict[str, str] = {
    "en": "",
    "zh-tw": "\n\n請以臺灣慣用的繁體中文書寫，並替換下列用語：" + _pairs(MAINLAND_TO_TAIWAN),
    "zh-cn": "\n\n请以大陆惯用的简体中文书写，使用公制单位，并替换下列用语："
    + _pairs(TAIWAN_TO_MAINLAND),
}

ENTRY_HINTS = {
    "sft": "an instruction, the input it needs, and the output that answers it",
    "pretrain": "a text: one coherent and informative passage",
    "sft_conv": "conversations: a list of messages, each with a role (system, user or assistant) "
    "and content, holding at least one user and one assistant message, with varied wording "
    "and several turns",
    "dpo": "a prompt, a chosen reply, and a rejected reply that differs and is clearly worse",
}

CHUNK_USER = (
    "Write {count} training examples grounded in this passage.\n\n"
    "<<<\n{content}\n>>>\n\n"
    "Each example has {hint}.\n"
    "Keys: {keys}. Reply with nothing but a JSON array of {count} objects.{guidance}"
)
CHUNK_SYSTEM = "You turn documents into accurate training data.{guidance}"
TOPIC_SYSTEM = (
    "You write training data about: {topic}\n"
    "Each example has {hint}.\n"
    "Keys: {keys}. Reply with nothing but {shape}.{guidance}"
)
TOPIC_USER = "Topic: {topic}. Request {number}: write {count} new and distinct {kind} example(s).{guidance}"
AUGMENT_SYSTEM = (
    'You fill in the field "{target}" of dataset rows.\n'
    "Task: {instruction}\n"
    'Reply with the bare value of "{target}": no JSON, no comments.{guidance}'
)
AUGMENT_USER = 'Row:\n{context}\n\n"{target}" now: {current}\n\nNew value of "{target}":'


def render(template: str, **values: Column | str | int) -> Column:
    """Fill ``{name}`` placeholders; Python values are folded into the literal text."""
    parts: list[Column] = []
    text = ""
    for literal, name, _, _ in Formatter().parse(template):
        text += literal
        if name is None:
            continue
        value = values[name]
        if isinstance(value, Column):
            parts += [F.lit(text), value.cast("string")]
            text = ""
        else:
            text += str(value)
    return F.concat(*parts, F.lit(text)) if parts else F.lit(text)


def guidance(locale: str | Column, locales: dict[str, str] | None = None) -> str | Column:
    """Writing guidance of a locale; a Column of locales is looked up in a literal map."""
    table = LOCALES if locales is None else locales
    if not isinstance(locale, Column):
        if locale not in table:
            raise ValueError(f"locale must be one of {sorted(table)}")
        return table[locale]
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), locale), F.lit(""))


def chunk_system_prompt(
    locale: str | Column = "en", template: str = CHUNK_SYSTEM, locales: dict | None = None
) -> Column:
    return render(template, guidance=guidance(locale, locales))


def chunk_prompt(
    content: Column,
    dataset_type: str,
    count: int = 3,
    locale: str | Column = "en",
    template: str = CHUNK_USER,
    locales: dict | None = None,
) -> Column:
    """Prompt asking for ``count`` entries of a type based on one chunk."""
    if not 1 <= count <= 10:
        raise ValueError("entries per chunk must be in 1..10")
    return render(
        template,
        content=content,
        count=count,
        hint=ENTRY_HINTS[dataset_type],
        keys=", ".join(fields_of(dataset_type)),
        guidance=guidance(locale, locales),
    )


def topic_system_prompt(
    topic: Column,
    batch_size: Column,
    dataset_type: str,
    locale: str | Column = "en",
    template: str = TOPIC_SYSTEM,
    locales: dict | None = None,
) -> Column:
    shape = F.when(batch_size > 1, F.concat(F.lit("a JSON array of "), batch_size.cast("string"), F.lit(" objects"))).otherwise(
        "one JSON object"
    )
    return render(
        template,
        topic=topic,
        hint=ENTRY_HINTS[dataset_type],
        keys=", ".join(fields_of(dataset_type)),
        shape=shape,
        guidance=guidance(locale, locales),
    )


def topic_user_prompt(
    topic: Column,
    number: Column,
    batch_size: Column,
    dataset_type: str,
    locale: str | Column = "en",
    template: str = TOPIC_USER,
    locales: dict | None = None,
) -> Column:
    return render(
        template,
        topic=topic,
        number=number,
        count=batch_size,
        kind="/".join(fields_of(dataset_type)),
        guidance=guidance(locale, locales),
    )


def value_text(column: str, dtype: str) -> Column:
    """A field as prompt text: nested values as JSON."""
    nested = dtype.startswith(("struct", "array", "map", "variant"))
    return F.to_json(quoted(column)) if nested else quoted(column).cast("string")


def context_text(dtypes: dict[str, str], fields: tuple[str, ...]) -> Column:
    """``name: value`` lines of the context fields that have a value."""
    lines = [
        F.concat(F.lit(f"{name}: "), value_text(name, dtypes[name]))
        for name in fields
        if name in dtypes
    ]
    if not lines:
        return F.lit(NO_CONTEXT)
    return F.coalesce(F.nullif(F.concat_ws("\n", *lines), F.lit("")), F.lit(NO_CONTEXT))


def augment_prompts(
    dtypes: dict[str, str],
    target: str,
    instruction: str,
    context_fields: tuple[str, ...] = (),
    locale: str = "en",
    system_template: str = AUGMENT_SYSTEM,
    user_template: str = AUGMENT_USER,
    locales: dict | None = None,
) -> tuple[Column, Column]:
    """System and user prompt to fill one field of a row."""
    current = F.lit(None).cast("string")
    if target in dtypes:
        current = value_text(target, dtypes[target])
    system = render(
        system_template,
        target=target,
        instruction=instruction,
        guidance=guidance(locale, locales),
    )
    user = render(
        user_template,
        context=context_text(dtypes, context_fields),
        target=target,
        current=F.coalesce(current, F.lit(EMPTY_VALUE)),
    )
    return system, user


def apply_lexicon(text: Column, lexicon: dict[str, str] | None = None) -> Column:
    """Replace every listed word, in table order."""
    for word, other in (MAINLAND_TO_TAIWAN if lexicon is None else lexicon).items():
        text = F.replace(text, F.lit(word), F.lit(other))
    return text
