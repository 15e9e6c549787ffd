"""Chunk properties and an independent walk-through of the greedy merge."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunekit.operators import chunking as C
from tunekit.operators import sections as S

SLOW = settings(
    max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
WORDS = st.lists(
    st.sampled_from(["word", "é", "日本", " ", "\n", "\n\n", "\n \n", "# H\n", "x" * 130, "```\n", "😀"]),
    max_size=40,
).map("".join)
DOCS = st.lists(WORDS, min_size=15, max_size=15)


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "i int, t string").orderBy("i")


def paragraphs(text):
    out, cur = [], 0
    for part in re.split(r"\n\s*\n", text):
        part = part.strip()
        if part:
            at = text.index(part, cur)
            out.append((part, at))
            cur = at + len(part)
    return out


def cut(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        out.append((text[at : at + size], at))
        if at + size >= len(text):
            break
        at += size - overlap
    return out


def merged(pieces, size):
    groups = []
    for text, start in pieces:
        if groups and len(groups[-1][0]) + len(text) + 2 <= size:
            groups[-1] = (groups[-1][0] + "\n\n" + text, groups[-1][1])
        else:
            groups.append((text, start))
    return [(t.strip(), s, s + len(t)) for t, s in groups if t.strip()]


@SLOW
@given(docs=DOCS, size=st.integers(100, 200), overlap=st.integers(0, 99))
def test_fixed(spark, docs, size, overlap):
    got = frame(spark, docs).select(C.split_content(C.ChunkConfig(size, overlap, "fixed_size"), F.col("t"))).collect()
    for doc, row in zip(docs, got, strict=True):
        want = [(c, s, s + len(c)) for c, s in cut(doc, size, overlap)] if doc.strip() else []
        assert [tuple(c)[:3] for c in row[0]] == want


@SLOW
@given(docs=DOCS, size=st.integers(100, 200), overlap=st.integers(0, 99))
def test_semantic_and_hybrid(spark, docs, size, overlap):
    df = frame(spark, docs)
    semantic = df.select(C.split_content(C.ChunkConfig(size, overlap, "semantic"), F.col("t"))).collect()
    hybrid = df.select(C.split_content(C.ChunkConfig(size, overlap), F.col("t"))).collect()
    for doc, s_row, h_row in zip(docs, semantic, hybrid, strict=True):
        pieces = []
        for text, start in paragraphs(doc):
            if len(text) <= size:
                pieces.append((text, start))
            else:
                pieces += [(c, start + s) for c, s in cut(text, size, overlap)]
        assert [tuple(c)[:2] for c in s_row[0]] == pieces
        assert [tuple(c)[:3] for c in h_row[0]] == merged(pieces, size)
        assert all(len(c.content) <= size for c in h_row[0])


@SLOW
@given(docs=DOCS)
def test_markdown_sections_stay_whole(spark, docs):
    config = C.ChunkConfig(5000, 0, "semantic")
    df = frame(spark, docs).withColumn("s", S.markdown_sections(F.col("t")))
    rows = df.select("t", "s", C.split_content(config, F.col("t"), F.lit("markdown"), F.col("s")).alias("c"))
    for row in rows.collect():
        want, at = [], 0
        for s in row.s:
            mark = "#" * s.level + " " if s.level else ""
            text = f"{mark}{s.title}\n\n{s.content}" if s.title else s.content
            if text.strip() and row.t.strip():
                want.append((text.strip(), at, at + len(text), s.title, s.level))
            at += len(text) + 1
        assert [(c.content, c.start_char, c.end_char, c.section_title, c.section_level) for c in row.c] == want


def test_code_chunks(spark):
    code = "import os\n\ndef f():\n    pass\n\nclass A:\n    x = 1"
    df = spark.createDataFrame([(code,)], "t string").withColumn("s", S.code_sections(F.col("t"), F.lit("python")))
    out = df.select(
        C.split_content(C.ChunkConfig(200, 0, "semantic"), F.col("t"), F.lit("code"), F.col("s"), F.lit("python"))
    ).first()[0]
    assert [(c.definition, c.language) for c in out] == [
        (None, "python"), ("def f", "python"), ("class A", "python")]
    assert "\n".join(c.content for c in out) == code


@SLOW
@given(docs=DOCS, target=st.integers(0, 300))
def test_boundaries(spark, docs, target):
    df = frame(spark, docs).select(
        C.boundaries(F.col("t")).alias("b"),
        C.nearest_boundary(C.boundaries(F.col("t")), F.lit(target), 400).alias("n"),
    )
    for doc, row in zip(docs, df.collect(), strict=True):
        want = sorted(
            {m.end() for m in re.finditer(r"\n\s*\n", doc)}
            | {m.start() + 1 for m in re.finditer(r"\n#{1,6}\s", doc)}
            | {m.start() + 1 for m in re.finditer(r"\n```", doc)}
        )
        assert row.b == want
        near = [b for b in want if abs(b - target) <= 100]
        before = [b for b in near if b <= target]
        assert row.n == (max(before) if before else min(near) if near else target)


def test_long_document(spark):
    """Many pieces in one row: offsets and merge stay exact and fast."""
    n = 30000
    df = spark.range(1).select(F.repeat(F.lit("paragraph\n\n"), n).alias("t"))
    out = df.select(F.explode(C.split_content(C.ChunkConfig(1000, 0), F.col("t"))).alias("c")).select("c.*")
    per_chunk = (1000 + 2) // 11
    assert out.count() == -(-n // per_chunk)
    assert out.filter(F.col("start_char") % (per_chunk * 11) != 0).count() == 0


@pytest.mark.parametrize("args", [(50, 0, "hybrid"), (100, 100, "hybrid"), (100, -1, "hybrid"), (100, 0, "x")])
def test_config(args):
    with pytest.raises(ValueError):
        C.ChunkConfig(*args)
