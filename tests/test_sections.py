"""Sections against a line-by-line walk written for these tests."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunekit.operators import sections as S

LINES = st.sampled_from(
    ["", " ", "text", "  more text", "# One", "## Two ", "##", "#x", "#######", "### ", "\u3000", "---", "a: b"]
)
DOCS = st.lists(st.lists(LINES, max_size=12).map("\n".join), min_size=20, max_size=20)
SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def walk_text(doc):
    found, open_lines, start = [], [], 0
    lines = doc.split("\n")
    for i, line in enumerate([*lines, ""]):
        at_end = i == len(lines)
        if at_end or (line.strip() == "" and open_lines):
            body = "\n".join(open_lines).strip()
            if body:
                found.append((None, body, 0, start, i - 1))
            open_lines, start = [], i + 1
        else:
            open_lines.append(line)
    return found or [(None, doc.strip(), 0, 0, len(lines) - 1)]


def walk_heads(doc, heading, strip_body, keep_head):
    lines = doc.split("\n")
    heads = [i for i, line in enumerate(lines) if heading(line)]
    bounds = [-1, *heads] if keep_head else [-1, *heads]
    found = []
    for n, h in enumerate(bounds):
        end = bounds[n + 1] if n + 1 < len(bounds) else len(lines)
        body = lines[max(h, 0) if keep_head else h + 1 : end]
        title, level = (None, 0) if h < 0 else heading(lines[h])
        text = "\n".join(body)
        if body or title:
            found.append((title, text.strip() if strip_body else text, level, max(h, 0), end - 1))
    return found or [(None, doc.strip(), 0, 0, len(lines) - 1)]


def md_heading(line):
    m = re.match(r"\s*(#{1,6})(?: |\Z)", line)
    return m and (line.lstrip()[len(m[1]) :].strip(), len(m[1]))


def py_heading(line):
    m = re.match(r"(def|class)\s+(\w+)", line.strip())
    return m and (f"{m[1]} {m[2]}", 1)


def rows(spark, docs, column):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    return [[tuple(s) for s in r[0]] for r in df.orderBy("i").select(column).collect()]


@SLOW
@given(docs=DOCS)
def test_markdown(spark, docs):
    got = rows(spark, docs, S.markdown_sections(F.col("t")))
    assert got == [walk_heads(d, md_heading, True, False) for d in docs]


@SLOW
@given(docs=DOCS)
def test_text(spark, docs):
    assert rows(spark, docs, S.text_sections(F.col("t"))) == [walk_text(d) for d in docs]


CODE = st.lists(
    st.lists(
        st.sampled_from(["", "import os", "def f(x):", "    return x", "class  K:", "    def g(self): pass"]),
        max_size=10,
    ).map("\n".join),
    min_size=20,
    max_size=20,
)


@SLOW
@given(docs=CODE)
def test_code(spark, docs):
    got = rows(spark, docs, S.code_sections(F.col("t"), F.lit("python")))
    assert got == [walk_heads(d, py_heading, False, True) for d in docs]


@pytest.mark.parametrize(
    "language,line,title",
    [
        ("javascript", "const go = (a) => a", "function go"),
        ("typescript", "class A {", "class A"),
        ("java", "public static void main(String[] a) {", "void main"),
        ("go", "func (r *T) Run() {", "func Run"),
        ("go", "type T struct {", "type T"),
        ("rust", "pub fn f() {", "fn f"),
        ("cpp", "struct P {", "struct P"),
        ("ruby", "module M", "module M"),
        ("c", "int main() {", None),
        ("unknown", "def f", None),
    ],
)
def test_definitions(spark, language, line, title):
    got = spark.range(1).select(S.definition_title(F.lit(line), F.lit(language))).first()[0]
    assert got == title


def test_markdown_metadata(spark):
    docs = [
        "---\na: 1\nb : x:y\na: 2\n---\n# Head\n",
        "text\n  # First \n# Second",
        "---\nno end\n# T",
        "---\ntitle: Given\n---\n# Other",
        "plain",
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(S.markdown_metadata(F.col("t"))).collect()]
    assert got == [
        {"a": "2", "b": "x:y", "title": "Head"},
        {"title": "First"},
        {"title": "T"},
        {"title": "Given"},
        {},
    ]


def test_json_metadata(spark):
    docs = ['{"title":"T","id":3,"name":"N"}', "[1]", "3.5", "nope", "null"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(S.json_metadata(F.col("t"))).collect()]
    assert got == [
        {"original_structure": "dict", "title": "T", "name": "N"},
        {"original_structure": "list"},
        {"original_structure": "float"},
        None,
        {"original_structure": "NoneType"},
    ]
