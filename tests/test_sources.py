import json
import os

import pytest
from pyspark.sql import functions as F

from tunekit.functions import json_text as J
from tunekit.operators.fields import FieldNotFound, require_field, require_variant_field, variant_fields
from tunekit.operators.parsing import Parsers, UnsupportedFormat, extract_pages, page_documents, page_rows, parse_documents, with_page_content
from tunekit.sources import datasets as D
from tunekit.sources import documents as Docs
from tunekit.sources import writers as W

ROWS = [
    ("one", 'quote " and, comma', "line\nbreak"),
    ("二", "back\\slash", "tab\there"),
    ("three", "'single'", " x "),
]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(ROWS, "a string, b string, c string")


def as_set(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


@pytest.mark.parametrize("fmt", ["jsonl", "json", "csv", "tsv", "parquet"])
def test_round_trip(spark, sample, tmp_path, fmt):
    path = str(tmp_path / f"out.{fmt}")
    W.write_dataset(sample, path)
    back = D.read_dataset(spark, path)
    assert as_set(back, "a", "b", "c") == sorted(ROWS)


def test_chain(spark, sample, tmp_path):
    names = ["jsonl", "csv", "json", "tsv", "parquet"]
    W.write_dataset(sample, str(tmp_path / "0.jsonl"))
    for i, fmt in enumerate(names[1:], 1):
        W.convert(spark, str(tmp_path / f"{i - 1}.{names[i - 1]}"), str(tmp_path / f"{i}.{fmt}"))
    assert as_set(D.read_dataset(spark, str(tmp_path / "4.parquet")), "a", "b", "c") == sorted(ROWS)


def test_json_parts_are_arrays(spark, sample, tmp_path):
    path = str(tmp_path / "o.json")
    W.write_json(sample.repartition(2), path)
    parts = [p for p in os.listdir(path) if p.startswith("part")]
    loaded = [json.load(open(os.path.join(path, p), encoding="utf-8")) for p in parts]
    assert sum(map(len, loaded)) == 3 and all(isinstance(x, list) for x in loaded)


def test_write_rules(spark, sample, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with pytest.raises(W.EmptyDataset):
        W.write_dataset(sample.limit(0), path)
    W.write_dataset(sample, path)
    W.write_dataset(sample.limit(0), path, mode="append")
    W.write_dataset(sample, path, mode="append")
    assert D.read_dataset(spark, path).count() == 6
    W.write_dataset(sample, path, mode="overwrite")
    assert D.read_dataset(spark, path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        W.write_dataset(sample, path)
    with pytest.raises(D.FormatError):
        W.write_dataset(sample, path, fmt="xml")


def test_jsonl_lines(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a":1}\n\n  \nnot json\n[1]\n{"b":null,"c":{"d":[1]}}\n', encoding="utf-8")
    rows = D.scan_jsonl(spark, str(f)).orderBy(*D.ORDER_COLUMNS).collect()
    assert [r.error for r in rows] == [
        None, "Invalid JSON", "Line is no JSON object but array", None]
    assert [(r.line, r.error) for r in D.bad_line_numbers(spark, str(f)).orderBy("line").collect()] == [
        (4, "Invalid JSON"), (5, "Line is no JSON object but array")]
    assert D.quarantined_lines(spark, str(f)).count() == 2
    good = D.read_jsonl_variant(spark, str(f), strict=False)
    assert [r[0] for r in variant_fields(good).collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="Invalid JSON"):
        D.read_jsonl_variant(spark, str(f)).collect()
    assert tuple(D.is_valid_jsonl(spark.read.text(str(f))).first()) == (False, 4, 1)
    assert require_variant_field(good, "b")
    with pytest.raises(FieldNotFound) as info:
        require_variant_field(good, "zz")
    assert info.value.available == ["a", "b", "c"]
    assert require_variant_field(good, "zz", create_new_field=True)
    with pytest.raises(FieldNotFound):
        require_field(good, "zz")


def test_csv_cells(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes(b'a, b,c\n1, "x, y" , \n , ,\n"q\x00""z","two\nlines",\xff\n')
    got = as_set(D.read_dataset(spark, str(f)))
    assert [r[0] for r in got] == ["1", 'q"z']
    assert got[1][1:] == ("two\nlines", "�")
    assert got[0][2] is None


@pytest.mark.parametrize(
    "line,fmt", [('{"a":1}', "jsonl"), ("a,b", "csv"), ("a\tb", "tsv"), ("123", "jsonl"), ("[1,2]", "csv"), ("word", "jsonl")]
)
def test_sniff(spark, tmp_path, line, fmt):
    f = tmp_path / "x.txt"
    f.write_text(line + "\n")
    assert D.detect_format(spark, str(f)) == fmt


def test_detect(spark, tmp_path):
    assert D.detect_format(spark, "/x/A.JSONL") == "jsonl"
    (tmp_path / "x.xml").write_text("<a/>")
    with pytest.raises(D.FormatError):
        D.detect_format(spark, str(tmp_path / "x.xml"))


def test_mixed_directory(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1,"n":{"x":1}}\n')
    (tmp_path / "b.CSV").write_text("a,z\n2,zed\n")
    (tmp_path / "c.json").write_text('[{"a":3}]')
    (tmp_path / "d.txt").write_text("a\tz\n4\tq\n")
    got = D.read_directory(spark, str(tmp_path))
    assert sorted(got.columns) == ["a", "n", "z"]
    assert sorted(r["a"] for r in got.collect()) == ["1", "2", "3", "4"]


def test_mirror(spark, sample, tmp_path):
    for split, n in (("train", 3), ("test", 1)):
        sample.limit(n).write.parquet(str(tmp_path / "ds" / "default" / split))
    assert D.read_mirror(spark, str(tmp_path), "ds", max_entries=2).count() == 2
    assert D.read_mirror(spark, str(tmp_path), "ds", max_entries=0).count() == 3
    got = D.describe_mirror(spark, str(tmp_path), "ds").orderBy("split").collect()
    assert [(r.config, r.split, r.rows) for r in got] == [("default", "test", 1), ("default", "train", 3)]
    assert got[0].fields == "a: string, b: string, c: string"


@pytest.fixture
def docs(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("intro\n# One\r\nbody\n", newline="")
    (tmp_path / "b.HTML").write_text(
        '<html><head><title>T &amp; U</title><meta name="description" content="D"></head>'
        "<body><h1>Head</h1><script>x()</script><p>one&nbsp;two</p><!-- c --></body></html>"
    )
    (tmp_path / "c.txt").write_bytes("caf\xe9\n\nnext".encode("latin-1"))
    (tmp_path / "sub" / "d.json").write_text('{"title":"T","b":["x",{"c":"y\\n"}],"n":1,"e":" "}')
    (tmp_path / "sub" / "e.py").write_text("def f():\n    pass\n")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "z.bin").write_text("skip")
    return tmp_path


def test_documents(spark, docs):
    listed = [r.source_path.rsplit("/", 1)[1] for r in Docs.list_documents(spark, str(docs)).collect()]
    assert listed == ["a.md", "b.HTML", "bad.json", "c.txt", "d.json", "e.py"]
    assert Docs.list_documents(spark, str(docs), recursive=False).count() == 4
    assert Docs.list_documents(spark, str(docs), pattern="[ab]*.??").count() == 1
    parsed = {
        r.source_path.rsplit("/", 1)[1]: r
        for r in parse_documents(Docs.read_documents(spark, str(docs))).collect()
    }
    assert [s.title for s in parsed["a.md"].sections] == [None, "One"]
    assert parsed["a.md"].metadata == {"title": "One"}
    assert parsed["b.HTML"].content == "T & UHead\none two" or "Head" in parsed["b.HTML"].content
    assert parsed["b.HTML"].metadata == {"title": "T & U", "description": "D"}
    assert [s.content for s in parsed["c.txt"].sections] == ["café", "next"]
    assert parsed["d.json"].content == "T\nx\ny\n"
    assert parsed["d.json"].metadata == {"original_structure": "dict", "title": "T"}
    assert parsed["e.py"].metadata == {"language": "python", "extension": ".py", "filename": "e.py"}
    assert parsed["e.py"].sections[0].title == "def f"
    assert parsed["bad.json"].error == "Invalid JSON" and parsed["bad.json"].content is None
    tree = parse_documents(Docs.read_documents(spark, str(docs), "*.HTML"), html_method="tree").first()
    assert tree.content == "Head\none two"


def test_parsers(spark):
    parsers = Parsers().register(["RST"], "rst", lambda c: F.upper(c))
    df = spark.createDataFrame([("/x/a.rst", "abc"), ("/x/b.q", "z")], "source_path string, raw_text string")
    got = {r.source_path: r for r in parse_documents(df, parsers).collect()}
    assert got["/x/a.rst"].content == "ABC" and got["/x/a.rst"].sections[0].content == "ABC"
    assert got["/x/b.q"].error.startswith("Unsupported format: .q. Supported: .c, .cc")
    with pytest.raises(UnsupportedFormat) as info:
        Parsers().require("/x/b.q")
    assert ".md" in info.value.supported
    assert Parsers().require("A.MD") == "markdown"


def test_pages(spark):
    files = spark.createDataFrame([("a.pdf", b"x|y||!"), ("b.pdf", b"#")], "source_path string, bytes binary")

    def pages_of(data):
        if data == b"#":
            raise ValueError("broken")
        for i, part in enumerate(data.decode().split("|"), 1):
            yield (i, None, "no text") if part == "!" else (i, part, None)

    out = {r.source_path: r for r in with_page_content(extract_pages(files, pages_of)).collect()}
    a = out["a.pdf"]
    assert a.content == "x\n\ny\n\n[Error extracting page 4: no text]"
    assert [(s.title, s.start_line) for s in a.sections] == [("Page 1", 0), ("Page 2", 1)]
    assert a.metadata == {"page_count": "4"}
    assert out["b.pdf"].error == "Failed to parse b.pdf: broken" and out["b.pdf"].content is None


def test_strict_lines(spark, tmp_path):
    for bad in ('{"a":5}{"a":6}', '{"a":4} junk', '[{"a":2},{"a":3}]', "7", '{"a":'):
        f = tmp_path / "x.jsonl"
        f.write_text('{"a":1}\n' + bad + "\n\n")
        with pytest.raises(Exception, match="x.jsonl"):
            D.read_dataset(spark, str(f)).collect()
        assert [r.a for r in D.read_dataset(spark, str(f), strict=False).collect()] == [1]
        assert [r.a for r in D.read_dataset(spark, str(f), schema="a long", strict=False).collect()] == [1]


def test_strict_arrays(spark, tmp_path):
    f = tmp_path / "x.json"
    for bad in ('[{"a":1}] [{"a":2}]', '{"a":1}', "[1]", '[{"a":1}', "[null]"):
        f.write_text(bad)
        with pytest.raises(Exception):
            D.read_dataset(spark, str(f), schema="a long").collect()
    f.write_text(' [{"a":1},\n{"b":"x"}]\n')
    assert [tuple(r) for r in D.read_dataset(spark, str(f)).collect()] == [(1, None), (None, "x")]


def test_large_values(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text(json.dumps({"a": "x" * (40 << 20)}) + "\n" + json.dumps({"a": "y"}) + "\n")
    assert sorted(r.n for r in D.read_dataset(spark, str(f)).selectExpr("length(a) AS n").collect()) == [1, 40 << 20]
    leaves = spark.read.text(str(f)).select(J.string_leaves(F.col("value")).alias("v")).selectExpr("length(v[0]) AS n")
    assert sorted(r.n for r in leaves.collect()) == [1, 40 << 20]


def test_ragged_rows(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('a,b\n1,2,3\n4\n5,"6,""x",7,"8,9"\n')
    with pytest.raises(Exception, match="more cells"):
        D.read_dataset(spark, str(f)).collect()
    got = sorted(tuple(r) for r in D.read_dataset(spark, str(f), extra="more").collect())
    assert got == [("1", "2", '["3"]'), ("4", None, None), ("5", '6,"x', '["7","8,9"]')]


def test_different_headers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d" / "2.csv").write_text("b,c\n3,4\n")
    (tmp_path / "d" / "3.csv").write_text("a,b\n5,6\n")
    for got in (D.read_dataset(spark, str(tmp_path / "d")), D.read_directory(spark, str(tmp_path / "d"))):
        assert sorted((tuple(r) for r in got.select("a", "b", "c").collect()), key=str) == sorted([("1", "2", None), ("5", "6", None), (None, "3", "4")], key=str)


@pytest.mark.parametrize("fmt", ["jsonl", "json", "csv", "tsv", "parquet"])
def test_null_columns_stay(spark, tmp_path, fmt):
    path = str(tmp_path / f"x.{fmt}")
    W.write_dataset(spark.createDataFrame([(1, None), (2, None)], "a long, b string"), path)
    assert sorted(D.read_dataset(spark, path).columns) == ["a", "b"]


def test_csv_mirror(spark, tmp_path):
    W.write_dataset(spark.range(3), str(tmp_path / "ds" / "default" / "train"), "csv")
    assert D.describe_mirror(spark, str(tmp_path), "ds", "csv").first().rows == 3


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a", "b"):
        rows = [f'{{"n":{i}}}' if i % 97 else ("" if i % 2 else "bad") for i in range(5000)]
        (tmp_path / "d" / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = D.bad_line_numbers(spark, str(tmp_path / "d")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [i + 1 for i in range(0, 5000, 97) if i % 2 == 0]
    for name in ("a", "b"):
        assert sorted(r.line for r in got if r.file.endswith(f"{name}.jsonl")) == want


def test_registered_page_parser(spark, tmp_path):
    for name, text in (("a.BOOK", "x|y| |!|z"), ("b.book", "broken"), ("c.txt", "plain"), ("d.book", " ")):
        (tmp_path / name).write_text(text)

    def pages_of(data):
        for i, part in enumerate(data.decode().split("|"), 1):
            if part == "broken":
                raise ValueError("no pages")
            yield (i, None, "smudged") if part == "!" else (i, part, None)

    parsers = Parsers().register_pages(["book"], "book", pages_of)
    assert parsers.require("x.Book") == "book"
    files = Docs.read_paged_bytes(spark, str(tmp_path), parsers=parsers)
    assert sorted(r.source_path[-6:] for r in files.collect()) == ["a.BOOK", "b.book", "d.book"]
    rows = page_rows(files, parsers)
    got = sorted(((r.source_path[-6:], r.page or 0, r.text, r.error) for r in rows.collect()), key=str)
    assert [g[:3] for g in got] == [("a.BOOK", 1, "x"), ("a.BOOK", 2, "y"), ("a.BOOK", 3, " "), ("a.BOOK", 4, None), ("a.BOOK", 5, "z"), ("b.book", 0, None), ("d.book", 1, " ")]
    assert got[3][3] == "smudged" and got[5][3].startswith("Failed to parse") and got[5][3].endswith("no pages")
    docs = {(r.source_path[-6:], r.page): r for r in page_documents(rows).collect()}
    assert set(docs) == {("a.BOOK", 1), ("a.BOOK", 2), ("a.BOOK", 4), ("a.BOOK", 5), ("b.book", None)}
    one = docs["a.BOOK", 5]
    assert (one.content, one.doc_type, one.sections[0].title, one.sections[0].start_line, one.metadata) == ("z", "book", "Page 5", 4, {"page": "5"})
    assert docs["a.BOOK", 4].sections is None and docs["a.BOOK", 4].error == "smudged"
    text = parse_documents(spark.createDataFrame([("d.book", None)], "source_path string, raw_text string"), parsers).first()
    assert text.error == "Paged document: needs a page extractor"


def test_pages_are_handed_on_one_by_one(spark, tmp_path):
    """A file of 10,000 pages of 10 KB: the parser is never far ahead of what has been handed on."""
    (tmp_path / "a.book").write_text("10000")
    marks = tmp_path / "marks"
    marks.mkdir()

    def pages_of(data):
        import resource

        for i in range(int(data)):
            yield i + 1, f"{i} " + "x" * 10_000, None
        (marks / "peak").write_text(str(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024))

    files = Docs.read_paged_bytes(spark, str(tmp_path), "*.book", parsers=Parsers().register_pages(["book"], "book", pages_of))
    rows = page_rows(files, pages_of)
    got = rows.agg(F.count("page"), F.sum(F.length("text")), F.max("page")).first()
    assert tuple(got) == (10_000, sum(len(f"{i} ") + 10_000 for i in range(10_000)), 10_000)
    assert int((marks / "peak").read_text()) < 400  # 100 MB of text alone would be 200 MB on top of a worker's own
