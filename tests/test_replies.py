import html
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunekit.functions import html as H
from tunekit.functions import json_text as J
from tunekit.functions import text as T
from tunekit.operators import quality as Q
from tunekit.operators import entries as E
from tunekit.operators import fields as Fields
from tunekit.operators import validation as V
from tunekit.operators.responses import lenient_entries, parse_replies, strict_entries

SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def apply(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


ENTRY = {"instruction": "do", "input": "", "output": 'use {braces} and "quotes"'}
BODY = json.dumps(ENTRY)
WRAPPED = [
    BODY,
    f"```json\n{BODY}\n```",
    f"```\n{BODY}\n```",
    f"```{BODY}```",
    f"Here's the JSON: {BODY}",
    f"Here is the JSON:\n{BODY}",
    f"Result: {BODY}",
    f"Some talk {BODY} more talk",
    f"  \n\t{BODY}\n  ",
    f"JSON: ```json\n{BODY}\n```",
    f"Sure!\n```json\n{BODY}\n```",
    f"text\n```\n{BODY}\n```",
]
BROKEN = ["", "   ", None, "not json", "{", "}", "{}", "[]", "[1, 2]", '"text"', "5", "null"]
TRAILING = ['{"a": 1} x', '{"a": 1},', "[1] 2", "1] [2", "1,2", "{}{}", '{"a": 1}}', "1, ", "[1]]", '"a" "b"']


def test_wrapped_replies(spark):
    got = apply(spark, WRAPPED, lambda c: lenient_entries(c, "sft"))
    assert [[r.asDict() for r in rows] for rows in got] == [[ENTRY]] * len(WRAPPED)


def test_broken_replies(spark):
    got = apply(spark, BROKEN, lambda c: lenient_entries(c, "sft"))
    assert all(not rows for rows in got)
    got = apply(spark, BROKEN, lambda c: strict_entries(c, "sft"))
    assert [len(r or []) for r in got] == [0] * 6 + [1] + [0] * 5  # {} becomes an empty entry


def test_parse_reads_to_the_end(spark):
    assert apply(spark, TRAILING, lambda c: J.parse(c).isNull()) == [True] * len(TRAILING)
    good = ['{"a": 1}', " [1] ", "1", '"x"', "null", "true", "-1.5e3", "[]", "{}", "\n{}\n"]
    assert apply(spark, good, lambda c: J.parse(c).isNull()) == [False] * len(good)
    assert apply(spark, ['{"a": [1, {"b": "c"}]}', "null"], lambda c: F.to_json(J.parse(c))) == [
        '{"a":[1,{"b":"c"}]}', "null"]


def test_repair(spark):
    texts = [
        '{"instruction": "a", "input": "b", "output": "c",}',
        "{'instruction': 'a', 'input': 'b', 'output': 'c'}",
        '[{"instruction": "a", "input": "b", "output": "c",},]',
    ]
    got = apply(spark, texts, lambda c: lenient_entries(c, "sft"))
    assert [[tuple(r) for r in rows] for rows in got] == [[("a", "b", "c")]] * 3


def test_arrays_and_lone_objects(spark):
    conv = {"conversations": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    texts = [json.dumps([conv, 3, conv]), json.dumps(conv), "ok: " + json.dumps(conv)]
    got = apply(spark, texts, lambda c: lenient_entries(c, "sft_conv"))
    assert [len(r) for r in got] == [2, 1, 1]


def test_messages(spark):
    msgs = [
        {"role": "user", "content": 5},
        {"role": "robot", "content": "x"},
        {"role": "assistant"},
        "text",
        {"role": ["user"], "content": "x"},
        {"role": "system", "content": None},
        {"role": "assistant", "content": True},
    ]
    got = apply(spark, [json.dumps({"conversations": msgs})], lambda c: strict_entries(c, "sft_conv"))
    assert [tuple(m) for m in got[0][0].conversations] == [
        ("user", "5"), ("system", "None"), ("assistant", "True")]


def test_missing_keys(spark):
    text = [json.dumps([{"prompt": "p", "chosen": None}, {"prompt": "p", "chosen": "c", "rejected": "r"}])]
    assert len(apply(spark, text, lambda c: lenient_entries(c, "dpo"))[0]) == 1
    got = apply(spark, text, lambda c: strict_entries(c, "dpo"))[0]
    assert [tuple(r) for r in got] == [("p", "None", ""), ("p", "c", "r")]


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5)
    | st.text(alphabet='ab :",\\\n\té日😀{}[]', max_size=6),
    lambda kids: st.lists(kids, max_size=3) | st.dictionaries(st.text(alphabet='k"\\:é', max_size=4), kids, max_size=3),
    max_leaves=12,
)


def leaves(x):
    if isinstance(x, str):
        return [x] if x.strip() else []
    if isinstance(x, dict):
        return [s for v in x.values() for s in leaves(v)]
    return [s for v in x for s in leaves(v)] if isinstance(x, list) else []


@SLOW
@given(st.lists(JSON, min_size=30, max_size=30), st.booleans(), st.sampled_from([None, 2]))
def test_string_leaves(spark, values, ascii_only, indent):
    texts = [json.dumps(v, ensure_ascii=ascii_only, indent=indent) for v in values]
    assert apply(spark, texts, J.string_leaves) == [leaves(v) for v in values]


def test_string_leaves_of_invalid(spark):
    long = json.dumps({"k": "x\\y" * 20000})
    assert [len(x) if x else x for x in apply(spark, ['{"a"', "", long], J.string_leaves)] == [None, None, 1]


@SLOW
@given(st.lists(st.text(alphabet=" \t\n\x1c\x85\xa0　​a.é", max_size=8), min_size=40, max_size=40))
def test_strip(spark, texts):
    assert apply(spark, texts, T.strip) == [t.strip() for t in texts]


def test_names(spark):
    paths = ["/a/b.tar.GZ", "/a/.bashrc", "b.", "/x.y/c", "q.Md", ""]
    assert apply(spark, paths, T.extension) == [".gz", "", "", "", ".md", ""]
    names = ["readme.md", "a.txt", "test_x.py", "b1.md", "[x].md", "a\nb.md"]
    import fnmatch

    for pattern in ["*.md", "test_*.py", "?.txt", "[ab]*", "[!ab]*", "*", "b[0-9].md", "*.M?", "[[]x].md", "a*b*d"]:
        got = apply(spark, names, lambda c, p=pattern: Fields.name_matches(c, p))
        assert got == [fnmatch.fnmatchcase(n, pattern) for n in names], pattern


def test_preview_and_nul(spark):
    assert apply(spark, ["x" * 101, "x" * 100], T.text_preview) == ["x" * 100 + "...", "x" * 100]
    assert apply(spark, ["a\x00b"], T.remove_nul) == ["ab"]


def test_entities(spark):
    texts = ["a &amp; b", "&lt;p&gt;", "plain", "&copy &#169; &#xA9;", "&notit; &nope;", None]
    assert apply(spark, texts, H.unescape) == [t if t is None else html.unescape(t) for t in texts]


def test_validation(spark):
    rows = [("a", "b", "c"), ("a", " 　", "c"), ("a", None, "c"), ("", "b", "c"), ("x", "y ", " y")]
    sft = spark.createDataFrame(rows, "instruction string, input string, output string")
    got = V.with_validity(sft, "sft").collect()
    assert [r.reject_reason for r in got] == [None, "blank input", "blank input", "blank instruction", None]
    dpo = sft.toDF("prompt", "chosen", "rejected")
    assert [r.reject_reason for r in V.with_validity(dpo, "dpo").collect()][-1] == "chosen equals rejected"
    assert V.valid_entries(dpo, "dpo").count() + V.rejected_entries(dpo, "dpo").count() == 5
    mixed = sft.withColumn("text", F.lit("t")).withColumn("dataset_type", F.lit("pretrain"))
    assert V.with_validity_by_type(mixed).filter("valid").count() == 5
    assert V.with_validity_by_type(mixed.withColumn("dataset_type", F.lit("?"))).filter("valid").count() == 0
    u, a, s = ("user", "q"), ("assistant", "a"), ("system", "s")
    convs = [[u, a], [s, u], [u, ("assistant", " ")], [], None, [u, a, ("robot", "x")], [a]]
    df = spark.createDataFrame([(c,) for c in convs], f"conversations {E.MESSAGES_TYPE}")
    assert [r.reject_reason for r in V.with_validity(df, "sft_conv").collect()] == [
        None, "no assistant message", "blank message", "no messages", "no messages", "unknown role", "no user message"]


def test_round_trip_and_inference_of_type(spark):
    for kind, row in {
        "sft": ("a", "b", "c"),
        "pretrain": ("t",),
        "dpo": ("p", "c", "r"),
        "sft_conv": ([("user", "q"), ("assistant", "a")],),
    }.items():
        df = spark.createDataFrame([row], E.entry_ddl(kind))
        text = df.select(E.entry_json(kind).alias("j"))
        assert E.entries_from_json(text, "j", kind).collect() == df.collect()
        assert text.select(E.infer_dataset_type(J.parse(F.col("j")))).first()[0] == kind
    keys = ['{"text":1,"instruction":2}', '{"prompt":null}', '{"x":1}']
    assert apply(spark, keys, lambda c: E.infer_dataset_type(J.parse(c))) == ["sft", "dpo", None]


def test_output_schema():
    one = json.loads(E.output_schema("dpo"))
    assert one["required"] == ["prompt", "chosen", "rejected"]
    many = json.loads(E.output_schema("sft_conv", 5))
    assert many["type"] == "array"
    assert many["items"]["properties"]["conversations"]["items"]["properties"]["role"]["enum"] == list(E.ROLES)
    with pytest.raises(ValueError):
        E.output_schema("nope")


def test_parse_replies_keeps_keys(spark):
    df = spark.createDataFrame([(1, "[" + BODY + "," + BODY + "]"), (2, "junk")], "id int, raw_content string")
    got = parse_replies(df, "sft").orderBy("id", "entry_index").collect()
    assert [(r.id, r.entry_index) for r in got] == [(1, 0), (1, 1)]


def windows_by_hand(text, places, width, overlap):
    if len(places) <= width:
        return [text]
    out, i = [], 0
    while True:
        own = places[i : i + width]
        out.append(text[own[0][0] : own[-1][1]])
        if i + width >= len(places):
            return out
        i += width - overlap


def test_windows_of_a_tokenizer(spark):
    pieces = re.compile(r"\w{1,3}|[^\w\s]")

    def load():
        return lambda texts: [[m.span() for m in pieces.finditer(t)] for t in texts]

    texts = ["", " ", "a", "abcdefg hij", "one  two,three\n四五六七八 \U0001f600x " * 20, None, "abc " * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for width, overlap, size in ((12, 4, 64), (5, 0, 1), (1, 0, 3)):
        cut = Q.text_windows(F.col("text"), Q.BatchTokenizer(load, size), width, overlap)
        got = {r.id: r.w for r in df.select("id", cut.alias("w")).collect()}
        for i, t in enumerate(texts):
            want = [None] if t is None else windows_by_hand(t, [m.span() for m in pieces.finditer(t)], width, overlap)
            assert got[i] == want
    for bad in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            Q.text_windows(F.col("text"), Q.BatchTokenizer(load), *bad)
    with pytest.raises(Exception, match="as many token lists"):
        df.select(Q.text_windows(F.col("text"), Q.BatchTokenizer(lambda: lambda texts: []))).collect()


def test_quality_over_windows_of_a_tokenizer(spark):
    def load():
        return lambda texts: [[(i, min(i + 2, len(t))) for i in range(0, len(t), 2)] for t in texts]

    scorer = Q.LexiconScorer(("bad",), tokenizer=Q.BatchTokenizer(load))
    rows = [(1, "x" * 8 + "bad" + "x" * 9, "ok", "fine"), (2, "x" * 40, "y", "z")]
    df = spark.createDataFrame(rows, "id int, instruction string, input string, output string")
    got = {r.id: r for r in Q.with_quality(df, "sft", Q.Quality(scorer, 0.9, width=4, overlap=1)).collect()}
    first = got[1].qc_fields[0]
    assert (first.num_windows, first.ok, got[1].failed_fields) == (3, False, ["instruction"])
    assert first.accepted_probability == pytest.approx(2 / 3) and got[2].qc_passed and got[2].qc_fields[0].num_windows == 7


def test_windows_of_a_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")

    def load():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [e.offsets for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    text = "The quick brown fox jumps over the lazy dog. " * 60
    got = spark.createDataFrame([(text,)], "text string").select(Q.text_windows(F.col("text"), Q.BatchTokenizer(load)).alias("w")).first().w
    places = load()([text])[0]
    assert len(places) > 382 and got == windows_by_hand(text, places, 382, 128)
