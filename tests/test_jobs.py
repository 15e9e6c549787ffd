import json

import pytest
from pyspark.sql import functions as F

from tunekit.operators import inference as I
from tunekit.operators import limits as L
from tunekit.operators import prompts as P
from tunekit.operators import quality as Q
from tunekit.operators import reporting as R
from tunekit.operators.chunking import ChunkConfig
from tunekit.plans import jobs
from tunekit.plans import waves as W
from tunekit.sources.writers import write_dataset
from tunekit.streaming import jobs as stream


def echo_model():
    def load():
        def call(systems, users):
            if any("bad" in u for u in users):
                raise RuntimeError("Connection refused by bad prompt")
            return [f" {u.upper()} " for u in users]

        return call

    return I.BatchModel(load, name="echo-1", batch_size=4, concurrency=3)


ECHO = echo_model()


def prompts(spark, n):
    user = F.when(F.col("id") % 10 == 3, F.lit("bad ")).otherwise("ok ")
    return spark.range(n).select(
        "id", F.lit("s").alias("system_prompt"), F.concat(user, F.col("id")).alias("user_prompt")
    )


def test_batch_model(spark):
    got = I.infer(prompts(spark, 1000).repartition(4), ECHO).orderBy("id").collect()
    assert len(got) == 1000
    for r in got:
        if r.id % 10 == 3:
            assert r.raw_content is None and r.error == "Connection refused by bad prompt"
        else:
            assert r.raw_content == f" OK {r.id} " and r.error is None
    done = I.infer(prompts(spark, 100), ECHO)
    assert R.augmentation_summary(done).first().asDict() == {
        "total_entries": 100, "success_count": 90, "failure_count": 10, "success_rate": 90.0}
    assert [tuple(r) for r in R.errors_by_class(done).collect()] == [
        ("connection", 10, "Connection refused by bad prompt")]
    assert [r.id for r in R.first_errors(done, ("id",), 2).collect()] == [3, 13]


def test_model_is_called_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def load():
        def call(systems, users):
            for u in users:
                with open(f"{log}/{u.replace(' ', '_')}", "a") as f:
                    f.write("x")
            return list(users)

        return call

    df = I.infer(prompts(spark, 20), I.BatchModel(load))
    df.filter(F.col("error").isNull() & F.col("raw_content").isNotNull()).select("raw_content").collect()
    assert {p.read_text() for p in log.iterdir()} == {"x"}


def test_error_classes(spark):
    errors = ["model 'x' not found", "Model loading timeout", "context length exceeded", "connection reset", "odd", None]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(errors)], "i int, e string").orderBy("i")
    assert [r[0] for r in df.select(I.error_class(F.col("e"))).collect()] == [
        "model_not_found", "model_loading_timeout", "context_length_exceeded", "connection", "other", None]


def test_staged_resume(spark, tmp_path):
    staging, log = str(tmp_path / "staging"), tmp_path / "log"
    log.mkdir()

    def load():
        def call(systems, users):
            for u in users:
                with open(f"{log}/{u.replace(' ', '_')}", "a") as f:
                    f.write("x")
            if "bad" in users[0] and not (log / "fixed").exists():
                raise RuntimeError("down")
            return list(users)

        return call

    model = I.BatchModel(load, name="counting-1")
    first = I.infer_staged(prompts(spark, 30), model, staging, ("id",), waves=3)
    assert first.filter("error is not null").count() == 3 and first.count() == 30
    (log / "fixed").write_text("")
    second = I.infer_staged(prompts(spark, 40), model, staging, ("id",), waves=2)
    assert second.count() == 40 and second.filter("error is not null").count() == 0
    calls = {p.name: len(p.read_text()) for p in log.iterdir()}
    assert calls["ok_1"] == 1 and calls["bad_3"] == 2 and calls["ok_35"] == 1


def test_duplicate_rows_stay(spark, tmp_path):
    df = prompts(spark, 3).withColumn("user_prompt", F.lit("same"))
    out = I.infer_staged(df.union(df), ECHO, str(tmp_path / "s"), ("id",))
    assert out.count() == 6


@pytest.mark.parametrize("count,sizes", [(1, [1]), (3, [1, 1, 1]), (4, [4]), (12, [5, 5, 2]), (0, [])])
def test_plan(spark, count, sizes):
    topics = spark.createDataFrame([("t", count)], "topic string, count bigint")
    got = I.plan_requests(topics).orderBy("batch_number").collect()
    assert [(r.batch_number, r.batch_size) for r in got] == list(enumerate(sizes, 1))


def test_large_plan(spark):
    topics = spark.createDataFrame([("t", 123_456)], "topic string, count bigint")
    got = I.plan_requests(topics).agg(F.count("*"), F.sum("batch_size"), F.max("batch_number")).first()
    assert tuple(got) == (24692, 123_456, 24692)


def test_prompts(spark):
    df = spark.createDataFrame([("q{x}", None, [1])], "a string, b string, c array<int>")
    system, user = P.augment_prompts(dict(df.dtypes), "b", "fill {it}", ("a", "c", "zz"), "zh-tw")
    row = df.select(system.alias("s"), user.alias("u")).first()
    assert "fill {it}" in row.s and "影片" in row.s and '"b"' in row.s
    assert "a: q{x}\nc: [1]" in row.u and P.EMPTY_VALUE in row.u
    _, user = P.augment_prompts(dict(df.dtypes), "a", "x")
    assert P.NO_CONTEXT in df.select(user).first()[0]
    for kind in ("sft", "pretrain", "sft_conv", "dpo"):
        text = df.select(P.chunk_prompt(F.col("a"), kind, 4)).first()[0]
        assert "q{x}" in text and " 4 " in text
    by_row = spark.createDataFrame([("en",), ("zh-tw",), ("xx",)], "l string")
    got = [r[0] for r in by_row.select(P.chunk_system_prompt(F.col("l"))).collect()]
    assert got[0] == got[2] != got[1]
    assert spark.range(1).select(P.apply_lexicon(F.lit("這個軟件的質量"))).first()[0] == "這個軟體的品質"


def test_augment(spark):
    df = spark.createDataFrame([(1, "good", "x"), (2, "bad", "y")], "id int, text string, label string")
    out = {r.id: r for r in jobs.augment(df, "label", "copy", ECHO, ("text",)).collect()}
    assert out[2].label == "y" and out[2].error and out[1].label.startswith("ROW:") and not out[1].error
    new = jobs.augment(df, "extra", "copy", ECHO, ("text",), create_new_field=True).orderBy("id").collect()
    assert new[1].extra is None and new[0].extra
    with pytest.raises(ValueError, match="Available fields: id, label, text"):
        jobs.augment(df, "nope", "copy", ECHO)
    seen = jobs.augment_preview(df, ("id",), "label", "copy", ECHO, 1, context_fields=("text",)).collect()
    assert len(seen) == 1 and seen[0].original.label == "x" and seen[0].augmented.label.startswith("ROW:")


def chat(kind="sft"):
    def load():
        def call(systems, users):
            return [json.dumps([{"instruction": "i", "input": u[:20], "output": w} for w in ("軟體", "軟件", "ok")]) for u in users]

        return call

    return I.BatchModel(load, name="chat-1")


def test_generate(spark):
    out = jobs.generate(spark, "tea", 7, chat(), batch_size=3).collect()
    assert [(r.batch_number, r.entry_index) for r in out] == [
        (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)]
    out = jobs.generate(spark, "tea", 6, chat(), locale="zh-tw", batch_size=3).collect()
    assert len(out) == 6 and all(r.output != "軟件" for r in out)


def test_quality(spark):
    rows = [("a", "軟件", "b"), ("a", " ", "軟體"), ("x", None, "y")]
    df = spark.createDataFrame(rows, "instruction string, input string, output string")
    got = Q.with_quality(df, "sft").collect()
    assert [r.failed_fields for r in got] == [["input"], [], []]
    assert [len(r.qc_fields) for r in got] == [3, 2, 2]
    stats = Q.quality_stats(Q.with_quality(df, "sft")).first()
    assert (stats.total_checked, stats.passed, stats.failed, stats.discarded) == (3, 2, 1, 1)
    assert stats.pass_rate == pytest.approx(200 / 3)
    assert stats.estimated_pass_rate == pytest.approx((0.7 * 2 / 3 + 0.3 * 0.7) * 100)
    assert Q.quality_filter(df, "sft", "en").count() == 3
    assert Q.quality_filter(df, "sft", "zh-tw").count() == 2
    assert Q.quality_filter(df, "sft", "zh-tw", enabled=False).count() == 3
    assert Q.with_quality(df, "sft", Q.Quality(scorer=None)).filter("qc_passed").count() == 3

    def load():
        return lambda texts: [Q.accepted_probability((0.0, 3.0 if "軟件" not in t else -3.0)) for t in texts]

    scored = Q.with_quality(df, "sft", Q.Quality(Q.BatchScorer(load)))
    assert [r.failed_fields for r in scored.collect()] == [["input"], [], []]
    conv = spark.createDataFrame([([("user", ""), ("assistant", "數據")],)], "conversations array<struct<role:string,content:string>>")
    assert Q.with_quality(conv, "sft_conv").first().failed_fields == ["conversations[1].content"]


def test_windows(spark):
    words = " ".join(f"w{i}" for i in range(900))
    df = spark.createDataFrame([(words,), ("a  b",), ("",)], "t string")
    got = [r[0] for r in df.select(Q.text_windows(F.col("t"))).collect()]
    assert [len(g) for g in got] == [4, 1, 1] and got[1] == ["a  b"]
    assert [w.split()[0] for w in got[0]] == ["w0", "w254", "w508", "w762"]
    assert got[0][-1].split()[-1] == "w899"


def test_limits(spark, tmp_path):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), "id").repartition(5)
    for n in (1, 5, 500, 1000, 100_000, 100_001):
        got = [r.k for r in L.first_rows(df, ("k",), n).orderBy("k").collect()]
        assert got == list(range(min(n, 1000)))
    df.write.parquet(str(tmp_path / "t"))
    assert L.head_rows(spark.read.parquet(str(tmp_path / "t")), 123).count() == 123


def test_funnel():
    assert [Q.request_count(100, r) for r in (0.7, 1.0, 0.5, 0.01)] == [143, 120, 200, 300]
    assert Q.update_pass_rate(5, 10, 0.7) == pytest.approx(0.56)
    assert Q.update_pass_rate(0, 0, 0.7) == 0.7


@pytest.fixture
def docs(tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(3):
        (root / f"{i}.txt").write_text("para one\n\npara two " * 30)
    (root / "empty.txt").write_text(" \n")
    (root / "broken.json").write_text("{")
    return root


def test_documents(spark, docs, tmp_path):
    job = jobs.DocumentJob(chunks=ChunkConfig(200, 20))
    files, answered, entries = jobs.documents_to_dataset(
        spark, str(docs), chat(), job, staging=str(tmp_path / "staging"))
    results = R.file_results(files, answered, entries)
    by_name = {r.source_path.rsplit("/", 1)[1]: r for r in results.collect()}
    assert by_name["empty.txt"].errors == [R.NO_CONTENT] and not by_name["empty.txt"].success
    assert by_name["broken.json"].errors == ["Invalid JSON"]
    assert by_name["0.txt"].entries_generated == 3 * by_name["0.txt"].chunks_processed > 0
    total = R.batch_summary(results).first()
    assert (total.total_files, total.successful_files, total.failed_files) == (5, 3, 2)
    assert total.total_entries == entries.count() and total.success_rate == 60.0
    write_dataset(entries, str(tmp_path / "out.jsonl"), order=("source_path", "chunk_index", "entry_index"))


def test_paged_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.txt").write_text("text")

    def pages_of(data):
        for i, part in enumerate(data.decode().split("|"), 1):
            yield i, part, None

    files, answered, _ = jobs.documents_to_dataset(spark, str(tmp_path), chat(), pages_of=pages_of)
    assert sorted(r.content for r in answered.select("content").collect()) == ["one\n\ntwo", "text"]
    assert files.filter("error is not null").count() == 0
    files, answered, _ = jobs.documents_to_dataset(spark, str(tmp_path), chat())
    assert [r.error for r in files.orderBy("source_path").collect()] == [
        "Paged document: needs a page extractor", None]


def test_file_errors(spark):
    files = spark.createDataFrame([("a",), ("b",)], "source_path string")
    chunks = spark.createDataFrame(
        [("a", i, None if i % 2 else f"e{i}") for i in range(20)] + [("b", 0, None)],
        "source_path string, chunk_index int, error string")
    entries = spark.createDataFrame([("b",)], "source_path string")
    got = {r.source_path: r for r in R.file_results(files, chunks, entries).collect()}
    assert got["a"].errors == [f"e{i}" for i in range(0, 20, 2)] and got["a"].error_count == 10
    assert not got["a"].success and got["b"].success and got["b"].errors == []


def test_summary(spark):
    df = spark.range(3)
    assert tuple(R.generation_summary(df, 4).first()) == (3, 4, 75.0)
    assert tuple(R.generation_summary(df.limit(0), 0).first()) == (0, 0, 0.0)


def test_stream(spark, docs, tmp_path):
    job = jobs.DocumentJob(chunks=ChunkConfig(200, 20))

    def run():
        chunks = stream.stream_chunks(spark, str(docs), job, max_files=1)
        stream.append_parquet(stream.stream_entries(chunks, chat(), job), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "o")).groupBy("source_path").count().collect()

    first = run()
    assert len(first) == 3
    (docs / "new.md").write_text("# New\n\ntext")
    second = run()
    assert len(second) == 4 and {r["count"] for r in first} <= {r["count"] for r in second}


def test_stream_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\nbad\n')
    seen = []
    listener = stream.ProgressListener(lambda rows, batch: seen.append(rows))
    spark.streams.addListener(listener)
    rows = stream.stream_jsonl(spark, str(tmp_path / "in")).select(F.to_json("value").alias("v"), "error")
    stream.append_dataset(rows, str(tmp_path / "o"), "jsonl", str(tmp_path / "c")).awaitTermination()
    got = spark.read.json(str(tmp_path / "o"))
    assert got.count() == 2 and got.filter("error = 'Invalid JSON'").count() == 1
    spark.streams.removeListener(listener)


def test_input_is_evaluated_once(spark, tmp_path):
    log = tmp_path / "seen"
    log.mkdir()

    @F.udf("string")
    def seen(i):
        with open(f"{log}/{i}", "a") as f:
            f.write("x")
        return f"prompt {i}"

    rows = spark.range(30).select("id", F.lit("s").alias("system_prompt"), seen("id").alias("user_prompt"))
    out = I.infer_staged(rows, ECHO, str(tmp_path / "s"), ("id",), waves=5)
    assert out.count() == 30 and out.filter("raw_content is null").count() == 0
    assert {len(p.read_text()) for p in log.iterdir()} == {1}


def test_replies_belong_to_a_model(spark, tmp_path):
    def says(name):
        return I.ColumnModel(reply=lambda s, u: F.lit(name), name=name)

    rows = spark.range(4).select("id", F.lit("s").alias("system_prompt"), F.lit("u").alias("user_prompt"))
    for name in ("one", "two"):
        got = I.infer_staged(rows, says(name), str(tmp_path / "s"), ("id",))
        assert {r.raw_content for r in got.collect()} == {name}
    with pytest.raises(ValueError):
        I.infer_staged(rows, I.ColumnModel(reply=lambda s, u: u), str(tmp_path / "s"), ("id",))


def test_scorer_errors_pass(spark):
    def load():
        def call(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("no score")
            return [0.1 if "low" in t else 0.9 for t in texts]

        return call

    rows = spark.createDataFrame([(1, "good"), (2, "low"), (3, "boom")], "id long, text string")
    quality = Q.Quality(scorer=Q.BatchScorer(load, batch_size=2))
    got = Q.with_quality(rows, "pretrain", quality).collect()
    assert {r.id: r.qc_passed for r in got} == {1: True, 2: False, 3: True}


def test_dotted_names(spark):
    rows = spark.createDataFrame([("en", "t")], "`meta.lang` string, text string")
    out = jobs.augment(rows, "text", "say it", context_fields=("meta.lang",), model=I.ColumnModel(reply=lambda s, u: u, name="m"))
    assert "meta.lang: en" in out.first().text
    from tunekit.operators.fields import profile

    assert profile(rows, ("meta.lang",)).first().fields == ["meta.lang", "text"]


def test_schema_and_progress(spark, tmp_path):
    from tunekit.operators.entries import output_schema

    schema, seen = output_schema("sft"), []

    def load():
        return lambda systems, users, form: [form] * len(users)

    model = I.BatchModel(load, name="formed-1", output_schema=schema)
    out = I.infer_staged(prompts(spark, 12), model, str(tmp_path / "s"), ("id",), waves=3, report=lambda *x: seen.append(x))
    assert {r.raw_content for r in out.collect()} == {schema}
    assert [w for w, _, _ in seen] == [0, 1, 2] and sum(n for _, n, _ in seen) == 12 and sum(f for _, _, f in seen) == 0


@pytest.mark.parametrize("fmt,named", [("jsonl", True), ("csv", True), ("json", False), ("parquet", False)])
def test_streams_share_a_target(spark, tmp_path, fmt, named):
    schema = "s string, id long"
    for s in "ab":
        spark.range(40).selectExpr(f"'{s}' AS s", "id").repartition(4).write.parquet(str(tmp_path / s))

    def run(s):
        rows = stream.stream_table(spark, str(tmp_path / s), schema, max_files=2)
        stream.append_dataset(rows, str(tmp_path / "out"), fmt, str(tmp_path / f"state-{s}"), stream_id=s if named else None).awaitTermination()

    def rows():
        return sorted((r.s, int(r.id)) for r in stream.read_appended(spark, str(tmp_path / "out"), fmt).collect())

    want = [(s, i) for s in "ab" for i in range(40)]
    assert rows() == []
    for s in "aba":
        run(s)
    assert rows() == want and stream.appended_batches(spark, str(tmp_path / "out")).count() == 4
    # A batch that the checkpoint doesn't have comes again: the ledger has it, or not.
    for forget in (False, True):
        for name in ("1", ".1.crc"):
            (tmp_path / "state-b" / "commits" / name).unlink(missing_ok=True)
        if forget:
            for f in (tmp_path / "out" / "_ledger" / "stream=b" / "batch=1").glob("*"):
                f.unlink()
            assert not named or len(rows()) < 80
        run("b")
        assert rows() == want


def test_streams_by_name(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    rows = stream.stream_table(spark, str(tmp_path / "in"), "id long")
    stream.append_dataset(rows, str(tmp_path / "out"), "jsonl", str(tmp_path / "c"), stream_id="ids-1").awaitTermination()
    done = stream.appended_batches(spark, str(tmp_path / "out")).collect()
    assert [(r.stream, r.batch, r.rows, r.failed) for r in done] == [("ids-1", 0, 5, 0)] and done[0].rate > 0
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text('{"a":1}\nbad\n')
    lines = stream.stream_jsonl(spark, str(tmp_path / "lines")).select(F.to_json("value").alias("v"), "error")
    stream.append_dataset(lines, str(tmp_path / "out"), "jsonl", str(tmp_path / "c2"), stream_id="lines").awaitTermination()
    assert [(r.rows, r.failed) for r in stream.appended_batches(spark, str(tmp_path / "out")).where("stream = 'lines'").collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        stream.append_dataset(rows, "x", "jsonl", "y", stream_id="a/b")
    with pytest.raises(ValueError):
        stream.append_dataset(rows, "x", "jsonl", "y", max_entries=0)


def test_a_stream_stops_at_its_row_cap(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def add(name, text):
        (tmp_path / "in" / name).write_text(text)

    def run(cap):
        rows = stream.stream_jsonl(spark, str(tmp_path / "in"), max_files=1)
        stop = F.when(F.col("error").isNotNull(), F.raise_error(F.lit("opened"))).otherwise(F.to_json("value"))
        stream.append_dataset(rows.select(stop.alias("v")), str(tmp_path / "out"), "jsonl", str(tmp_path / "c"), max_entries=cap).awaitTermination()
        return [r.rows for r in stream.appended_batches(spark, str(tmp_path / "out")).orderBy("batch").collect()]

    for i in range(3):
        add(f"{i}.jsonl", "".join(f'{{"n":{10 * i + k}}}\n' for k in range(10)))
    assert run(25) == [10, 10, 5]
    add("bad.jsonl", "no json\n")  # would fail if it were opened
    assert run(25) == [10, 10, 5]
    assert stream.read_appended(spark, str(tmp_path / "out"), "jsonl").distinct().count() == 25


def counted_chat(log, replies):
    """A model that notes every call; ``replies`` gives the outputs of a request by how many went before."""

    def load():
        def call(systems, users):
            out = []
            for u in users:
                n = len(list(log.iterdir()))
                (log / f"{n}-{abs(hash(u)) % 10**9}").write_text(u)
                found = replies(u)
                if isinstance(found, Exception):
                    raise found
                out.append(json.dumps([{"instruction": "i", "input": u[:20], "output": w} for w in found]))
            return out

        return call

    return I.BatchModel(load, name="counted-1", concurrency=1)


def test_generate_tops_up(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rates, progress = str(tmp_path / "rates"), str(tmp_path / "progress")
    model = counted_chat(log, lambda u: ["軟體", "軟件", "軟件", "軟件", "軟件"])  # one of five passes
    out = jobs.generate(spark, "tea", 20, model, locale="zh-tw", rates=rates, progress=progress, partitions=1).collect()
    assert len(out) == 20 and all(r.output == "軟體" for r in out)
    assert [(r.batch_number, r.entry_index) for r in out] == [(i, 0) for i in range(1, 21)]
    waves_ = W.progress_of(spark, progress).orderBy("wave").collect()
    assert sum(r.sent for r in waves_) == len(list(log.iterdir())) and len(waves_) > 2
    assert sum(r.passed for r in waves_[:-1]) < 20 <= sum(r.passed for r in waves_) and all(r.rate > 0 for r in waves_)
    rate = W.stored_pass_rate(spark, rates, "counted-1", "sft", "zh-tw", 0.7)
    assert 0.2 <= rate < 0.35 and W.stored_pass_rate(spark, rates, "other", "sft", "zh-tw", 0.7) == 0.7
    first = waves_[0].sent
    jobs.generate(spark, "tea", 20, model, locale="zh-tw", rates=rates, progress=progress, partitions=1)
    later = W.progress_of(spark, progress).orderBy("at").collect()[len(waves_)]
    assert later.wave == 0 and later.sent > first  # starts from the stored rate


def test_generate_gives_up_on_a_model_without_entries(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    assert jobs.generate(spark, "tea", 4, counted_chat(log, lambda u: []), partitions=1).collect() == []
    assert len(list(log.iterdir())) == 2  # two rounds of one request
    some = counted_chat(log, lambda u: ValueError("odd") if "2" in u.split("batch")[-1][:3] else ["a"])
    assert 0 < jobs.generate(spark, "tea", 4, some, max_rounds=3, partitions=1).count() <= 4


def test_first_passing_stops_early(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.range(400).select("id", F.lit("s").alias("system_prompt"), F.concat(F.lit("p "), "id").alias("user_prompt"))
    model = counted_chat(log, lambda u: ["x"])

    def scored_of(answered):
        return answered.select("id", "raw_content", (F.col("id") % 3 == 0).alias("qc_passed"))

    out = jobs.first_passing(rows, "id", 20, model, scored_of, partitions=1).collect()
    assert [r.id for r in out] == list(range(0, 60, 3))
    assert 58 <= len(list(log.iterdir())) < 120
    short = jobs.first_passing(rows.limit(10), "id", 20, I.ColumnModel(lambda s, u: u), scored_of).collect()
    assert [r.id for r in short] == [0, 3, 6, 9]


def test_a_fatal_failure_ends_the_job(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    broken = counted_chat(log, lambda u: RuntimeError("model 'x' not found") if "5" in u else RuntimeError("context length exceeded") if "7" in u else ["a"])
    run = dict(staging=str(tmp_path / "s"), key_cols=("id",), waves=4, partitions=1, budget=I.FailureBudget())
    with pytest.raises(I.ModelStopped) as end:
        I.infer_staged(prompts(spark, 80), broken, **run)
    assert (end.value.kind, end.value.wave) == ("model_not_found", 0) and "not found" in str(end.value)
    calls = [p.read_text() for p in log.iterdir()]
    assert sum("5" in c for c in calls) == 1  # nothing was sent after it
    staged = spark.read.parquet(str(tmp_path / "s"))
    assert staged.filter("error LIKE 'Not sent after: %'").count() > 0 and staged.count() < 80
    fixed = counted_chat(log, lambda u: RuntimeError("context length exceeded") if "7" in u else ["a"])
    done = I.infer_staged(prompts(spark, 80), fixed, **run)
    failed = {r.id for r in done.filter("error IS NOT NULL").collect()}
    assert failed == {i for i in range(80) if "7" in prompt_of(spark, i)}
    good = sum("5" not in c and "7" not in c for c in calls)
    assert len(list(log.iterdir())) == len(calls) + 80 - good


def prompt_of(spark, i):
    return {r.id: r.user_prompt for r in prompts(spark, 80).collect()}[i]


def test_a_share_of_failures_ends_the_job(spark, tmp_path):
    model = I.ColumnModel(lambda s, u: u, lambda s, u: F.when(F.length(u) > 4, "odd"), name="odd-1")
    rows = spark.range(60).select("id", F.lit("s").alias("system_prompt"), F.concat(F.lit("p"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int"))).alias("user_prompt"))
    for share, ends in ((0.9, False), (0.3, True)):
        run = dict(staging=str(tmp_path / f"s{share}"), key_cols=("id",), budget=I.FailureBudget(share=share, least=10))
        if ends:
            with pytest.raises(I.ModelStopped, match="requests failed: odd"):
                I.infer_staged(rows, model, **run)
        else:
            assert I.infer_staged(rows, model, **run).count() == 60
    with pytest.raises(ValueError):
        I.FailureBudget(share=1.0)


def test_error_classes_of_messages():
    for message, kind in (("Model 'x' NOT found", "model_not_found"), ("refused", "connection"), ("odd", "other"), ("context length exceeded", "context_length_exceeded")):
        assert I.class_of_error(message) == kind
