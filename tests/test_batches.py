"""Python steps get batches that are bounded by bytes, and hand tokenizers bounded portions."""

import json

import pytest
from pyspark.sql import functions as F

from tunekit.functions import html as H
from tunekit.operators import quality as Q
from tunekit.sources import datasets as D
from tunekit.sources import writers as W
from tunekit.sources.shared import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.set(KEY, str(64 << 20))
    yield spark
    spark.conf.unset(KEY)


def bounded(spark) -> bool:
    return int(spark.conf.get(KEY)) <= BATCH_BYTES


def rows(spark):
    return spark.range(3).select(F.col("id").cast("string").alias("a"), F.lit('x\n"y').alias("b"))


def test_chain_of_formats(unbounded, tmp_path):
    steps = [f"{tmp_path}/{i}.{fmt}" for i, fmt in enumerate(["csv", "json", "tsv"])]
    W.write_dataset(rows(unbounded), steps[0])
    for source, target in zip(steps, steps[1:]):
        unbounded.conf.set(KEY, str(64 << 20))
        W.convert(unbounded, source, target)
        assert bounded(unbounded)
    found = D.read_dataset(unbounded, steps[-1])
    assert sorted(map(tuple, found.collect())) == [(str(i), 'x\n"y') for i in range(3)]


def test_json_arrays_of_several_batches(unbounded, tmp_path):
    unbounded.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        W.write_json(unbounded.range(7).coalesce(1), f"{tmp_path}/a.json")
    finally:
        unbounded.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = "\n".join(r[0] for r in unbounded.read.text(f"{tmp_path}/a.json").collect())
    assert [x["id"] for x in json.loads(text)] == list(range(7))
    assert bounded(unbounded)


def test_entities_and_one_array(unbounded, tmp_path):
    H.unescape(F.col("x"))
    assert bounded(unbounded)
    unbounded.conf.set(KEY, str(64 << 20))
    W.write_dataset(rows(unbounded), f"{tmp_path}/a.json", one_array=True)
    assert bounded(unbounded)
    parts = unbounded.read.text(f"{tmp_path}/a.json", wholetext=True).select("value", "_metadata.file_path").orderBy("file_path")
    assert [x["a"] for x in json.loads("".join(r[0] for r in parts.collect()))] == ["0", "1", "2"]


def test_tokenizer_gets_portions(unbounded):
    limit = Q.CALL_CHARS

    def load():
        def call(texts):
            if len(texts) > 1 and (len(texts) > 3 or sum(map(len, texts)) > limit):
                raise RuntimeError("too much at once")
            return [[(i, i + 1) for i in range(len(t))] for t in texts]

        return call

    texts = ["ab"] * 4 + ["x" * (limit - 1), "yz", "w" * (limit + 5), ""] + ["cd"]
    df = unbounded.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    found = df.select("i", Q.text_windows(F.col("t"), Q.BatchTokenizer(load, batch_size=3), limit, 0).alias("w")).orderBy("i").collect()
    assert [r["w"] for r in found] == [[t] if len(t) <= limit else [t[:limit], t[limit:]] for t in texts]
    assert bounded(unbounded)


def test_scorer_gets_bounded_batches(unbounded):
    df = unbounded.createDataFrame([("a", "b", "c"), ("a", None, "bad")], "instruction string, input string, output string")
    quality = Q.Quality(Q.BatchScorer(lambda: lambda texts: [0.0 if "bad" in t else 1.0 for t in texts]))
    assert [r["qc_passed"] for r in Q.with_quality(df, "sft", quality).collect()] == [True, False]
    assert bounded(unbounded)
