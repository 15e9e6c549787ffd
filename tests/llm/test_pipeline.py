"""The pipeline and the registered queries of the package on the smallest tables."""

import pytest
from pyspark.sql import functions as F
from test_similarity import brute_bytes, brute_join, brute_leaks, brute_lines

import corpus_pipeline
from tunekit.llm import langid, unigram
from tunekit.llm.oracle import SQL
from tunekit.llm.queries import REGISTRY
from tunekit.llm.vocabulary import read_pieces
from tunekit_checks.compare import connect, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return {r.doc_id: r for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, name):
    df = REGISTRY[name](spark, SF)
    result = connect(SF).execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in REGISTRY} == set(range(1, 14))


def test_join_query(spark, rows):
    got = REGISTRY["op7_ngram_jaccard_join"](spark, SF).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_join([(i, r.text) for i, r in rows.items()])


def test_byte_query(spark, rows):
    got = REGISTRY["op8_suffix_array_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes([(i, r.text) for i, r in rows.items()])


def test_leak_query(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = REGISTRY["op1_decontamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks([(i, r.text) for i, r in rows.items()], items)


def test_language_query(spark, rows):
    got = REGISTRY["op9_language_id"](spark, SF).collect()
    held = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out]
    assert len(got) == len(rows) and sum(held) >= 0.97 * len(held)


def test_other_queries(spark, rows):
    coded = REGISTRY["op4_sentencepiece"](spark, SF).collect()
    assert len(coded) == len(rows) and all(r.round_trip and r.n_pieces == len(r.ids) for r in coded)
    counts = REGISTRY["op2_token_counts"](spark, SF)
    assert counts.count() == len(rows) and counts.where("n_tokens >= n_words").count() == len(rows)
    assert REGISTRY["op3_secret_scan"](spark, SF).columns == ["doc_id", "word", "value_sha256", "length", "probability", "is_secret"]


def test_pipeline(spark, rows):
    known = {i: r.text for i, r in rows.items()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    langs = langid.identify(docs, model).collect()
    kept = {r.doc_id: known[r.doc_id] for r in langs if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    cut = brute_lines(list(kept.items()), 3)
    kept = {i: t for i, t in cut.items() if t or not kept[i]}
    kept = {i: kept[i] for i, _, group in brute_join(list(kept.items())) if group == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in brute_leaks(list(kept.items()), items)}
    encoder = unigram.Encoder(unigram.build(read_pieces()))
    want = {i: (t, encoder.encode(t).tolist()) for i, t in kept.items() if i not in leaks}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, r.ids) for r in got} == want
    assert all(r.round_trip and r.n_chars == len(r.text) and r.lang == rows[r.doc_id].lang for r in got)


def test_pipeline_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "some words that have letters", "en", None, 3), (1, None, None, "a", None), (1, "", "en", "a", 0), (2, "12 34", "en", "a", 5), (3, "some words that have letters", "en", "b", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs_in in (docs, docs.limit(0)):
        out = docs_in
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, out, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} == ({None, 3} if docs_in is docs else set())


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["a.b", "__lang", "__score", "__runs", "ids", "Decoded", "n_pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names))
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns[5:] == names
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names[:4])
    assert list(rows[0].__fields__).count("ids") == 1 and all(len(r.ids) == r.n_pieces for r in rows)
