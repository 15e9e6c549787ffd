"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunekit.llm import bpe, langid, secrets, unigram, vectorcodes
from tunekit.llm.bytededup import without_repeats
from tunekit.llm.decontaminate import contaminated
from tunekit.llm.linedup import without_repeated_lines
from tunekit.llm.manifest import leaf_digest, manifest
from tunekit.llm.merkle import fingerprints
from tunekit.llm.parityjoin import similar_documents
from tunekit.llm.unitdedup import without_repeated_units
from tunekit.llm.vocabulary import read_pieces
from tunekit.llm.wordpiece import count_tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), read_pieces()).select("doc_id", "tokens.*")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its verdict; values are given as digests only."""
    pieces = read_pieces()
    words = [w.strip("▁") for w in pieces.pieces if w.strip("▁").isalpha() and len(w) > 3]
    found = secrets.scan(_documents(spark, sf_dir), spark.createDataFrame([(w,) for w in words], "word string"))
    digest = F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256")
    return found.select("doc_id", "word", digest, F.col("length").cast("int").alias("length"), F.round("probability", 6).alias("probability"), "is_secret")


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, how many, and whether decoding gives the text back."""
    coded = unigram.encode(_documents(spark, sf_dir).select("doc_id", "text"), unigram.build(read_pieces()))
    return coded.select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), F.expr("decoded <=> text").alias("round_trip")
    )


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = without_repeated_lines(_documents(spark, sf_dir).select("doc_id", "text", lines.alias("n_lines")))
    removed = F.aggregate("removed_runs", F.lit(0), lambda n, r: n + r["end"] - r["first"])
    return kept.select(
        "doc_id",
        "n_lines",
        removed.alias("n_removed_lines"),
        F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["first"], r["end"])), " ").alias("removed_runs"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_units(_documents(spark, sf_dir).select("doc_id", "text", F.char_length("text").alias("n_chars")))
    return kept.select(
        "doc_id",
        F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
        F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, u: n + u["end"] - u["start"]).alias("n_removed"),
        F.array_join(F.transform("removed_spans", lambda u: F.concat_ws("-", u["start"], u["end"])), " ").alias("removed_spans"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_documents(spark, sf_dir))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_documents(spark, sf_dir)).drop("kept")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out).select("text", "lang"))
    rows = docs.select("doc_id", "text", out.alias("held_out"))
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof; a fifth of them are checked with their texts in lower case."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(tampered, leaf_digest(*fields, F.translate("text", upper, lower)))
    made = manifest(_documents(spark, sf_dir), "source", "doc_id", leaf_digest(*fields, F.col("text")), claim)
    return made.rows.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.books_sha256(books)).alias("codebooks_sha256"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination,
    "op2_token_counts": token_counts,
    "op3_secret_scan": secret_scan,
    "op4_sentencepiece": sentencepiece,
    "op5_line_dedup": line_dedup,
    "op6_line_hash_dedup": line_hash_dedup,
    "op7_ngram_jaccard_join": ngram_jaccard_join,
    "op8_suffix_array_dedup": suffix_array_dedup,
    "op9_language_id": language_id,
    "op10_merkle_fingerprints": merkle_fingerprints,
    "op11_byte_bpe": byte_bpe,
    "op12_merkle_manifest": merkle_manifest,
    "op13_vector_codes": vector_codes,
}
