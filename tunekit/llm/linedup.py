"""Line deduplication by a suffix array over line identifiers, in DataFrame functions only.

Each document is a sequence of line identifiers (64-bit hashes of the exact lines). Suffixes are sorted
by prefix doubling: the rank of a suffix by its first h lines, together with the rank of the suffix h
lines later, gives its rank by 2h lines. A round groups the pairs of ranks, drops suffixes that are
alone (nothing repeats there), and numbers the groups in order: pairs are range-partitioned and sorted,
and Spark's partition number and row number make a rank that keeps the order. Doubling ends at
``min_lines``, for two suffixes next to each other in that array have a longest common prefix of
``min_lines`` or more exactly when they have the same rank: each rank is one interval of the array.

In an interval every suffix but the first by (doc_id, line) begins a later copy of ``min_lines`` lines.
Windows of one document that overlap or touch are joined to maximal runs, and their lines are deleted.
Sequences never run over the end of a document.

A null text is an empty text, which has one empty line. Rows with a null ``doc_id`` keep all lines and
are no copies' origin. Rows that share a ``doc_id`` count as one document given more than once: equal
places aren't later copies, and what goes from one goes from the others at the same line numbers.
Other columns are kept as they are, whatever their names; one named like the result is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunekit.llm.spark_tools import fresh, partitions, stage, without

MIN_LINES = 3


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def _ranked(suffixes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Suffixes (doc_id, pos) that aren't alone, with the rank of their keys in order."""
    groups = suffixes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    ranks = stage(
        groups.repartitionByRange(partitions(suffixes.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks"
    )
    return stage(suffixes.join(ranks, keys).select("doc_id", "pos", "rank"), name)


def repeated_suffixes(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, pos, rank) of every suffix whose first min_lines lines occur at another place too."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(_lines()).alias("pos", "line"))
    lines = lines.select("doc_id", "pos", F.xxhash64("line").alias("line"))
    ranked, h = _ranked(lines, ["line"], "lines-1"), 1
    while h < min_lines:
        step = min(h, min_lines - h)
        # The suffix step lines later in the document, if it is still there.
        places = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(step, step)
        pairs = ranked.withColumn("later", F.max("rank").over(places)).where("later IS NOT NULL")
        h += step
        ranked = _ranked(pairs.withColumnRenamed("rank", "here"), ["here", "later"], f"lines-{h}")
    return ranked


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per document with later copies: ``runs``, its maximal runs as structs of first and end line (from 0)."""
    ranked = repeated_suffixes(docs, min_lines)
    place = F.struct("doc_id", "pos")
    origin = ranked.groupBy("rank").agg(F.min(place).alias("origin"))
    later = ranked.join(origin, "rank").where(place != F.col("origin")).select("doc_id", "pos").distinct()
    order = Window.partitionBy("doc_id").orderBy("pos")
    starts = later.withColumn("new", F.coalesce(F.col("pos") > F.lag("pos").over(order) + min_lines, F.lit(True)).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "run")
    runs = runs.agg(F.min("pos").alias("first"), (F.max("pos") + min_lines).alias("end"))
    return stage(runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs")), "lines-runs")


def without_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, runs: str = "removed_runs") -> DataFrame:
    """The rows with later copies of repeated runs deleted from ``text``; a new last column has the deleted runs."""
    docs = without(docs, runs).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    doc, lines = fresh(docs, "__doc"), fresh(docs, "__lines")
    found = repeated_runs(docs.select("doc_id", "text"), min_lines).select(F.col("doc_id").alias(doc), F.col("runs").alias(runs))
    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"] == F.col(doc), "left").drop(doc).withColumn(lines, F.size(_lines()))
    kept = F.filter(_lines(), lambda _, i: ~F.exists(F.col(runs), lambda r: (i >= r["first"]) & (i < r["end"])))
    inside = F.filter(F.transform(F.col(runs), lambda r: F.struct(r["first"].alias("first"), F.least(r["end"], F.col(lines)).alias("end"))), lambda r: r["first"] < r["end"])
    text = F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    empty = F.array().cast("array<struct<first:int,end:int>>")
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.coalesce(inside, empty).alias(runs))
