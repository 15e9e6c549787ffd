"""Document fingerprints: a Merkle tree over sections and paragraphs, in SQL functions only.

A text is cut into sections at blank lines and into paragraphs at line breaks; empty ones count, so the
tree keeps the text exactly. A paragraph's node is the SHA-256 of its bytes, a section's that of its
paragraphs' nodes, the root that of the sections' nodes; each text is hashed together with the number
of children by the separator between digests of fixed length. Equal roots mean equal texts; where roots
differ, only differing sections have to be opened, and in them only differing paragraphs, to find an
edit (``differing_branches``).

The likeness of two fingerprints is 1 for equal roots, else the Dice coefficient of their leaf sets: a
paragraph's leaves are its consecutive blocks of ``BLOCK`` characters, hashed to 64 bits, so a
paragraph that is edited at its end still shares its head.

A null text is an empty text: one section with one empty paragraph. Two empty leaf sets have likeness 1
only if the roots are equal, else 0. Everything here is a function of single rows but
``with_next``, which gives each row the text of the row that follows it by (doc_id, text), the last one
that of the first; rows with a null ``doc_id`` come first in that order. With a single row the next
text is its own. An empty table gives an empty result. Column names of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.llm.spark_tools import partitions

BLOCK = 32


def tree(text: Column) -> Column:
    """The sections of a text, each a struct of its node and its paragraphs' nodes."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), lambda p: F.sha2(p.cast("binary"), 256))

    return F.transform(F.transform(sections, section), lambda p: F.struct(F.sha2(F.array_join(p, ",").cast("binary"), 256).alias("node"), p.alias("paragraphs")))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections["node"], "|").cast("binary"), 256)


def leaves(text: Column) -> Column:
    """The distinct leaf hashes of a text."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\n]{{1,{BLOCK}}}"), F.lit(0))
    return F.array_distinct(F.transform(blocks, lambda b: F.xxhash64(b)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    total = F.size(leaves_a) + F.size(leaves_b)
    shared = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(root_a == root_b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total)


def differing_branches(a: Column, b: Column) -> Column:
    """(section, paragraph) numbers from 0 where two trees differ; a paragraph or section missing on one side differs."""
    n = F.greatest(F.size(a), F.size(b))
    empty = F.array().cast("array<string>")

    def of(tree_: Column, i: Column) -> Column:
        return F.coalesce(F.get(tree_["paragraphs"], i), empty)

    def paragraphs(i: Column) -> Column:
        x, y = of(a, i), of(b, i)
        every = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y), F.lit(1)) - 1)
        differ = F.filter(every, lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
        return F.transform(differ, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    changed = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(a["node"], i).eqNullSafe(F.get(b["node"], i)))
    return F.flatten(F.transform(changed, paragraphs))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds aren't above the id (-1 for a null), in two steps of a square root each."""
    if not bounds:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, round(len(bounds) ** 0.5))
    fine = F.lit(bounds)
    coarse = F.size(F.filter(F.lit(bounds[step - 1 :: step]), lambda b: b <= doc_id)) * step
    within = F.size(F.filter(F.slice(fine, coarse + 1, F.lit(step)), lambda b: b <= doc_id))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(coarse + within)


def with_next(docs: DataFrame, to: str = "next_text") -> DataFrame:
    """(doc_id, text) rows with the next row's text.

    Rows are dealt by ranges of doc_id, whose bounds are quantiles. The first id of each range also
    goes, marked as a guest, to the range before it (that of the first range to the last), so that no
    range looks into another; in a range the next row comes from a window. Texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 4 * partitions(docs.sparkSession)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    placed = docs.withColumn("range", _range_of(F.col("doc_id"), sorted(set(bounds))))
    firsts = sorted((r["range"], r["first"]) for r in placed.groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    before: dict[int, int] = {r: firsts[i - 1][0] for i, (r, _) in enumerate(firsts)}
    if not firsts:
        return docs.withColumn(to, F.col("text"))
    lowest, highest = firsts[0][0], firsts[-1][0]
    known = dict(firsts)
    slots = range(lowest, highest + 1)
    first = F.get(F.lit([known.get(r) if known.get(r) is not None else -(1 << 63) for r in slots]), F.col("range") - lowest)
    last = F.get(F.lit([before.get(r, lowest) for r in slots]), F.col("range") - lowest)
    leads = F.col("doc_id").isNull() | (F.col("doc_id") == first)
    targets = F.when(leads, F.array(own, F.struct(last.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", F.explode(targets).alias("to")).select("doc_id", "text", "to.range", "to.guest")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn(to, F.lead("text").over(order)).where("NOT guest").drop("range", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (its last quarter replaced by as much of the next text's head), and the fingerprints and likenesses of both and of the next."""
    rows = with_next(docs)
    n = F.char_length("text").cast("long")
    rows = rows.withColumn("n_chars", n).withColumn("m", (F.floor(F.col("n_chars") / 4)).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars AS int) - m)"), F.expr("substring(next_text, 1, m)")))
    names = {"text": "", "edited": "edited_", "next_text": "next_"}
    rows = rows.withColumns({f"{p}fingerprint": root(tree(F.col(c))) for c, p in names.items()} | {f"{p}leaves": leaves(F.col(c)) for c, p in names.items()})
    near = {
        f"near_{x}": likeness(F.col("fingerprint"), F.col("leaves"), F.col(f"{x}_fingerprint"), F.col(f"{x}_leaves")) for x in ("edited", "next")
    }
    return rows.withColumns(near).select("doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint", *near)
