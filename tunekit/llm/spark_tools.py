"""Staged tables, bounded membership filters and connected components as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tunekit.functions.arrays import quoted
from tunekit.sources.shared import bounded_batches, work_dir


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run in here leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it again: later steps start from files, not from lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """The rows without columns of some names in any case, whatever other names (dots and all) there are."""
    gone = {n.lower() for n in names}
    kept = [quoted(c) for c in docs.columns if c.lower() not in gone]
    return docs if len(kept) == len(docs.columns) else docs.select(*kept)


def fresh(docs: DataFrame, name: str) -> str:
    """A name like the given one that no column has in any case."""
    used = {c.lower() for c in docs.columns}
    while name.lower() in used:
        name += "_"
    return name


def map_rows(docs: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType) -> DataFrame:
    """``mapInArrow`` for rows with any column names: it can't name a column with a dot, so inside they are numbered."""
    numbered = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, numbered).toDF(*schema.names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


FILTER_BITS = 1 << 24


def _slots(hashed: str, probes: int) -> list:
    return [F.pmod(F.xxhash64(F.col(hashed), F.lit(i)), F.lit(FILTER_BITS)) for i in range(probes)]


def membership(df: DataFrame, column: str, probes: int = 2) -> np.ndarray:
    """A Bloom filter of a bigint column, 2 MB whatever the number of rows; it never denies a member.

    Rows are folded into 64-bit words by a grouping with at most FILTER_BITS / 64 groups, so what
    reaches the driver is bounded too.
    """
    return fold_slots(df, _slots(column, probes))


def fold_slots(df: DataFrame, slots: list) -> np.ndarray:
    """A bit for every slot number (below FILTER_BITS) that some row has, as 64-bit words."""
    with shuffles_freed(df.sparkSession):
        words = (
            df.select(F.explode(F.array(*slots)).alias("slot"))
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))
            .toPandas()
        )
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out


def maybe_member(df: DataFrame, column: str, bits: np.ndarray, probes: int = 2, member: bool = True) -> DataFrame:
    """The rows whose bigint column may be in the filter, or all others (nulls too); the filter travels as a broadcast of 2 MB."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf(BooleanType())
    def kept(first: pa.Array, *more: pa.Array) -> pa.Array:
        ok = np.ones(len(first), dtype=bool)
        for slot in (first, *more):
            s = slot.to_numpy(zero_copy_only=False).astype(np.int64)
            ok &= (shared.value[s >> 6] >> (s & 63)) & 1 == 1
        return pa.array(ok)

    found = F.col(column).isNotNull() & kept(*_slots(column, probes))
    return df.where(found if member else ~found)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the least id that can be reached.

    Alternates the large-star and small-star steps on DataFrames until every node points at one root
    that points nowhere. Every step is one grouped minimum and one join on the node, so a node with
    very many edges is pre-aggregated in the grouping and split by the adaptive join.
    """
    now = stage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        pointed = small.select("u", F.col("m").alias("v")).unionAll(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stage(pointed.where("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select("v", F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no u is a v."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1)))
    with shuffles_freed(edges.sparkSession):
        return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()
