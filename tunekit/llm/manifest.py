"""Merkle manifest of a dataset by time-forward processing: a tree a group, a tree over the groups, and proofs.

Rows are leaves. In each group (such as a source) they stand in order of a key; while a tree has several
nodes, every ``FAN`` consecutive ones become the SHA-256 of their digests, joined as hex text (the last
run may be shorter, even one node). What remains is the group's subroot; the subroots in order of their
groups give the root the same way.

**Forward sweep.** Nodes are labelled by (their last leaf, level), so that a node comes right after its
last descendant. A sweep takes leaves in that order and sends every digest, keyed by its parent's label,
to a priority queue; when the sweep has reached a label, the queue's head holds that node's children. The
queue is external: labels are dealt in blocks of ``FAN ** LEVELS`` leaves, Spark's shuffle sorts the
messages of a block on disk, and a task keeps only the head of the queue (at most ``FAN`` digests a
level) in memory. What a block's top node sends goes to the next sweep through a staged table of
1/256 the size, until every tree is one node.

**Reversed sweep.** From the tops down, labels are taken in descending order. A node gets the part of the
proof above it and delivers that, with its own run in front, to its children; in the end every leaf has
its proof: the siblings of its run, level by level, through the subroot to the root.

A group of any size is spread over its blocks, so a group with a third of all rows is no hot key. Rows
are placed by a range sort on (group, key, digest, claim), by counts of its partitions, and by offsets.

A null in a field is hashed as ``-``. A null group is a group of its own, before all others; null keys come
first in their group. Rows with equal keys stand in order of their digests, then of their claims; repeated rows are leaves of their
own. A lone leaf is its group's subroot, a lone subroot is the root. An empty table has no root and gives
an empty result. Columns of the input beyond the fields don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.functions.arrays import quoted
from tunekit.llm.spark_tools import bounded_batches, stage

FAN = 16
LEVELS = 2  # levels of a tree in one block
BLOCK = FAN**LEVELS


def digest_of(run: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in run)).digest()


def fold(leaf: bytes, slots: Sequence[int], siblings: Sequence[Sequence[bytes]]) -> bytes:
    """The root that a leaf's digest leads to: at each level it stands at its slot among its siblings."""
    for slot, others in zip(slots, siblings):
        leaf = digest_of([*others[:slot], leaf, *others[slot:]])
    return leaf


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of values, each as its UTF-8 byte count, a colon and itself, or ``-`` for a null."""
    texts = [f.cast("string") for f in fields]
    marked = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*marked).cast("binary"), 256))


# --- sweeps of one block -------------------------------------------------------------------------


def _last(index: int, level: int, n: int) -> int:
    """The last leaf under a node."""
    return min((index + 1) * FAN**level, n) - 1


def _height(n: int) -> int:
    """Levels above the leaves of a block of n; a block of a larger tree is full height."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def sweep_forward(leaves: Sequence[bytes], height: int) -> tuple[bytes, dict[tuple[int, int], list[bytes]]]:
    """The digest of a block's top node, and the run below each inner node by label (last leaf, level)."""
    n = len(leaves)
    queue: list[tuple[int, int, int, bytes]] = []  # parent's label, place among its children, digest
    runs = {}
    top = leaves[0]
    for i, leaf in enumerate(leaves):
        if height:
            heapq.heappush(queue, (_last(i // FAN, 1, n), 1, i, leaf))
        while queue and queue[0][0] == i:
            end, level = queue[0][:2]
            run = []
            while queue and queue[0][:2] == (end, level):
                run.append(heapq.heappop(queue)[3])
            runs[end, level] = run
            top = digest_of(run)
            if level < height:
                index = end // FAN**level
                heapq.heappush(queue, (_last(index // FAN, level + 1, n), level + 1, index, top))
    return top, runs


Path = tuple[tuple[int, list[bytes]], ...]  # (own place, run) of each level, upward


def sweep_backward(n: int, height: int, runs: dict[tuple[int, int], list[bytes]], above: Path) -> Iterator[tuple[int, Path]]:
    """(leaf, path) for the leaves of a block, last one first; ``above`` is the path of its top node."""
    queue: list[tuple[int, int, Path]] = [(-(n - 1), -height, above)]
    while queue:
        end, level, path = heapq.heappop(queue)
        end, level = -end, -level
        if level == 0:
            yield end, path
            continue
        run = runs[end, level]
        first = end // FAN**level * FAN
        for slot in range(len(run)):
            heapq.heappush(queue, (-_last(first + slot, level - 1, n), 1 - level, ((slot, run), *path)))


# --- sweeps of all blocks ------------------------------------------------------------------------

_NODE = "tree string, pos long, m long, digest binary"
_PATH = "tree string, pos long, slots array<int>, runs array<binary>, top binary"


def _grouped(batches, *names: str) -> Iterator[list[dict]]:
    """Consecutive rows that agree in some columns; a block is small, so its rows are."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, group in groupby(rows, key=lambda r: tuple(r[x] for x in names)):
        yield list(group)


def _blocked(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by block; each block's in order of its labels."""
    return df.withColumn("block", F.expr(f"pos div {BLOCK}")).repartition("tree", "block").sortWithinPartitions("tree", "block", *order, "pos")


def _upward(batches):
    for rows in _grouped(batches, "tree", "block"):
        m = rows[0]["m"]
        top, _ = sweep_forward([r["digest"] for r in rows], min(LEVELS, _height(m)))
        row = {"tree": rows[0]["tree"], "pos": rows[0]["block"], "m": -(-m // BLOCK), "digest": top}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("m", pa.int64()), ("digest", pa.binary())]))


def _split(data: bytes) -> list[bytes]:
    return [data[i : i + 32] for i in range(0, len(data), 32)]


def _paths_of(rows: list[dict]) -> Iterator[tuple[dict, Path, bytes]]:
    """(row, path, subroot) for the nodes of a block; its first row has the path of its top node."""
    above, nodes = rows[0], rows[1:]
    height = min(LEVELS, _height(nodes[0]["m"]))
    _, runs = sweep_forward([r["digest"] for r in nodes], height)
    start = tuple(zip(above["slots"], map(_split, above["runs"])))
    for at, path in sweep_backward(len(nodes), height, runs, start):
        yield nodes[at], path, above["top"]


def _downward(batches):
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("slots", pa.list_(pa.int32())), ("runs", pa.list_(pa.binary())), ("top", pa.binary())])
    for rows in _grouped(batches, "tree", "block"):
        out = [
            {"tree": r["tree"], "pos": r["pos"], "slots": [s for s, _ in path], "runs": [b"".join(run) for _, run in path], "top": top}
            for r, path, top in _paths_of(rows)
        ]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _placed(rows: DataFrame, *keys: str, name: str) -> DataFrame:
    """Rows with ``pos``, their place in their tree in order of the keys, and ``m``, the tree's size."""
    order = ["tree", *keys]
    sized = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)  # the id deals out repeated rows
    dealt = stage(sized.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), name)
    pieces = dealt.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("tree").alias("of"), F.col("part").alias("in"), "first", before.alias("before"), F.sum("n").over(tree).alias("m"))
    found = dealt.join(pieces, (F.col("part") == F.col("in")) & F.col("tree").eqNullSafe(F.col("of")))
    return found.withColumn("pos", F.expr("before + seq - first")).drop("of", "in", "first", "before", "part", "seq")


def _forest(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of (tree, pos, m, digest): all nodes, the tops of their blocks, and so on until every tree is one node."""
    rounds = [nodes]
    most = nodes.agg(F.max("m")).first()[0] or 0
    while most > 1:
        tops = _blocked(rounds[-1].where("m > 1").select("tree", "pos", "m", "digest")).mapInArrow(_upward, _NODE)
        rounds.append(stage(tops, name))
        most = -(-most // BLOCK)
    return rounds


def _inputs(nodes: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """Nodes of a round, and before those of each block the path of its top node."""
    paths = above.select("tree", F.col("pos").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), "slots", "runs", "top")
    some = nodes.where("m > 1").select("tree", F.expr(f"pos div {BLOCK}").alias("block"), F.lit(1).alias("kind"), "pos", "m", "digest", *more)
    both = paths.unionByName(some, allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos")


def _singles(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes that are a whole tree, with the paths of their subroots."""
    same = F.col("tree").eqNullSafe(F.col("of"))
    return nodes.where("m = 1").join(heads.withColumnRenamed("tree", "of"), same).drop("of")


def _paths(rounds: list[DataFrame], heads: DataFrame, name: str) -> DataFrame:
    """(tree, pos, slots, runs, top) of all nodes of the first table but one; heads are (tree, slots, runs, top) of subroots."""
    columns = ["tree", "pos", "slots", "runs", "top"]
    paths = None
    for nodes in reversed(rounds[1:]):
        own = _singles(nodes, heads).select(*columns)
        if paths is not None:
            own = own.unionByName(_inputs(nodes, paths).mapInArrow(_downward, _PATH))
        paths = stage(own, name)
    return paths


def _proofs(batches):
    """Leaves with their proofs: a block's rows, or a whole tree that is one leaf."""
    for rows in _grouped(batches, "tree", "block"):
        yield from _proved([(r, path, top) for r, path, top in _paths_of(rows)])


def _single_proofs(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for i in range(0, len(rows), BLOCK):
            yield from _proved([(r, tuple(zip(r["slots"], map(_split, r["runs"]))), r["top"]) for r in rows[i : i + BLOCK]])


def _proved(found: list[tuple[dict, Path, bytes]]):
    out: dict[str, list] = {"tree": [], "id": [], "leaf": [], "subroot": [], "slots": [], "sizes": [], "proof": [], "folded_root": []}
    for row, path, top in found:
        siblings = [[*run[:slot], *run[slot + 1 :]] for slot, run in path]
        slots = [slot for slot, _ in path]
        claim = row["digest"] if row["claim"] is None else row["claim"]
        out["tree"].append(row["tree"])
        out["id"].append(row["id"])
        out["leaf"].append(row["digest"].hex())
        out["subroot"].append(top.hex())
        out["slots"].append(slots)
        out["sizes"].append([len(run) for _, run in path])
        out["proof"].append("".join(d.hex() for level in siblings for d in level))
        out["folded_root"].append(fold(claim, slots, siblings).hex())
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


@dataclass(frozen=True)
class Manifest:
    """The root (None for an empty table), (tree, digest) rows of the subroots, and the rows with their proofs.

    ``rows`` has ``tree, id, leaf, subroot, root, slots, sizes, proof, folded_root``: digests are hex text,
    ``proof`` joins the siblings' digests level by level, ``slots`` and ``sizes`` say where in a run of what
    size the own digest stands, and ``folded_root`` is what the claimed digest leads to.
    """

    root: str | None
    subroots: DataFrame
    rows: DataFrame


def manifest(rows: DataFrame, group: str, key: str, digest: Column, claim: Column | None = None) -> Manifest:
    """The manifest of some rows: leaves are ``digest`` (32 bytes) by ``group`` in order of the bigint ``key``.

    ``claim`` is a digest to be checked in place of a row's own; a null stands for the own one.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    claimed = F.lit(None).cast("binary") if claim is None else claim
    leaves = rows.select(quoted(group).cast("string").alias("tree"), quoted(key).cast("long").alias("id"), digest.alias("digest"), claimed.alias("claim"))
    leaves = stage(_placed(stage(leaves, "manifest-leaves"), "id", "digest", "claim", name="manifest-order"), "manifest-placed")
    rounds = _forest(leaves, "manifest-nodes")
    tops = rounds[0].where("m = 1").select("tree", "digest")
    for nodes in rounds[1:]:
        tops = tops.unionAll(nodes.where("m = 1").select("tree", "digest"))
    subroots = stage(tops, "manifest-subroots")

    # The tree over the groups: its leaves are the subroots, its only group has no name.
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    over = stage(_placed(named, "name", name="manifest-groups"), "manifest-groups-placed")
    upper = _forest(over, "manifest-upper")
    last = upper[-1].where("m = 1").first()
    none = F.array().cast("array<int>").alias("slots"), F.array().cast("array<binary>").alias("runs")
    head = upper[-1].where("m = 1").select("tree", *none, F.col("digest").alias("top"))
    paths = _paths(upper, head, "manifest-upper-paths")
    if paths is None:
        heads = over.select(F.col("name").alias("tree"), *none, F.col("digest").alias("top"))
    else:
        found = _inputs(over, paths, "name").mapInArrow(_heads, "tree string, slots array<int>, runs array<binary>, top binary")
        heads = stage(found, "manifest-heads")

    paths = _paths(rounds, heads, "manifest-paths")
    result = "tree string, id long, leaf string, subroot string, slots array<int>, sizes array<int>, proof string, folded_root string"
    proved = _singles(leaves, heads).mapInArrow(_single_proofs, result)
    if paths is not None:
        proved = proved.unionByName(_inputs(leaves, paths, "id", "claim").mapInArrow(_proofs, result))
    root = last["digest"].hex() if last else None
    return Manifest(root, subroots, proved.withColumn("root", F.lit(root)))


def _heads(batches):
    """Paths of subroots, by the names of their groups; ``top`` is the subroot itself."""
    schema = pa.schema([("tree", pa.string()), ("slots", pa.list_(pa.int32())), ("runs", pa.list_(pa.binary())), ("top", pa.binary())])
    for rows in _grouped(batches, "tree", "block"):
        out = [
            {"tree": r["name"], "slots": [s for s, _ in path], "runs": [b"".join(run) for _, run in path], "top": r["digest"]}
            for r, path, _ in _paths_of(rows)
        ]
        yield pa.RecordBatch.from_pylist(out, schema=schema)
