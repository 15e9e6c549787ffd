"""Vector code compression: product codebooks of integer vectors, trained over anchors-hierarchy trees.

Components become integers, vectors are cut into equal parts, and every part position has a codebook whose
entries start as that part of the vectors with the least ids. A round gives each part its nearest entry
and puts the floor of the mean of its parts in place of each entry that has any; ties go to the entry
with the lower index. After the last round parts are given entries once more.

**Trees.** A task gathers consecutive vectors in blocks. In a block each part position gets a metric tree,
built once and used in all rounds. It is made from the middle out: about as many anchors as the square
root of the number of points are chosen, each the point that is furthest from its own anchor so far, and
take over the points that are nearer to them (a point is looked at only if it is more than half as far
from its anchor as the new anchor is). Anchors are merged pairwise, least enclosing ball first, up to a
root, and each is split the same way downward. A ball keeps its centre, radius, and the sum and number
of its points.

**Rounds.** From the root down, a ball inherits its parent's list of candidate entries and drops those that
another one beats strictly at every point of the ball. With one candidate left the ball is wholly owned:
its sum and number are added without a look at its points. At the leaves the rest is decided exactly.
Bounds are tested with a margin above rounding, and distances are exact integers, so results don't depend
on trees, blocks or partitions. Only sums and counts for each entry leave a task; the driver gets one
number a component of the codebooks, whose size is fixed.

Rows whose vector is null or has a null or non-finite component are dropped. So are vectors of another
length than the most common one among positive multiples of the number of parts (of equally common ones
the least): they have no such parts. Rows with a null id get codes but start no entry; rows with equal
ids start entries in order of their vectors. With fewer vectors than entries the codebooks are as short.
Null labels count as one label. Components whose squared distances pass a long raise an error, as the
result couldn't hold them. Other columns don't matter, whatever their names. An empty table gives an
empty result and empty codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.functions.arrays import quoted
from tunekit.llm.spark_tools import bounded_batches, stage

LEAF = 64  # points that a ball is not split below
BLOCK_VALUES = 1 << 17  # components in a block
MARGIN = 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, exact for whole numbers below 2^52."""
    out = np.zeros((len(a), len(b)), a.dtype)
    for x, y in zip(a.T, b.T):
        gap = x[:, None] - y[None, :]
        out += gap * gap
    return out


def _anchors(p: np.ndarray) -> np.ndarray:
    """The anchor (by number) that owns each point."""
    owner = np.zeros(len(p), np.int64)
    near = ((p - p[0]) ** 2).sum(axis=1)
    at = [0]
    most = int(np.ceil(len(p) ** 0.5))
    while len(at) < most:
        radius = np.zeros(len(at), p.dtype)
        np.maximum.at(radius, owner, near)
        widest = int(radius.argmax())
        if radius[widest] == 0:
            break
        own = np.flatnonzero(owner == widest)
        new = own[near[own].argmax()]
        gap = ((p[at] - p[new]) ** 2).sum(axis=1)
        may = np.flatnonzero(4 * near > gap[owner])
        d = ((p[may] - p[new]) ** 2).sum(axis=1)
        nearer = d < near[may]
        owner[may[nearer]], near[may[nearer]] = len(at), d[nearer]
        at.append(new)
    return owner


def _merges(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls in order of merging; the i-th merger has number len(centres) + i. Least enclosing ball first."""
    k = len(centres)
    c, r, n = (np.concatenate([x, np.zeros((k - 1, *x.shape[1:]))]) for x in (centres, radii, counts))
    size = np.full((2 * k - 1, 2 * k - 1), np.inf)
    size[:k, :k] = np.sqrt(_squares(c[:k], c[:k])) + r[:k, None] + r[None, :k]
    np.fill_diagonal(size, np.inf)
    live = np.arange(2 * k - 1) < k
    pairs = []
    for m in range(k, 2 * k - 1):
        a, b = divmod(int(size[:m, :m].argmin()), m)
        pairs.append((a, b))
        live[[a, b]] = False
        size[[a, b], :] = size[:, [a, b]] = np.inf
        n[m] = n[a] + n[b]
        c[m] = (c[a] * n[a] + c[b] * n[b]) / n[m]
        r[m] = max(np.sqrt(((c[m] - c[x]) ** 2).sum()) + r[x] for x in (a, b))
        others = np.flatnonzero(live)
        size[m, others] = size[others, m] = np.sqrt(((c[others] - c[m]) ** 2).sum(axis=1)) + r[others] + r[m]
        live[m] = True
    return pairs


@dataclass
class Tree:
    """Balls over points in tree order: ball i has the points start[i]:end[i]; left and right are -1 at leaves; ball 0 is the root."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius2: np.ndarray
    total: np.ndarray


def build_tree(p: np.ndarray) -> Tree:
    """A tree over the rows of p, whole numbers held as float64 or int64."""
    order: list[np.ndarray] = []
    balls: list[list] = []
    done = 0

    def ball(rows: np.ndarray) -> int:
        total = p[rows].sum(axis=0)
        centre = np.rint(total / len(rows)).astype(p.dtype)
        balls.append([done, done + len(rows), -1, -1, centre, ((p[rows] - centre) ** 2).sum(axis=1).max(), total])
        return len(balls) - 1

    def leaf(rows: np.ndarray) -> int:
        nonlocal done
        at = ball(rows)
        order.append(rows)
        done += len(rows)
        return at

    def split(rows: np.ndarray) -> int:
        owner = _anchors(p[rows]) if len(rows) > LEAF else np.zeros(len(rows), np.int64)
        k = int(owner.max()) + 1
        if k == 1:
            return leaf(rows)
        groups = [rows[owner == a] for a in range(k)]
        centres = np.array([p[g].mean(axis=0) for g in groups])
        radii = np.array([np.sqrt(((p[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres)])
        pairs = _merges(centres, radii, np.array([len(g) for g in groups], float))

        def middle_out(x: int) -> int:
            if x < k:
                return split(groups[x])
            at = ball(np.concatenate(list(under(x))))
            balls[at][2] = middle_out(pairs[x - k][0])
            balls[at][3] = middle_out(pairs[x - k][1])
            return at

        def under(x: int):
            if x < k:
                yield groups[x]
            else:
                for child in pairs[x - k]:
                    yield from under(child)

        return middle_out(2 * k - 2)

    split(np.arange(len(p)))
    start, end, left, right = (np.array([b[i] for b in balls], np.int32) for i in range(4))
    centre, radius2, total = (np.array([b[i] for b in balls], p.dtype) for i in (4, 5, 6))
    return Tree(np.concatenate(order).astype(np.int32), start, end, left, right, centre, radius2, total)


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, and the range of each."""
    size = end - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def assign(tree: Tree, p: np.ndarray, entries: np.ndarray, codes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums and counts for each entry, and the entry of each point (p and codes in tree order) if asked for."""
    e = len(entries)
    sums, counts = np.zeros(entries.shape, p.dtype), np.zeros(e, np.int64)
    code = np.zeros(len(p), np.int32) if codes else None
    apart = np.sqrt(_squares(entries, entries).astype(float))
    balls, listed = np.zeros(1, np.int64), np.ones((1, e), bool)
    while len(balls):
        d = np.where(listed, _squares(tree.centre[balls], entries).astype(float), np.inf)
        best = d.argmin(axis=1)
        lead = d - d.min(axis=1)[:, None]
        radius = np.sqrt(tree.radius2[balls].astype(float))
        listed = listed & (lead <= 2 * radius[:, None] * apart[best] * (1 + MARGIN) + MARGIN * np.where(listed, d, 0))
        listed[np.arange(len(balls)), best] = True
        n = listed.sum(axis=1)
        owned = n == 1
        np.add.at(sums, best[owned], tree.total[balls[owned]])
        np.add.at(counts, best[owned], (tree.end - tree.start)[balls[owned]])
        if codes:
            rows, which = _spans(tree.start[balls[owned]], tree.end[balls[owned]])
            code[rows] = best[owned][which]
        inner = ~owned & (tree.left[balls] >= 0)
        open_leaf = ~owned & ~inner
        for few in (True, False):
            some = np.flatnonzero(open_leaf & ((n <= 8) == few))
            if not len(some):
                continue
            rows, which = _spans(tree.start[balls[some]], tree.end[balls[some]])
            at = p[rows]
            if few:
                width = int(n[some].max())
                lists = np.argsort(~listed[some], axis=1, kind="stable")[:, :width]
                ok = np.take_along_axis(listed[some], lists, axis=1)
                exact = ((at[:, None, :] - entries[lists][which]) ** 2).sum(axis=2)
                choice = lists[which, np.where(ok[which], exact, np.inf if p.dtype == float else np.iinfo(np.int64).max).argmin(axis=1)]
            else:
                exact = _squares(at, entries)
                choice = np.where(listed[some][which], exact, np.inf if p.dtype == float else np.iinfo(np.int64).max).argmin(axis=1)
            np.add.at(sums, choice, at)
            counts += np.bincount(choice, minlength=e)
            if codes:
                code[rows] = choice
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]]).astype(np.int64)
        listed = np.concatenate([listed[inner], listed[inner]])
    return sums, counts, code


# --- blocks as rows ----------------------------------------------------------------------------

_TREE = ("order", "start", "end", "left", "right", "centre", "radius2", "total")


def _kind(top: int, dim: int) -> type:
    """How whole numbers are held: float64 while squared distances are exact in it, else int64."""
    bound = 4 * (top + 1) ** 2 * dim
    if bound >= 1 << 62:
        raise ValueError(f"components up to {top} (scaled) have squared distances beyond a long")
    return np.float64 if bound < 1 << 52 else np.int64


def _block(dim: int, parts: int, ids: pa.Array, labels: pa.Array, values: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    n, width = len(values), dim // parts
    top = max(int(values.max()), -int(values.min()))
    kind = _kind(top, dim)
    points, found = [], {name: [] for name in _TREE}
    for k in range(parts):
        part = values[:, k * width : (k + 1) * width]
        tree = build_tree(part.astype(kind))
        points.append(part[tree.order].astype(np.int64))
        for name in _TREE:
            own = getattr(tree, name)
            found[name].append(own if own.dtype == np.int32 else own.astype(np.int64))
    one = pa.array([0, n], pa.int32())
    columns = [
        pa.array([dim], pa.int32()),
        pa.array([n], pa.int64()),
        pa.array([top], pa.int64()),
        pa.ListArray.from_arrays(one, ids),
        pa.ListArray.from_arrays(one, labels),
        pa.array([b"".join(p.tobytes() for p in points)], pa.binary()),
        pa.array([[len(s) for s in found["start"]]], pa.list_(pa.int32())),
        *(pa.array([b"".join(x.tobytes() for x in found[name])], pa.binary()) for name in _TREE),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


def _with_trees(kept: DataFrame, parts: int) -> DataFrame:
    """(dim, n, top, ids, labels, points and trees) rows of vectors in blocks, staged."""
    label = kept.schema["label"].dataType.simpleString()
    schema = f"dim int, n long, top long, ids array<long>, labels array<{label}>, points binary, balls array<int>, " + ", ".join(f"`{x}` binary" for x in _TREE)

    def gather(batches):
        held: dict[int, list] = {}
        arrow = None

        def flush(dim: int):
            ids, labels, values = zip(*held.pop(dim))
            return _block(dim, parts, pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(values), arrow)

        for batch in batches:
            ids, labels, vectors = batch.columns
            if arrow is None:
                numbers = [("dim", pa.int32()), ("n", pa.int64()), ("top", pa.int64())]
                lists = [("ids", pa.list_(pa.int64())), ("labels", pa.list_(labels.type)), ("points", pa.binary()), ("balls", pa.list_(pa.int32()))]
                arrow = pa.schema(numbers + lists + [(x, pa.binary()) for x in _TREE])
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(lengths)):
                if dim <= 0 or dim % parts:
                    continue
                rows = pa.array(np.flatnonzero(lengths == dim))
                values = vectors.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                some, most = (ids.take(rows), labels.take(rows)), max(64, BLOCK_VALUES // dim)
                for first in range(0, len(values), most):
                    cut = slice(first, first + most)
                    held.setdefault(dim, []).append((some[0][cut], some[1][cut], values[cut]))
                    if sum(len(v) for _, _, v in held[dim]) >= most:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return stage(kept.mapInArrow(gather, schema), "vector-blocks")


def _read_block(row: dict, parts: int) -> list[tuple[np.ndarray, Tree]]:
    """Points (in tree order) and tree of every part of a block."""
    dim, n = row["dim"], row["n"]
    width, kind = dim // parts, _kind(row["top"], dim)
    points = np.frombuffer(row["points"], np.int64).reshape(parts, n, width).astype(kind)
    ends = np.cumsum([0, *row["balls"]])
    order = np.frombuffer(row["order"], np.int32).reshape(parts, n)
    flat = {x: np.frombuffer(row[x], np.int32) for x in ("start", "end", "left", "right")}
    flat["radius2"] = np.frombuffer(row["radius2"], np.int64).astype(kind)
    flat |= {x: np.frombuffer(row[x], np.int64).reshape(-1, width).astype(kind) for x in ("centre", "total")}
    return [(points[k], Tree(order[k], **{x: v[ends[k] : ends[k + 1]] for x, v in flat.items()})) for k in range(parts)]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: (part, entry, position within part)."""
    parts, entries, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def totals(batches):
        books = shared.value
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for k, (p, tree) in enumerate(_read_block(row, parts)):
                    s, n, _ = assign(tree, p, books[k].astype(p.dtype), codes=False)
                    sums[k] += s.astype(np.int64)
                    counts[k] += n
        flat = np.concatenate([sums, counts[:, :, None]], axis=2).ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["slot", "total"])

    own = blocks.drop("ids", "labels").mapInArrow(totals, "slot long, total long")
    rows = own.groupBy("slot").agg(F.sum("total").alias("total")).collect()  # one row a component of the codebooks at most
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    for r in rows:
        flat[r["slot"]] = r["total"]
    flat = flat.reshape(parts, entries, width + 1)
    counts = flat[:, :, width:]
    return np.where(counts > 0, flat[:, :, :width] // np.maximum(counts, 1), books)


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    parts = len(books)
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    schema = f"vec_id long, label {blocks.schema['labels'].dataType.elementType.simpleString()}, code string, error long"

    def run(batches):
        books = shared.value
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["ids", "labels"]).to_pylist()):
                codes, error = np.zeros((row["n"], parts), np.uint8), np.zeros(row["n"], np.int64)
                for k, (p, tree) in enumerate(_read_block(row, parts)):
                    book = books[k].astype(p.dtype)
                    _, _, code = assign(tree, p, book, codes=True)
                    codes[tree.order, k] = code
                    error[tree.order] += ((p - book[code]) ** 2).sum(axis=1).astype(np.int64)
                text = codes.tobytes().hex()
                size = 2 * parts
                hexed = pa.array([text[j : j + size] for j in range(0, len(text), size)], pa.string())
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                yield pa.RecordBatch.from_arrays([ids, labels, hexed, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return stage(blocks.mapInArrow(run, schema), "vector-codes")


HOT_LABELS = 10_000


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the sum of ``error`` over all rows of their label.

    Labels with more than one row in ``HOT_LABELS`` are fewer than that many and travel by broadcast;
    a shuffle by label only gets the others, so no task has more than that share of the rows of a label.
    """
    totals = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(totals.where(F.col("n") * HOT_LABELS > rows).select(F.col("label").alias("same"), "label_error"))
    cold = totals.where(F.col("n") * HOT_LABELS <= rows).select(F.col("label").alias("same"), "label_error")
    same = F.col("label").eqNullSafe(F.col("same"))
    some = coded.join(hot, same).drop("same")
    return some.unionByName(coded.join(hot.drop("label_error"), same, "left_anti").join(cold, same).drop("same"))


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of the kept vectors, and the final codebooks (part, entry, position)."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be in 1..256, as an index has two hex digits")
    spark = vectors.sparkSession
    bounded_batches(spark)
    numbers = F.transform(quoted(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    finite = F.forall(quoted(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(quoted(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    kept = kept.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(label).alias("label"), numbers.alias("vector"))
    blocks = _with_trees(kept, parts)
    common = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        empty = spark.createDataFrame([], blocks.select(F.lit(0).cast("long").alias("vec_id"), F.get("labels", F.lit(0)).alias("label")).schema)
        made = empty.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return made, np.zeros((parts, 0, 0), np.int64)
    dim = common["dim"]
    blocks = blocks.where(F.col("dim") == dim)
    first = kept.where((F.size("vector") == dim) & F.col("vec_id").isNotNull()).orderBy("vec_id", "vector").limit(entries).collect()
    if not first:  # no row has an id: any order of the vectors will do to start from
        first = kept.where(F.size("vector") == dim).orderBy("vector").limit(entries).collect()
    books = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _round(blocks, books)
    return with_label_error(_coded(blocks, books)), books


def books_sha256(books: np.ndarray) -> str:
    """Hex digest of all components in decimal, joined by commas in order of part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
