"""Similarity join of documents on word shingles by parity sketches.

A document is the set of its distinct five-word shingles. Two sets A, B with Jaccard similarity of
0.8 or more differ in at most (|A| + |B|) / 9 shingles. Each shingle belongs to one of K blocks, by
its hash, and the sketch of a set holds per block the XOR of the hashes of its shingles. A shingle
that only one set has changes one block, so the number of blocks in which two sketches differ is at
most the symmetric difference. K is larger than that difference can be in a size band; therefore two
similar sets of a band agree in some block that isn't empty (pigeonhole), and equal blocks are found
by a shuffle on (band, block, value).

Steps:

1. One pass over the texts gives every document its class (equal shingle sets) and its block keys.
   Keys travel packed, many to a row, to the task of their shard, where they are sorted. Copies
   collapse to their class in that pass.
2. The classes of a key are a bucket. Buckets of up to ``SMALL`` classes go on, equal ones once with their
   number, to the shard of their least class and give all their pairs there, with how many keys show a
   pair: so what is kept doesn't grow with the number of shards that a pair's keys are dealt over. A key of
   more classes is "hot" and goes with each of them to that class's shard; it gives a star around its
   least class. A similar pair shares at least as many keys as a class has filled blocks beyond the
   largest difference; a pair with fewer leaves, all hot keys of a class taken as shared.
3. Pairs are verified exactly and joined to components. A bit sketch of each set is compared first: its
   Hamming distance can't exceed the symmetric difference, so a larger distance refutes a pair without
   its shingles. Of very many pairs, one of each class is verified at a time, and then those that are
   still between two components. Sets are shuffled a part at a time.
4. Hot keys whose classes are all in one component are settled. In the others a class can be left out
   when it has fewer hot keys than blocks that any partner must share with it: such a partner shares a
   key that isn't hot, and was met in step 2. Classes that are left form families (those that share such
   a key, and onwards). The bit sketches of a family are laid in blocks of about ``BLOCK`` classes, and
   blocks of different components are compared with each other in numpy; only pairs that the sketches
   don't refute become rows and are verified. Blocks are shuffled, not pairs of blocks.

Nulls and ties: a null text or one without words has no shingles and is linked with nothing. A row
with a null ``doc_id`` links nothing and has a null component. Rows with the same ``doc_id`` stand
each for its own text. Extra columns are ignored, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from tunekit.llm.arrays import PIECE, constants, groups, mix, text_bytes, word_hashes
from tunekit.llm.spark_tools import bounded_batches, components, maybe_member, membership, partitions, stage

WORDS = 5
SMALL = 12
BLOCK = 256
ROW = 8
STEP = 1 << 24  # shingles of pairs that are verified in one step, at least
PAIRS = 1 << 20  # so many pairs at most are verified without a look at what others join
SINGLE_LEVEL = 6  # bands of sets under 2**6 shingles: each shingle is a block of its own
LEVEL_BITS = np.uint64(6)
_MULTIPLIERS = constants(WORDS, 11)
_BLOCKS = constants(2, 13)


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of one document's word hashes."""
    if len(words) == 0:
        return words
    if len(words) < WORDS:
        return mix(np.array([np.sum(words * _MULTIPLIERS[: len(words)]) + np.uint64(len(words))], dtype=np.uint64))
    n = len(words) - WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(WORDS):
        total += words[i : i + n] * _MULTIPLIERS[i]
    return np.unique(mix(total))


def shingle_class(s: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return int(np.bitwise_xor.reduce(mix(s + np.uint64(1))) ^ mix(np.array([len(s)], dtype=np.uint64))[0])


def levels(n: int) -> list[tuple[int, int]]:
    """The size bands a set of n shingles takes part in, each with the largest symmetric difference to a similar set met there.

    A set is in the band of its own power of two, where its partners are of that band or larger, and
    in the band below if a similar set can be that small.
    """
    own = n.bit_length() - 1
    out = [(own, (n + n * 5 // 4) // 9)]
    if own and 4 * n < 5 << own:
        out.append((own - 1, (n + (1 << own) - 1) // 9))
    return out


def block_keys(s: np.ndarray, level: int) -> np.ndarray:
    """The keys of the sketch's blocks that aren't empty; the lowest bits of a key are its band."""
    if level < SINGLE_LEVEL:
        keys = mix(s ^ _BLOCKS[0])
    else:
        k = np.uint64((4 << (level + 1)) // 10)
        block = ((s >> np.uint64(32)) * k) >> np.uint64(32)  # sorted like s
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        keys = mix(np.bitwise_xor.reduceat(s, first) ^ (block[first] * _BLOCKS[1]))
    return ((keys << LEVEL_BITS) | np.uint64(level)).view(np.int64)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits of the set, about four for each shingle: every shingle flips one bit."""
    bits = 4 << len(s).bit_length()
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches; the longer one is folded to the shorter's length, which keeps parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(y) < len(x):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batch: pa.RecordBatch):
    """(row, shingle set) of every row of a batch of (doc_id, text)."""
    data, ends = text_bytes(batch.column(1))
    for lo, hi in groups(ends):
        words, at = word_hashes(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        for i in range(lo, hi):
            yield i, shingles(words[at[i - lo] : at[i - lo + 1]])


# Rows on their way to a shard; packed: columns of numbers, one after another.
# kind: 0 a document, 1 keys of classes and then buckets, 2 hot keys of a class, 3 how many keys a partner must share with a class in a band
_DEALT = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("spare", pa.list_(pa.int32())), ("shard", pa.int32()), ("packed", pa.binary())]
)
_DEALT_DDL = "kind int, doc_id long, cls long, n long, spare array<int>, shard int, packed binary"
_KEY, _HOT, _SPARE = ("<u4", "<u2", "<i8"), ("<i8", "<i8", "<i8"), ("<i8", "<i4", "<i4")
KEY_BITS = np.uint64(48)


def _made(schema: pa.Schema, kind: int, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["kind"] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _rows(kind: int, shard: list, packed: list):
    for x in range(0, len(shard), 256):
        yield _made(_DEALT, kind, {"shard": pa.array(shard[x : x + 256], pa.int32()), "packed": pa.array(packed[x : x + 256], pa.binary())})


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True])


def _packed(kind: int, shard: np.ndarray, *columns: np.ndarray):
    """A row of packed columns for every shard."""
    if len(shard) == 0:
        return
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    cuts = _cuts(shard)
    yield from _rows(kind, shard[cuts[:-1]].tolist(), [b"".join(c[x:y].tobytes() for c in columns) for x, y in zip(cuts[:-1], cuts[1:])])


def _unpacked(rows: list, types: tuple) -> list[np.ndarray]:
    """The columns of packed rows."""
    found: list[list] = [[np.zeros(0, t)] for t in types]
    width = sum(np.dtype(t).itemsize for t in types)
    for row in rows:
        at = 0
        for t, column in zip(types, found):
            column.append(np.frombuffer(row, t, len(row) // width, at))
            at += column[-1].nbytes
    return [np.concatenate(column) for column in found]


def _home(cls: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a class."""
    return (cls.view(np.uint64) % np.uint64(shards)).astype(np.int32)


def _keys(shards: int):
    """A row for every document, and rows of packed keys by shard."""

    def packed(keys: list, cls: list, needs: list):
        if not keys:
            return
        key, owner = np.concatenate(keys).view(np.uint64), np.repeat(np.array(cls, np.int64), [len(k) for k in keys])
        need = np.array(needs, np.int64)
        keys.clear(), cls.clear(), needs.clear()
        # 48 bits of a key are enough within its shard: keys only propose pairs.
        key, shard = key & ((np.uint64(1) << KEY_BITS) - np.uint64(1)), (mix(key) % np.uint64(shards)).astype(np.int32)
        yield from _packed(1, shard, (key >> np.uint64(16)).astype("<u4"), key.astype("<u2"), owner)
        name = need[:, 0].copy()
        yield from _packed(3, _home(name, shards), name, need[:, 1].astype("<i4"), need[:, 2].astype("<i4"))

    def run(batches):
        keys, cls, needs, seen, held = [], [], [], set(), 0
        for batch in batches:
            ids, names, sizes, spare = batch.column(0).to_pylist(), [], [], []
            for i, s in _sets(batch):
                name = signed(shingle_class(s)) if len(s) else 0
                names.append(name), sizes.append(len(s))
                room = []
                for level, most in levels(len(s)) if len(s) else ():
                    found = block_keys(s, level)
                    if len(found) <= most:
                        raise ValueError("a sketch with too few filled blocks; choose other hash constants")
                    room += [level, len(found) - most]
                    if ids[i] is not None and (name, level) not in seen:
                        seen.add((name, level))
                        keys.append(found), cls.append(name), needs.append((name, *room[-2:]))
                        held += len(found)
                spare.append(room)
                if held > 500_000:
                    yield from packed(keys, cls, needs)
                    seen.clear()
                    held = 0
            n = len(ids)
            columns = {"doc_id": batch.column(0).cast(pa.int64()), "cls": pa.array(names, pa.int64()), "n": pa.array(sizes, pa.int64()), "spare": pa.array(spare, pa.list_(pa.int32()))}
            yield _made(_DEALT, 0, columns | {"shard": pa.array(np.arange(n) % shards, pa.int32())})
        yield from packed(keys, cls, needs)

    return run


def _split(batches, held: dict[int, list]):
    """The batches' rows without packed columns; the packed ones are put into held, by kind."""
    for batch in batches:
        plain = batch.filter(batch.column("packed").is_null())
        if len(plain):
            yield plain
        both = batch.filter(batch.column("packed").is_valid())
        for kind, row in zip(both.column("kind").to_pylist(), both.column("packed").to_pylist()):
            held.setdefault(kind, []).append(row)


def _bucket_names(start: np.ndarray, level: np.ndarray, members: np.ndarray) -> np.ndarray:
    """64-bit names of buckets (sets of classes in a band); their members lie one after another."""
    return np.add.reduceat(mix(members.view(np.uint64)), start) * _BLOCKS[0] + mix(level.astype(np.uint64) + _BLOCKS[1])


def _gathered(start: np.ndarray, size: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The members of some buckets, one bucket after another."""
    at = np.cumsum(size) - size
    return members[np.repeat(start - at, size) + np.arange(size.sum())]


def _buckets(small: int, shards: int):
    """What the keys of one task's shard give: hot keys, dealt by the class they are of, and buckets of fewer classes, dealt by the least of them."""

    def run(batches):
        held: dict[int, list] = {}
        yield from _split(batches, held)
        for x in range(0, len(held.get(3, ())), 256):
            name, level, need = _unpacked(held[3][x : x + 256], _SPARE)
            yield from _packed(3, _home(name, shards), name, level, need)
        high, low, owner = _unpacked(held.pop(1, []), _KEY)
        held.clear()
        if len(owner) == 0:
            return
        key = (high.astype(np.int64) << 16) | low
        del high, low
        # Only keys met more than once matter.
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        same = np.r_[False, key[1:] == key[:-1], False]
        keep = same[1:] | same[:-1]
        key, owner = key[keep], owner[keep]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        if len(key) == 0:
            return
        new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        key, owner = key[new], owner[new]
        cuts = _cuts(key)
        start, size = cuts[:-1], np.diff(cuts)
        hot = np.repeat(size > small, size)
        yield from _packed(2, _home(owner[hot], shards), owner[hot], key[hot], np.repeat(owner[start], size)[hot])
        some = (size > 1) & (size <= small)
        if not some.any():
            return
        start, size = start[some], size[some]
        level, members = (key[start] & 63).astype("<u1"), _gathered(start, size, owner)
        start = np.cumsum(size) - size
        _, at, times = np.unique(_bucket_names(start, level, members), return_index=True, return_counts=True)
        home = _home(members[start[at]], shards)
        order = np.argsort(home, kind="stable")
        at, times, home = at[order], times[order].astype("<u4"), home[order]
        cuts, rows = _cuts(home), []
        for x, y in zip(cuts[:-1], cuts[1:]):
            i = at[x:y]
            parts = np.array([y - x], "<u4"), size[i].astype("<u4"), level[i], times[x:y], _gathered(start[i], size[i], members)
            rows.append(b"".join(p.tobytes() for p in parts))
        yield from _rows(1, home[cuts[:-1]].tolist(), rows)

    return run


# kind: 0 a document, 1 a pair (a, b) that shares n keys of a band that aren't hot, 2 a member cls of a hot key,
# 3 that cls has n hot keys of a band and a partner must share a, 4 a pair of the least class of a hot key and another
_FOUND = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("spare", pa.list_(pa.int32())), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("level", pa.int32())]
)
_FOUND_DDL = "kind int, doc_id long, cls long, n long, spare array<int>, a long, b long, key long, level int"


def _classes():
    """The documents' rows as they are, and what the classes of one task's shard have: hot keys, and pairs from the buckets they are the least of."""

    def run(batches):
        held: dict[int, list] = {}
        for docs in _split(batches, held):
            yield _made(_FOUND, 0, {c: docs.column(c) for c in ("doc_id", "cls", "n", "spare")})
        yield from _hot_of(_unpacked(held.pop(2, []), _HOT), _unpacked(held.pop(3, []), _SPARE))
        yield from _pairs_of(held.pop(1, []))

    return run


def _hot_of(hot: list[np.ndarray], needs: list[np.ndarray]):
    cls, key, least = hot
    if len(cls) == 0:
        return
    level = (key & 63).astype(np.int32)
    order = np.lexsort((key, level, cls))
    cls, key, least, level = cls[order], key[order], least[order], level[order]
    first = np.flatnonzero(np.r_[True, (cls[1:] != cls[:-1]) | (level[1:] != level[:-1])])
    count = np.diff(np.r_[first, len(cls)])
    # A class has two bands at most.
    name, band, need = needs
    order = np.lexsort((band, name))
    name, band, need = name[order], band[order], need[order]
    new = np.r_[True, (name[1:] != name[:-1]) | (band[1:] != band[:-1])]
    name, band, need = name[new], band[new], need[new]
    at = np.searchsorted(name, cls[first])
    need = need[at + (band[at] != level[first])].astype(np.int64)
    yield from _slices(3, cls=cls[first], level=level[first], n=count, a=need)
    # A pair that no other key has shown shares `spare` hot keys of either class, so each may do without the last half of
    # as many: two such halves don't hold all that is shared.
    nth = np.arange(len(cls)) - np.repeat(first, count)
    enough = np.repeat(count >= need, count)
    kept = enough & (nth < np.repeat(count - (need - 1) // 2, count))
    yield from _slices(2, cls=cls[kept], key=key[kept])
    enough &= cls != least
    star = np.unique(np.stack([least[enough], cls[enough], level[enough]], axis=1), axis=0)
    yield from _slices(4, a=star[:, 0], b=star[:, 1], level=star[:, 2].astype(np.int32))


def _pairs_of(rows: list):
    """Pairs of the classes of each bucket, and how many keys show them; the buckets of a least class are taken together."""
    found = [[np.zeros(0, t)] for t in ("<u4", "<u1", "<u4", "<i8")]
    for row in rows:
        n, at = int(np.frombuffer(row, "<u4", 1)[0]), 4
        for t, column in zip(("<u4", "<u1", "<u4", "<i8"), found):
            column.append(np.frombuffer(row, t, n if t != "<i8" else (len(row) - at) // 8, at))
            at += column[-1].nbytes
    rows.clear()
    size, level, times, members = (np.concatenate(column) for column in found)
    if len(size) == 0:
        return
    del found
    size = size.astype(np.int64)
    start = np.cumsum(size) - size
    _, at, same = np.unique(_bucket_names(start, level, members), return_index=True, return_inverse=True)
    times = np.bincount(same, weights=times).astype(np.int64)
    order = np.argsort(members[start[at]], kind="stable")
    at, times = at[order], times[order]
    start, size, level = start[at], size[at], level[at]
    made = np.cumsum(size * (size - 1) // 2)
    x = 0
    while x < len(size):
        y = max(x + 1, int(np.searchsorted(made, (made[x - 1] if x else 0) + 500_000, side="right")))
        a, b, band, shared = [], [], [], []
        for m in np.unique(size[x:y]):
            i = x + np.flatnonzero(size[x:y] == m)
            classes = members[start[i][:, None] + np.arange(m)]
            for j in range(m):
                for k in range(j + 1, m):
                    a.append(classes[:, j]), b.append(classes[:, k]), band.append(level[i]), shared.append(times[i])
        a, b, band, shared = np.concatenate(a), np.concatenate(b), np.concatenate(band), np.concatenate(shared)
        order = np.lexsort((band, b, a))
        a, b, band, shared = a[order], b[order], band[order], shared[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (band[1:] != band[:-1])])
        yield from _slices(1, a=a[first], b=b[first], level=band[first].astype(np.int32), n=np.add.reduceat(shared, first))
        x = y


def _slices(kind: int, **columns):
    for x in range(0, len(next(iter(columns.values()))), 50_000):
        yield _made(_FOUND, kind, {c: pa.array(np.ascontiguousarray(v[x : x + 50_000])) for c, v in columns.items()})


_SETS = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("sketch", pa.binary())])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _candidate_sets(batches):
    """The shingles and the bit sketch of the classes that have a partner, from a document (doc_id, text, cls) of each."""
    for batch in batches:
        cls, held, at = batch.column(2).to_pylist(), [], 0
        for i, s in _sets(batch):
            if signed(shingle_class(s)) == cls[i]:  # another text may have the same doc_id
                held.append({"cls": cls[i], "n": len(s), "hashes": s.tobytes(), "sketch": bit_sketch(s)})
                at += len(s) * 8
            if at > 4 * PIECE:
                yield pa.RecordBatch.from_pylist(held, schema=_SETS)
                held, at = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_SETS)


@F.arrow_udf(BooleanType())
def _near_by_sketch(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    limit = (n.to_numpy(zero_copy_only=False) + m.to_numpy(zero_copy_only=False)) // 9
    return pa.array([hamming(p.as_buffer(), q.as_buffer()) <= d for d, p, q in zip(limit, x, y)], pa.bool_())


@F.arrow_udf(BooleanType())
def _similar(x: pa.Array, y: pa.Array) -> pa.Array:
    out = []
    for p, q in zip(x, y):
        a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
        both = np.concatenate([a, b])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(100 * shared >= 80 * (len(both) - shared))
    return pa.array(out, pa.bool_())


def _side(table: DataFrame, end: str) -> DataFrame:
    """A table of classes for one end of a pair: cls becomes the end's name, other columns get it as a suffix."""
    return table.select(*(F.col(c).alias(end if c == "cls" else f"{c}_{end}") for c in table.columns))


def _refuted_less(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that sizes and bit sketches don't refute, and how many shingles both have."""
    small = sets.select("cls", "n", "sketch")
    near = pairs.join(_side(small, "a"), "a").join(_side(small, "b"), "b").where("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)")
    near = near.where(_near_by_sketch("n_a", "n_b", "sketch_a", "sketch_b"))
    return stage(near.select("a", "b", F.expr("n_a + n_b").alias("size")), name)


def _verified(near: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The similar ones of some pairs (a, b, size); only the sets of their classes are shuffled.

    Every pair brings two sets along, so the pairs are taken in steps that shuffle a part of what all sets hold.
    """
    size, held = (t.agg(F.sum(c)).first()[0] or 0 for t, c in ((near, "size"), (sets, "n")))
    steps = max(1, -(-size // max(held // 3, STEP)))
    found = []
    for i in range(steps):
        some = near.where(F.expr(f"pmod(xxhash64(b), {steps}) = {i}")).select("a", "b")
        full = maybe_member(sets.select("cls", "hashes"), "cls", membership(some.select(F.explode(F.array("a", "b")).alias("cls")), "cls"))
        found.append(stage(some.join(_side(full, "a"), "a").join(_side(full, "b"), "b").where(_similar("hashes_a", "hashes_b")).select("a", "b"), name))
    return reduce(DataFrame.unionAll, found)


def _linked(pairs: DataFrame, sets: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(id, component) of the classes that the similar ones of some pairs join, or parts joined further.

    While there are many pairs, one of each class is verified at a time, and those that this leaves within a component
    need no look.
    """

    def joined(some: DataFrame) -> DataFrame:
        links = _verified(_refuted_less(some, sets, "parity-near"), sets, "parity-links")
        if parts is None:
            return stage(components(links), "parity-parts")
        known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
        return parts if links.isEmpty() else stage(components(links.unionAll(known)), "parity-parts")

    left, most = pairs.count(), max(PAIRS, 2 * sets.count())
    while left > most:
        first = stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "parity-first")
        parts = joined(first)
        pairs = pairs.join(first, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            pairs = pairs.join(parts.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        pairs = stage(pairs.where("coalesce(of_a, a) != coalesce(of_b, b)").select("a", "b"), "parity-pairs")
        was, left = left, pairs.count()
        if 2 * left > was:
            break
    return joined(pairs)


_NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _near_of_blocks(batches):
    """Pairs of different components that sizes and sketches don't refute, from rows of two blocks of classes."""
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            x, y = row["x"], row["y"]
            found = []
            n, c = (np.array([e[k] for e in y], np.int64) for k in ("n", "component"))
            by_size: dict[int, list[int]] = {}
            for j, e in enumerate(y):
                by_size.setdefault(len(e["sketch"]), []).append(j)
            tables = {size: (np.array(js), np.stack([np.frombuffer(y[j]["sketch"], np.uint8) for j in js])) for size, js in by_size.items()}
            for e in x:
                own = np.frombuffer(e["sketch"], np.uint8)
                for size, (js, table) in tables.items():
                    short = min(size, len(own))
                    p, q = (t.reshape(*t.shape[:-1], -1, short) for t in (own, table))
                    p, q = np.bitwise_xor.reduce(p, axis=-2), np.bitwise_xor.reduce(q, axis=-2)
                    distance = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
                    ok = (distance <= (e["n"] + n[js]) // 9) & (c[js] != e["component"])
                    found += [(e["cls"], y[j]["cls"]) for j in js[ok]]
            if found:
                pairs = np.unique(np.sort(np.array(found, np.int64), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in (0, 1)], schema=_NEAR)


def _hot_pairs(hot: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Pairs (a, b) across components that only hot keys can show and that aren't refuted; None if all hot keys are settled."""
    of = parts.select(F.col("id").alias("cls"), "component")
    placed = hot.join(of, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = stage(placed.select("key", "cls", "component"), "parity-hot")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("cls").alias("least")).where("x != y")
    stars = stage(placed.join(mixed.select("key", "least"), "key").select("cls", "least", "component").distinct(), "parity-stars")
    if stars.isEmpty():
        return None
    families = components(stars, "cls", "least").withColumnsRenamed({"id": "cls", "component": "family"})
    members = stars.select("cls", "component").distinct().join(families, "cls").join(sets.select("cls", "n", "sketch"), "cls")
    # Large components have blocks of their own; the small ones of a family share blocks.
    sizes = members.groupBy("family", "component").count()
    sizes = sizes.withColumn("own", F.when(F.col("count") >= BLOCK, F.col("component")))
    shared = sizes.groupBy("family", "own").agg(F.ceil(F.sum("count") / BLOCK).alias("parts"))
    placed = members.join(sizes.select("family", "component", "own"), ["family", "component"])
    placed = placed.join(shared.withColumnRenamed("own", "o").withColumnRenamed("family", "f"), F.expr("family = f AND own <=> o"))
    blocks = stage(
        placed.groupBy("family", "own", F.expr("pmod(xxhash64(cls), parts)").alias("part"))
        .agg(F.collect_list(F.struct("cls", "component", "n", "sketch")).alias("block")),
        "parity-blocks",
    )
    # About ROW blocks of a family are together in a row, and every block is sent to each row; pairs of blocks aren't shuffled.
    counts = blocks.groupBy("family").agg(F.ceil(F.count("*") / ROW).alias("rows"))
    counted = blocks.join(counts, "family")
    each = counted.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    each = each.select("family", "row", F.col("own").alias("own_y"), F.col("part").alias("part_y"), F.col("block").alias("y"))
    own = counted.withColumn("row", F.expr("pmod(xxhash64(own, part), rows)")).select("family", "row", "own", "part", F.col("block").alias("x"))
    rank = "struct(coalesce(own, bigint(-1)), own IS NULL, part)"
    met = each.join(own.hint("merge"), ["family", "row"]).where(
        f"{rank} <= struct(coalesce(own_y, bigint(-1)), own_y IS NULL, part_y) AND NOT coalesce(own = own_y, false)"
    )
    return met.select("x", "y").mapInArrow(_near_of_blocks, "a long, b long").distinct()


def similar_documents(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links of similarity 0.8 or more) of every row of (doc_id, text).

    Keys of more than ``small`` classes are treated as hot; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = partitions(spark)
    dealt = docs.mapInArrow(_keys(shards), _DEALT_DDL).repartitionById(shards, F.col("shard"))
    dealt = dealt.mapInArrow(_buckets(small, shards), _DEALT_DDL).repartitionById(shards, F.col("shard"))
    found = stage(dealt.mapInArrow(_classes(), _FOUND_DDL), "parity-found")
    rows = found.where("kind = 0").select("doc_id", "cls", "n", "spare")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("spare").alias("spare")
    )
    each = F.expr("transform(sequence(0, size(spare) - 2, 2), i -> struct(spare[i] AS level, spare[i + 1] AS spare))")
    hot_keys = found.where("kind = 3").select("cls", "level", F.col("n").alias("hot"), F.col("a").alias("spare"))
    need = classes.select("cls", F.explode(each).alias("s")).select("cls", "s.*").join(hot_keys.drop("spare"), ["cls", "level"], "left")
    need = stage(need.select("cls", "level", F.expr("spare - coalesce(hot, 0)").alias("need")), "parity-need")
    pairs = found.where("kind = 1").groupBy("a", "b", "level").agg(F.sum("n").alias("shared"))
    for end in ("a", "b"):
        pairs = pairs.join(need.select(F.col("cls").alias(end), "level", "need"), [end, "level"]).where("shared >= need").drop("need")
    strong = hot_keys.where("hot >= spare").select(F.col("cls").alias("a"), "level")
    stars = found.where("kind = 4").select("a", "b", "level").join(strong, ["a", "level"])
    pairs = stage(pairs.select("a", "b").unionAll(stars.select("a", "b")).distinct(), "parity-pairs")
    hot = found.where("kind = 2").select("cls", "key")
    met = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionAll(hot.select("cls")).distinct()
    known = stage(classes.join(met, "cls", "left_semi"), "parity-classes")
    wanted = known.select("cls", F.col("least_id").alias("doc_id"))
    texts = maybe_member(docs, "doc_id", membership(wanted, "doc_id"))
    matched = texts.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "cls")
    sets = stage(matched.mapInArrow(_candidate_sets, "cls long, n long, hashes binary, sketch binary"), "parity-sets")
    parts = _linked(pairs, sets)
    last = _hot_pairs(hot, parts, sets)
    if last is not None:
        parts = _linked(stage(last.join(pairs, ["a", "b"], "left_anti"), "parity-near2"), sets, parts)
    grouped = classes.join(parts.withColumnRenamed("id", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("name"), "least_id")
    least = grouped.groupBy("name").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(least, "name").select("cls", "component_id")
    linked = rows.join(named.hint("shuffle_hash"), "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
