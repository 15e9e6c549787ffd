"""SentencePiece encoding and decoding: Viterbi over a double-array trie of scored pieces.

A text gets one leading space, and spaces become the marker. Of all ways to write it as pieces the one
with the largest sum of log scores is taken; of equal sums the one whose last piece begins earliest. A
character that no piece covers costs the least score less ten, and is written as its UTF-8 bytes'
pieces (or as the unknown piece if the vocabulary has no byte pieces).

Where two characters stand side by side in no piece, no piece crosses that place, and the best way of the
whole is the best ways of both parts put together. So a text is cut before every run of markers that
follows another character (if no piece has a marker after another character, which is checked when the
model is built), and a part again at its last such place, as between a word and a comma. Parts repeat,
and their ids are kept in a bounded cache per process.

Decoding joins the pieces, turns markers into spaces and byte pieces into bytes, and takes the leading
space away. It gives the text back exactly unless the text itself has the marker U+2581, which comes
back as a space.

A null text has null ids and decodes to null; an empty text has no ids. Very long texts are cut as
above, one place after the other, in a part without spaces too; what has no such place is encoded whole
in memory in proportion to its length. Repeated rows, null ids and extra columns don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tunekit.llm.spark_tools import bounded_batches, map_rows, without
from tunekit.llm.vocabulary import SPACE, Pieces

PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHED = 1 << 18
CHARS = 1 << 20
SHORT = 64  # characters of parts that are kept
UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class DoubleArray:
    """Trie over bytes: the child of node s by byte c is base[s] + c + 1 if check there is s; value is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(keys: list[tuple[bytes, int]]) -> DoubleArray:
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                values.append(-1)
            node = children[node][c]
        values[node] = value
    size = 2 * len(children) + 1024
    base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used, check[0], out[0] = bytearray(size), 0, values[0]
    used[0] = 1
    # Nodes with one child fill the first gap; others are placed from a point that only moves on.
    free, wide, todo = 257, 0, [(0, 0)]
    while todo:
        node, place = todo.pop()
        kids = sorted(children[node])
        if not kids:
            base[place] = 0
            continue
        while used[free]:
            free += 1
        at = max(free - kids[0] - 1, 0) if len(kids) == 1 else wide
        while True:
            if at + 300 > len(used):
                grow = len(used)
                used += bytearray(grow)
                base, check, out = (np.r_[x, np.full(grow, v, np.int32)] for x, v in ((base, 0), (check, -1), (out, -1)))
            if not any(used[at + c + 1] for c in kids):
                break
            at += 1
        wide = at if len(kids) > 1 else wide
        base[place] = at
        for c in kids:
            to = at + c + 1
            used[to], check[to], out[to] = 1, place, values[children[node][c]]
            todo.append((children[node][c], to))
    end = max(np.flatnonzero(np.frombuffer(bytes(used), np.uint8))) + 300
    pad = lambda x, v: np.r_[x[:end], np.full(max(end - len(x), 0), v, np.int32)]
    return DoubleArray(pad(base, 0), pad(check, -1), pad(out, -1))


@dataclass(frozen=True)
class Model:
    trie: DoubleArray
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]
    unknown: int
    plain: tuple[bytes, ...]  # what each id decodes to
    parted: bool  # whether texts may be cut before runs of markers
    pairs: frozenset[str]  # characters that are side by side in some piece


def build(pieces: Pieces) -> Model:
    """A model on the driver; its arrays are a few megabytes and are broadcast."""
    normal = pieces.normal()
    plain = [b""] * len(pieces.pieces)
    for i in normal:
        plain[i] = pieces.pieces[i].replace(SPACE, " ").encode()
    for b, i in enumerate(pieces.bytes_):
        plain[i] = bytes([b])
    unknown = min(pieces.silent, default=0)
    if not pieces.bytes_:
        plain[unknown] = " ⁇ ".encode()
    parted = all(SPACE not in pieces.pieces[i].lstrip(SPACE) for i in normal)
    pairs = frozenset(p[k : k + 2] for p in (pieces.pieces[i] for i in normal) for k in range(len(p) - 1))
    trie = double_array([(pieces.pieces[i].encode(), i) for i in normal])
    return Model(trie, pieces.scores, pieces.bytes_, unknown, tuple(plain), parted, pairs)


class Encoder(dict):
    """Ids (as bytes of int32) of the parts seen so far."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.base, self.check, self.value = model.trie.base.tolist(), model.trie.check.tolist(), model.trie.value.tolist()
        scored = [model.scores[v] for v in set(self.value) if v >= 0]
        self.missing = min(scored, default=0.0) - UNKNOWN_COST

    def __missing__(self, part: str) -> bytes:
        if len(part) >= SHORT:
            return b"".join(self.long(part))
        pairs = self.model.pairs
        cut = next((i for i in range(len(part) - 1, 0, -1) if part[i - 1 : i + 1] not in pairs), 0)
        ids = self[part[:cut]] + self[part[cut:]] if cut else np.array(self.best(part), np.int32).tobytes()
        self[part] = ids
        return ids

    def long(self, part: str) -> Iterator[bytes]:
        """Ids of what is between the cut places of a part of any length."""
        pairs, at, n = self.model.pairs, 0, len(part)
        while at < n:
            near = range(min(at + SHORT, n) - 1, at, -1) if n - at >= SHORT else ()
            to = next((i for i in near if part[i - 1 : i + 1] not in pairs), 0)
            to = to or next((i for i in range(at + SHORT, n) if part[i - 1 : i + 1] not in pairs), n)
            own = part[at:to]
            yield self[own] if len(own) < SHORT else np.array(self.best(own), np.int32).tobytes()
            at = to

    def best(self, part: str) -> Sequence[int]:
        data = part.encode("utf-8", "surrogatepass")
        n = len(data)
        base, check, value, scores = self.base, self.check, self.value, self.model.scores
        low = float("-inf")
        few = n < CHARS  # lists are faster, arrays smaller
        sums = [low] * (n + 1) if few else array("d", [low]) * (n + 1)
        back, piece = ([0] * (n + 1), [-1] * (n + 1)) if few else (array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1))
        sums[0] = 0.0
        at = 0
        while at < n:
            here = sums[at]
            lead = data[at]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, to, single = 0, at, False
            while to < n:
                nxt = base[node] + data[to] + 1
                if check[nxt] != node:
                    break
                node = nxt
                to += 1
                v = value[node]
                if v >= 0:
                    total = here + scores[v]
                    if total > sums[to]:
                        sums[to], back[to], piece[to] = total, at, v
                    single = single or to == at + step
            if not single:
                to = at + step
                total = here + self.missing
                if total > sums[to]:
                    sums[to], back[to], piece[to] = total, at, -1
            at += step
        out = [] if few else array("i")
        at = n
        while at:
            start = back[at]
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.model.bytes_:
                out.extend(self.model.bytes_[b] for b in reversed(data[start:at]))
            else:
                out.append(self.model.unknown)
            at = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        parts = PART.findall(marked) if self.model.parted else [marked]
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.model.plain.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


_built: dict[int, Encoder] = {}


def _encoder(key: int, model: Model) -> Encoder:
    if key not in _built:
        _built[key] = Encoder(model)
    if len(_built[key]) > CACHED:
        _built[key].clear()
    return _built[key]


def encode(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows' other columns, the text, ``ids``, and ``decoded`` (ids turned back to text); input columns of these names (in any case) are replaced."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, "ids", "decoded")
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    shared, key = docs.sparkSession.sparkContext.broadcast(model), id(model)
    at = docs.columns.index(text)

    def run(batches):
        encoder = _encoder(key, shared.value)
        for batch in batches:
            texts, first, size = batch.column(at).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > CHARS or i + 1 == len(texts):
                    own = [None if t is None else encoder.encode(t) for t in texts[first : i + 1]]
                    none = [x is None for x in own]
                    ends = np.cumsum([0, *(0 if x is None else len(x) for x in own)]).astype(np.int32)
                    flat = np.concatenate([x for x in own if x is not None] or [np.zeros(0, np.int32)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.r_[none, False]), pa.array(flat, pa.int32()))
                    back = pa.array([None if x is None else encoder.decode(x) for x in own], batch.schema.field(at).type)
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, ids, back], names=[*batch.schema.names, "ids", "decoded"])
                    first, size = i + 1, 0
            if len(encoder) > CACHED:
                encoder.clear()

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    return map_rows(docs, run, schema)
