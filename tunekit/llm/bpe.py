"""Byte-level BPE: ids of whole texts by a local rank file, and the bytes they stand for.

Ids come from the tiktoken library, which cuts a text into matches of the pattern and merges each match
by rank. Its matcher keeps a stack entry for every character of a run of white space and fails at about
a million of them, and a long text would be held several times over. So a text of more than ``SEGMENT``
characters is cut first, and only where the pattern ends a match whatever stands around:

* before white space that follows anything else (white space only ever starts a match, or is all of it);
* between an ASCII letter and an ASCII digit, either way;
* between either of these and ASCII punctuation that follows (but not the other way: ``'s`` is one match).

A run of ``RUN`` or more white-space characters in such a text is one match but for its last character,
which belongs to what follows (at the end of the text it is all one match); it is merged by itself, with
no matcher. A part without any such place (one word of any length) stays whole. These rules hold for
``public_tokenizers.PATTERN`` and patterns that end matches at the same places; pass ``cut=False`` with
any other.

Decoding joins the bytes of the ids; it gives every text back exactly. A null text is an empty text: no
ids and no bytes. Bytes that aren't UTF-8 become U+FFFD before encoding. Strings of special tokens are
ordinary text. Rows are coded one by one, so ties, repeated rows and null ids don't matter, and an empty
table gives an empty result. Input columns named like the two results (in any case) are replaced; all
others stay, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from tunekit.functions.arrays import quoted
from tunekit.llm.spark_tools import bounded_batches

SEGMENT = 1 << 16
RUN = 1 << 10
_DECODED = 1 << 18  # ids decoded at a time

# The characters that the pattern's \s stands for.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(
    f"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\\[-`{{-~])"
)
_RUNS = re.compile(f"[{_WHITE}]{{{RUN},}}")


def segments(text: str) -> Iterator[tuple[str, bool]]:
    """The parts of a text that can be coded apart, and whether one is a single match."""
    n, at = len(text), 0
    while at < n:
        cut = _CUT.search(text, at + SEGMENT) if n - at > SEGMENT else None
        end = cut.start() if cut else n
        if end - at > SEGMENT // 2:
            for run in _RUNS.finditer(text, at, end):
                first, stop = run.start(), run.end() if run.end() == n else run.end() - 1
                if first > at:
                    yield text[at:first], False
                yield text[first:stop], True
                at = stop
        if end > at:
            yield text[at:end], False
        at = end


@dataclass(frozen=True)
class Ranks:
    """Content of a rank file (a base64 piece and its rank a line) and the pattern that goes before it."""

    table: bytes
    pattern: str
    cut: bool = True

    def key(self) -> str:
        return hashlib.sha256(self.table + b"\0" + self.pattern.encode() + bytes([self.cut])).hexdigest()


def read_ranks(path: str, pattern: str, cut: bool = True) -> Ranks:
    """Reads a rank file on the driver; tasks get it by broadcast (a vocabulary is a fixed file of about a megabyte)."""
    with open(path, "rb") as file:
        return Ranks(file.read(), pattern, cut)


class Coder:
    def __init__(self, ranks: Ranks):
        import tiktoken

        self.cut = ranks.cut
        self.table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks.table.splitlines()) if piece}
        self.by_match = tiktoken.Encoding("by match", pat_str=ranks.pattern, mergeable_ranks=self.table, special_tokens={})
        self.whole = None

    def _match(self, part: str) -> np.ndarray:
        """Ids of a part that is one match."""
        if self.whole is None:
            import tiktoken

            self.whole = tiktoken.Encoding("whole", pat_str="[^\\x00]+|\\x00+", mergeable_ranks=self.table, special_tokens={})
        return np.array(self.whole.encode_ordinary(part), np.int32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= SEGMENT or not self.cut:
            return np.array(self.by_match.encode_ordinary(text), np.int32)
        parts = [self._match(p) if single else np.array(self.by_match.encode_ordinary(p), np.int32) for p, single in segments(text)]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.by_match.decode_bytes(ids[i : i + _DECODED].tolist()) for i in range(0, len(ids), _DECODED))


_built: dict[str, Coder] = {}


def _coder(key: str, ranks: Ranks) -> Coder:
    """The coder of the last ranks used in this worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Coder(ranks)
    return _built[key]


def encode(docs: DataFrame, ranks: Ranks, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with ``ids`` (array of int) and ``decoded`` (the bytes that the ids stand for)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, key = spark.sparkContext.broadcast(ranks), ranks.key()
    result = StructType().add(ids, ArrayType(IntegerType())).add(decoded, BinaryType())

    @F.arrow_udf(result)
    def coded(texts: pa.Array) -> pa.Array:
        coder = _coder(key, shared.value)
        rows, back = [], []
        for t in texts:
            found = coder.encode(t.as_py() or "")
            rows.append(found)
            back.append(coder.decode(found))
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(back, pa.binary())], names=[ids, decoded])

    kept = [quoted(c) for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]
    whole = F.make_valid_utf8(F.col(f"`{text}`").cast("string"))
    packed = docs.select(F.struct(*kept).alias("row") if kept else F.struct(F.lit(1)).alias("row"), coded(whole).alias("coded"))
    return packed.select(*(["row.*"] if kept else []), "coded.*")
