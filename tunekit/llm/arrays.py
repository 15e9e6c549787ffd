"""Texts of an Arrow column as byte arrays, and rolling hashes over them.

Hashes are 64-bit and the same in every process: fixed odd multipliers, a table of mixed byte values
and arithmetic modulo 2**64. A polynomial hash of the bytes s..e-1 comes from prefix sums, so that
all substrings of a piece cost one subtraction and one product each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
LONG_WORD = 1 << 8  # longer words are hashed by BLAKE2: modulo 2**64, some words of 1,024 letters collide for every base
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def constants(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt)) | np.uint64(1)


BYTE_VALUES = constants(256, 7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWERED_VALUES = BYTE_VALUES[LOWER]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


class Substrings:
    """Hashes of substrings of one piece of bytes."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, q: int) -> np.ndarray:
        """The hash of every substring of q bytes."""
        n = len(self.sums) - q
        return (self.sums[q:] - self.sums[:n]) * self.down[:n] if n > 0 else self.sums[:0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]] if len(ends) else whole[:0], ends - ends[0]


def groups(ends: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most size bytes together, or one longer row."""
    row, n = 0, len(ends) - 1
    while row < n:
        last = int(np.searchsorted(ends, ends[row] + size, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield row, last
        row = last


def _words_of_piece(data: np.ndarray, breaks: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word and its hash; words end at white space and at breaks (row starts)."""
    inside = ~separator[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cuts = breaks[breaks < len(data)]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = mix(Substrings(data, LOWERED_VALUES).of(start, end))
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = _long_word(data[start[i] : end[i]])
    return start, hashes


def _long_word(data: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(LOWER[data].tobytes(), digest_size=8).digest(), "little")


def word_hashes(data: np.ndarray, ends: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without separators, by default ASCII white space; A-Z lower-cased) and, per row, where its words begin.

    Rows longer than a piece are cut at white space, so memory follows the number of words.
    """
    if len(ends) > 2 or len(data) <= PIECE:
        start, hashes = _words_of_piece(data, ends[:-1], separator) if len(data) else (ends[:0], BYTE_VALUES[:0])
        return hashes, np.searchsorted(start, ends)
    found, at = [], 0
    none = np.zeros(1, dtype=np.int64)
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            spaces = np.flatnonzero(separator[data[at:end]])
            if len(spaces) and spaces[-1] > 0:
                end = at + int(spaces[-1])
            else:  # one word fills the piece: go on to its end
                while end < len(data) and not len(spaces := np.flatnonzero(separator[data[end : end + PIECE]])):
                    end = min(end + PIECE, len(data))
                end += int(spaces[0]) if end < len(data) else 0
        piece = data[at:end]
        if len(piece) > PIECE:
            piece = piece[1:] if separator[piece[0]] else piece
            found.append(np.array([_long_word(piece)], dtype=np.uint64))
        else:
            found.append(_words_of_piece(piece, none, separator)[1])
        at = end
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    n, span = len(x) - w + 1, 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])
