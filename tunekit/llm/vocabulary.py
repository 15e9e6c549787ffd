"""Pieces of a public tokenizer's model file, read on the driver; tasks get them by broadcast.

A vocabulary is a fixed file of a few megabytes at most, so its broadcast doesn't grow with the data.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cache

SPACE = "▁"
TOKENIZERS = os.environ.get("TUNEKIT_TOKENIZERS", "/opt/tokenizers")


@dataclass(frozen=True)
class Pieces:
    """Pieces by id with their scores; ids of byte pieces by byte; ids that stand for no text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]
    silent: frozenset[int]

    def normal(self) -> list[int]:
        skip = self.silent | set(self.bytes_)
        return [i for i in range(len(self.pieces)) if i not in skip and self.pieces[i]]


@cache
def read_pieces(path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> Pieces:
    """The pieces of a SentencePiece model file; only its table is read, encoding is done here."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    by_byte = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    return Pieces(
        tuple(model.id_to_piece(i) for i in ids),
        tuple(model.get_score(i) for i in ids),
        tuple(by_byte[f"<0x{b:02X}>"] for b in range(256)) if len(by_byte) == 256 else (),
        frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)),
    )
