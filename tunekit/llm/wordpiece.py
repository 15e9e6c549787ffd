"""Token counts: greedy longest-match word pieces by a linear automaton, without making the pieces.

The trie of the vocabulary has a failure link and a number for each node: when no edge fits the next
character, the node's string is given up as that many longest-match pieces and matching goes on from
the node behind the link, which stands for the characters not yet used. Both are computed once from
the parent's, so a word takes time in proportion to its length, with no second look at a character.

Words are runs of letters and digits, and every other character that isn't white space; a word starts
with the vocabulary's word marker. A word that can't be covered by pieces counts as one unknown token.
A null or empty text has no words and no tokens. There is no limit on the length of a word. Rows are
counted one by one, so ties, repeated rows and null ids don't matter; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tunekit.llm.spark_tools import bounded_batches
from tunekit.llm.vocabulary import SPACE, Pieces

WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
CACHED = 1 << 18  # distinct words a task keeps the counts of
_UNKNOWN = 1 << 40


class Automaton:
    """Counts the pieces of a word; an unknown word counts as one piece and _UNKNOWN."""

    def __init__(self, pieces: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        whole = [False]
        order = []  # (parent, character, node), parents first
        for piece in sorted(pieces, key=len):
            node = 0
            for c in piece:
                nxt = self.edges[node].get(c)
                if nxt is None:
                    nxt = len(self.edges)
                    self.edges[node][c] = nxt
                    self.edges.append({})
                    whole.append(False)
                    order.append((node, c, nxt))
                node = nxt
            whole[node] = True
        depth = [0] * len(whole)
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        self.link: list[int] = [-1] * len(whole)
        self.popped = [0] * len(whole)
        for parent, c, node in sorted(order, key=lambda x: depth[x[2]]):
            if whole[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            back, n = self.link[parent], self.popped[parent]
            while back >= 0 and c not in self.edges[back]:
                n += self.popped[back]
                back = self.link[back]
            if back >= 0:
                self.link[node], self.popped[node] = self.edges[back][c], n

    def count(self, word: str) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = n = 0
        for c in word:
            while (nxt := edges[node].get(c)) is None:
                if link[node] < 0:
                    return _UNKNOWN + 1
                n += popped[node]
                node = link[node]
            node = nxt
        while node:
            if link[node] < 0:
                return _UNKNOWN + 1
            n += popped[node]
            node = link[node]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(SPACE + word)
        if len(word) < 64:
            self[word] = n
        return n


_built: dict[int, _Counts] = {}


def _counts(key: int, pieces: Pieces) -> _Counts:
    """One automaton and one cache per worker process and vocabulary."""
    if key not in _built:
        _built[key] = _Counts(Automaton([pieces.pieces[i] for i in pieces.normal()]))
    return _built[key]


def count_text(text: str | None, counts: _Counts) -> tuple[int, int, int]:
    words = WORD.findall(text or "")
    total = sum(map(counts.__getitem__, words))
    return len(words), total % _UNKNOWN, total // _UNKNOWN


def count_tokens(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """The rows with a struct column ``tokens`` of n_words, n_tokens and n_unknown; an input column of that name (in any case) is replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash(pieces)

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counted(texts):
        import pandas as pd

        counts = _counts(key, shared.value)
        rows = np.zeros((len(texts), 3), np.int64)
        for i, t in enumerate(texts):
            rows[i] = count_text(t, counts)
            if len(counts) > CACHED:
                counts.clear()
        return pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])

    return docs.withColumn("tokens", counted(F.col(f"`{text}`").cast("string")))
