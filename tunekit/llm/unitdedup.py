"""Line or paragraph deduplication: equal normalised units are kept once, where they rank first.

A text is cut into units at line breaks (or at blank lines, for paragraphs), and a unit of more than one
sentence is also cut into its sentences, so that a passage set into the middle of a line is found too.
A unit's key is the 128-bit digest of its text in lower case with runs of white space as one space. Of
all units with one key the earliest by (doc_id, offset) stays and the others go, whole units and
sentences each among their like; a unit of one sentence counts as a sentence. Units of fewer than
``MIN_WORDS`` words are no copies of each other, as such lines are equal by chance or are structure;
they go only as part of a unit that goes. Offsets of removed spans are those of the original text, in
characters.

Keys are 128-bit digests. A task reports at once the copies it sees of a key it has at an earlier place
too, and sends only the first place of each key on, packed by the key's shard, so a line that a third of
all texts hold comes at most once from each block of texts. Texts are shuffled only where something goes.

A null text is empty. Rows with a null ``doc_id`` have no rank: all their units stay, and they are no
copies' first place. Rows that share a ``doc_id`` count as one text given more than once: what goes
from one goes from the others at the same offsets. Other columns of the input are kept as they are,
whatever their names; one named like the result is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.llm.places import FOUND_DDL, by_document, dealt, interval_rows, merged, sorted_places, spread, unpacked
from tunekit.llm.spark_tools import bounded_batches, fresh, map_rows, maybe_member, membership, partitions, stage, without

MIN_WORDS = 5
HELD = 400_000
_GAPS = re.compile(r"[ \t\n\r\f\v]+")
_SENTENCE = re.compile(r"[^.!?]*[.!?]+[ \t]*|[^.!?]+")
_CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r\f\v]*\n\s*")}
_PLACE = np.dtype([("bucket", "u8"), ("rest", "u8"), ("doc", "i8"), ("start", "u4"), ("more", "u4")])
_NAME = ["bucket", "rest"]
_END = lambda x: x["start"].astype(np.int64) + x["more"]


def units(text: str, kind: str) -> list[tuple[int, int]]:
    """Start and end of every unit of a text."""
    out, at = [], 0
    for m in _CUTS[kind].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def digest(unit: str, mark: str) -> bytes | None:
    """The unit's key; None if it has too few words."""
    words = [w for w in _GAPS.split(unit.lower()) if w]
    if len(words) < MIN_WORDS:
        return None
    return hashlib.blake2b((mark + " ".join(words)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def keyed_units(text: str, kind: str) -> list[tuple[bytes, int, int]]:
    """Key, start and end of every unit, and of every sentence of a unit that has more than one."""
    out = []
    for start, end in units(text, kind):
        sentences = [(start + m.start(), start + m.end()) for m in _SENTENCE.finditer(text[start:end])]
        if len(sentences) > 1:
            key = digest(text[start:end], "unit ")
            if key is not None:
                out.append((key, start, end))
        for s, e in sentences:
            key = digest(text[s:e], "sentence ")
            if key is not None:
                out.append((key, s, e))
    return out


def _places(found: list[tuple[bytes, int, int, int]]) -> np.ndarray:
    x = np.empty(len(found), dtype=_PLACE)
    names = np.frombuffer(b"".join(f[0] for f in found), np.uint64).reshape(-1, 2)
    x["bucket"], x["rest"] = names[:, 0], names[:, 1]
    x["doc"], x["start"] = [f[1] for f in found], [f[2] for f in found]
    x["more"] = [f[3] - f[2] for f in found]
    return x


def _keyed(kind: str, shards: int):
    def run(batches):
        found: list[tuple[bytes, int, int, int]] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if doc is not None and text:
                    found += [(key, doc, start, end) for key, start, end in keyed_units(text, kind)]
                if len(found) > HELD:
                    yield from dealt(_places(found), _NAME, shards, _END)
                    found = []
        if found:
            yield from dealt(_places(found), _NAME, shards, _END)

    return run


def _later_copies(batches):
    held = []
    for batch in batches:
        done = batch.filter(batch.column("packed").is_null())
        if len(done):
            yield done
        held += unpacked(batch, _PLACE)
    if held:
        x, copy = sorted_places(np.concatenate(held), _NAME)
        yield from interval_rows(x["doc"][copy], x["start"][copy], _END(x[copy]), False)


def repeated_units(docs: DataFrame, kind: str = "line") -> DataFrame:
    """Intervals (doc_id, start, end) of everything that goes, of (doc_id, text); they may overlap."""
    shards = partitions(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    placed = docs.select("doc_id", "text").mapInArrow(_keyed(kind, shards), FOUND_DDL)
    gone = spread(placed, shards).mapInArrow(_later_copies, FOUND_DDL)
    return stage(gone.select("doc_id", "start", "end"), "units-gone")


def without_spans(text: str, spans: list[tuple[int, int]], kind: str) -> str:
    """The text without sorted disjoint spans; a unit that goes whole takes its line break along."""
    kept, k = [], 0
    for start, end in units(text, kind):
        part, at, cut = [], start, False
        while k < len(spans) and spans[k][0] < end:
            s, e = spans[k]
            part.append(text[at:s])
            at, cut, k = e, True, k + 1
        rest = "".join([*part, text[at:end]])
        if rest or not cut:
            kept.append(rest)
    return ("\n" if kind == "line" else "\n\n").join(kept)


def _without(names: list[str], text_at: int, kind: str):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            kept, gone = [], []
            starts, ends = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for i, text in enumerate(batch.column(text_at)):
                text, spans = text.as_py(), []
                if starts[i].is_valid and text:
                    s, e = (np.asarray(c[i].values.to_numpy(zero_copy_only=False), np.int64) for c in (starts, ends))
                    inside = e <= len(text)
                    _, s, e = merged(np.zeros(int(inside.sum()), np.int64), s[inside], e[inside]) if inside.any() else (s[:0],) * 3
                    spans = list(zip(s.tolist(), e.tolist()))
                kept.append(without_spans(text, spans, kind) if spans else text)
                gone.append([{"start": a, "end": b} for a, b in spans])
            columns = list(batch.columns[:-2])
            columns[text_at] = pa.array(kept, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, spans_type)], names=names)

    return run


def without_repeated_units(docs: DataFrame, kind: str = "line", spans: str = "removed_spans") -> DataFrame:
    """The rows with repeated units taken out of ``text``; a new last column has the removed spans of the original."""
    docs = without(docs, spans).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    doc, starts, ends = (fresh(docs, x) for x in ("__doc", "__starts", "__ends"))
    gone = repeated_units(docs, kind)
    filtered = membership(gone, "doc_id")
    by_doc = by_document(gone).select(F.col("doc_id").alias(doc), F.col("starts").alias(starts), F.col("ends").alias(ends))
    touched = maybe_member(docs, "doc_id", filtered)
    joined = touched.join(by_doc.hint("shuffle_hash"), touched["doc_id"] == F.col(doc), "left").drop(doc)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = maybe_member(docs, "doc_id", filtered, member=False).withColumn(spans, none)
    cut = map_rows(joined, _without([*docs.columns, spans], docs.columns.index("text"), kind), whole.schema)
    return cut.unionAll(whole)
