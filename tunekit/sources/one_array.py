"""A dataset as one JSON array: a directory whose files, joined in order of their names, are the array.

Tasks write their rows side by side, each file without knowing of the others: the first partition begins
with ``[``, every other one with a comma. What they can't know is which of them have rows; their commit
messages tell it, and the driver then gives the files their places: empty ones are left out, a closing
``]`` comes last, and where the first partition was empty the first file with rows is copied with ``[`` in
place of its comma. Until then everything lies in a folder of its own that readers skip, and a failed
job removes it; of several attempts of a task only the one that reported counts.

Files are written through pyarrow, so the path may be local or shared, or in a store that pyarrow knows (s3,
gs, abfs, hdfs). For others, ``write_json`` writes an array a file with Spark's own writer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tunekit.functions.arrays import quoted
from tunekit.sources.shared import bounded_batches

NAME = "tunekit_json_array"
_COPIED = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    if ":/" in path:
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    return fs.LocalFileSystem(), path


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def _staged(self) -> tuple[fs.FileSystem, str, str]:
        store, target = place(self.path)
        return store, target, f"{target}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        store, _, staged = self._staged()
        store.create_dir(staged, recursive=True)
        file = f"{staged}/{task.partitionId()}-{task.taskAttemptId()}"
        rows = 0
        with store.open_output_stream(file) as out:
            for batch in iterator:
                for text in batch.column(0).cast(pa.binary()):
                    out.write(b",\n" if rows else b"[" if task.partitionId() == 0 else b",")
                    out.write(text.as_buffer())
                    rows += 1
        return Part(task.partitionId(), file, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, target, staged = self._staged()
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        if self.overwrite:
            old = [f for f in store.get_file_info(fs.FileSelector(target, allow_not_found=True)) if f.base_name != "_temporary"]
            for f in old:
                store.delete_file(f.path) if f.is_file else store.delete_dir(f.path)
        if parts and parts[0].partition:
            self._open(store, parts[0].file)
        for i, part in enumerate(parts):
            store.move(part.file, f"{target}/part-{i:06d}.json")
        with store.open_output_stream(f"{target}/part-{len(parts):06d}.json") as out:
            out.write(b"]" if parts else b"[]")
        store.delete_dir(f"{target}/_temporary")
        with store.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def _open(self, store: fs.FileSystem, file: str) -> None:
        """Puts the opening bracket in place of the comma that a file begins with."""
        with store.open_input_stream(file) as old, store.open_output_stream(f"{file}-first") as new:
            old.read(1)
            new.write(b"[")
            while data := old.read(_COPIED):
                new.write(data)
        store.move(f"{file}-first", file)

    def abort(self, messages: list[Part | None]) -> None:
        store, target, staged = self._staged()
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)
        left = store.get_file_info(fs.FileSelector(target, recursive=True, allow_not_found=True))
        if left and all(f.path.rsplit("/", 1)[-1] == "_temporary" for f in left):
            store.delete_dir(target)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], self.options.get("replace") == "true")


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists", nulls: bool = True) -> None:
    """All rows as one array, in order of the partitions; without ``nulls`` NULL fields are left out.

    An array can't be appended to, so ``mode`` is ``errorifexists`` or ``overwrite``. A dataset without rows
    is an empty array.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("a JSON array is written whole: mode must be errorifexists or overwrite")
    store, target = place(path)
    if mode == "errorifexists" and store.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} already exists")
    df.sparkSession.dataSource.register(ArraySource)
    bounded_batches(df.sparkSession)
    row = F.struct(*[quoted(c) for c in df.columns])
    text = df.select(F.to_json(row, {"ignoreNullFields": str(not nulls).lower()}).alias("value"))
    text.write.format(NAME).mode("append").option("path", path).option("replace", str(mode == "overwrite").lower()).save()
