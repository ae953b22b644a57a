"""Named documents as files: one file a document in one folder a task, through Spark's data source writer.

A task attempt writes below ``_pending``; a job that succeeds moves the folder of each successful attempt to its place, one rename a task,
and drops the rest.  So what a failed, repeated or killed task has written is never seen, and a failed job leaves nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "webloom_documents"
LONGEST = 200  # bytes of a file name; longer ones are cut and told apart by a hash
BATCH_ROWS, BATCH_CHARS = 1_000, 8_000_000  # files that a reading task hands on at once, at most
DROPPING = 16  # folders that a commit drops at once


def safe_name(name: str | None) -> str:
    """A file name for any text: slashes, percent signs, control characters and names of folders spelled with %, long names cut and hashed."""
    text = "".join(f"%{ord(c):02X}" if c in "/%\\" or ord(c) < 32 else c for c in name or "")
    text = text.replace(".", "%2E", 1) if text.startswith(".") else "%5F" + text[1:] if text.startswith("_") else text or "%"
    held = text.encode()
    if len(held) <= LONGEST:
        return text
    return held[: LONGEST - 33].decode(errors="ignore") + "-" + hashlib.sha256(held).hexdigest()[:32]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str  # of the attempt, below the pending folder
    files: int


class DocumentsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _pending(self) -> str:
        return f"_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _at(self.path)
        folder, n = f"{root}/{self._pending()}/{uuid.uuid4().hex}", 0
        store.create_dir(folder)
        for batch in iterator:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{folder}/{safe_name(name)}") as out:
                    out.write((content or "").encode())
                n += 1
        return Written(folder.rsplit("/", 1)[1], n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _at(self.path)
        store.create_dir(root)
        if self.overwrite:
            held = store.get_file_info(fs.FileSelector(root))
            with ThreadPoolExecutor(DROPPING) as pool:
                list(pool.map(store.delete_dir, [f.path for f in held if f.type == fs.FileType.Directory and f.base_name.startswith("documents-")]))
        for k, done in enumerate(m for m in messages if m is not None and m.files):
            store.move(f"{root}/{self._pending()}/{done.folder}", f"{root}/documents-{self.job[:8]}-{k:05d}")
        self._drop(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*_at(self.path))

    def _drop(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self._pending()}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self._pending()}")


class DocumentsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DocumentsWriter:
        return DocumentsWriter(self.options["path"], overwrite)


def write_named(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """(file, content) as one UTF-8 file a row below ``path``, named by ``file`` as ``safe_name`` spells it; null content is an empty file.

    Names should differ (``crawl.crawl_documents`` sees to that); of equal ones in one task the last counts.  ``path`` is a folder or URI that
    every executor reaches and whose file system can rename a folder.
    """
    df.sparkSession.dataSource.register(DocumentsSource)
    df.select(F.col("file").cast("string"), F.col("content").cast("string")).write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files below a folder of ``write_named``; one of them is a row, empty ones are none.

    A task lists and reads the folder that a task has written, so neither the list of files nor a job over them passes through the driver.
    """
    store, root = _at(path.rstrip("/"))
    # a path as the writer was given it; what Spark's readers hide stays hidden
    held = [f for f in store.get_file_info(fs.FileSelector(root)) if not _hidden(f.base_name)]
    tops = [(f.base_name, f.type == fs.FileType.Directory) for f in held]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _at(path.rstrip("/"))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, is_folder = tops[k]
                yield from _in_batches(_files(store, f"{root}/{name}", is_folder))

    files = spark.range(len(tops), numPartitions=max(len(tops), 1)).mapInArrow(read, "file STRING, content STRING")
    return files.select(_decoded(F.col("file")).alias("file"), "content")


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def _files(store: fs.FileSystem, at: str, is_folder: bool) -> Iterator[tuple[str, str]]:
    """(name, content) of a file, or of all files below a folder."""
    found = store.get_file_info(fs.FileSelector(at)) if is_folder else [store.get_file_info(at)]
    for f in found:
        if is_folder and _hidden(f.base_name):
            continue
        if f.type == fs.FileType.Directory:
            yield from _files(store, f.path, True)
        elif f.size:
            with store.open_input_stream(f.path) as source:
                yield f.base_name, source.read().decode(errors="replace")


def _in_batches(files: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for file, content in files:
        rows.append((file, content))
        size += len(content)
        if len(rows) == BATCH_ROWS or size > BATCH_CHARS:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["file", "content"])


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
