"""A data source that writes files under names of their own, one job's files all or none.

    spark.dataSource.register(NamedFiles)
    df.select("name", "data").write.format("named_files").option("atOnce", at_once).mode("append").save(folder)

Rows are (name, data): a path below the folder and text or bytes, added to that file in the order of rows; of a third
column, ``head``, the text in a file's first row goes before it. Each task writes to a folder of its own attempt; the commit on the driver moves the files of the attempts that counted, so a
task that is lost or run twice leaves nothing. One file's rows must be in one task (see ``write_named``).
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import open_store


@dataclass
class WrittenFiles(WriterCommitMessage):
    folder: str
    names: list[str]


class DuplicateFile(ValueError):
    """Two tasks wrote rows of the same file."""


def _inner(name: str) -> str:
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a file name: {name!r}")
    return "/".join(parts)


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        get = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite, self.at_once = get["path"], overwrite, int(get.get("atonce", 1))
        self.attempts = f"_attempt-{uuid.uuid4().hex}-"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        store, root = open_store(self.path)
        folder = f"{root.rstrip('/')}/{self.attempts}{uuid.uuid4().hex}"
        try:
            return WrittenFiles(folder, list(self.files(store, folder, iterator, self.at_once)))
        except BaseException:
            if store.get_file_info(folder).type == pafs.FileType.Directory:
                store.delete_dir(folder)
            raise

    @staticmethod
    def files(store: pafs.FileSystem, folder: str, iterator: Iterator[pa.RecordBatch], at_once: int = 1) -> Iterator[str]:
        """Writes the rows of one task; the names of its files, of which ``at_once`` stay open, those last written to."""
        out, seen = {}, set()
        try:
            for batch in iterator:
                heads = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
                for name, data, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), heads):
                    name = _inner(name)
                    file = out.pop(name, None)
                    if file is None:
                        if len(out) >= at_once:
                            out.pop(next(iter(out))).close()
                        if name in seen:
                            raise DuplicateFile(f"the rows of {name} aren't together")
                        store.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                        file = store.open_output_stream(f"{folder}/{name}", compression=None)
                        file.write((head or "").encode())
                        seen.add(name)
                        yield name
                    out[name] = file
                    if data is not None:
                        file.write(data.encode() if isinstance(data, str) else data)
        finally:
            for file in out.values():
                file.close()

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        store, root = open_store(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise DuplicateFile("two tasks wrote the same file")
        if self.overwrite and store.get_file_info(root).type == pafs.FileType.Directory:
            for info in store.get_file_info(pafs.FileSelector(root)):
                if not info.base_name.startswith(self.attempts):
                    (store.delete_dir if info.type == pafs.FileType.Directory else store.delete_file)(info.path)
        for folder in {f"{root.rstrip('/')}/{n}".rsplit("/", 1)[0] for n in names}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(*x), ((f"{m.folder}/{n}", f"{root.rstrip('/')}/{n}") for m in done for n in m.names)))
        self.clear(store, root)

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        self.clear(*open_store(self.path))

    def clear(self, store: pafs.FileSystem, root: str) -> None:
        """Removes this job's attempts; those of a task that is still being stopped have a name that readers pass over."""
        if store.get_file_info(root).type == pafs.FileType.Directory:
            for info in store.get_file_info(pafs.FileSelector(root)):
                if info.base_name.startswith(self.attempts):
                    store.delete_dir(info.path)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, data string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options, overwrite)


def write_named(rows: DataFrame, path: str, order: list[str] | None = None, overwrite: bool = False, together: bool = True, at_once: int = 1) -> None:
    """Writes ``rows`` (name, data, maybe head, and the columns of ``order``) to files below ``path``.

    With ``together`` rows are dealt by name and sorted by name, then ``order``, so a file is written by one task as its
    rows stream by. Without it nothing is shuffled or sorted: a file's rows must be in one task and, unless the task's
    files are at most ``at_once``, which it then holds open, next to each other.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    if together:
        rows = rows.repartition(F.col("name")).sortWithinPartitions("name", *(order or []))
    columns = [c for c in ("name", "data", "head") if c in rows.columns]
    rows.select(*columns).write.format("named_files").option("atOnce", at_once).mode("overwrite" if overwrite else "append").save(path)


def packed_rows(rows: DataFrame) -> DataFrame:
    """(name, data) of ``rows`` (name, value): each text as gzip data, the same in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([gzip.compress((x or "").encode(), mtime=0) for x in batch.column(1).to_pylist()], pa.binary())], names=["name", "data"])

    return rows.select("name", "value").mapInArrow(run, "name string, data binary")
