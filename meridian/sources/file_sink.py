"""A sink of whole files: all of a job's files are published when all are there, or none.

Each task attempt puts its files into a staging folder of the job under names of its own; the driver
moves those of the attempts that succeeded to their places when the job commits, and removes the staging
folder then or when the job is aborted. A reader sees no half-written file, a repeated or failed attempt
leaves none, and a file that was there before stays until its successor is complete. Any store will do
that pyarrow opens by its URI.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from meridian.session import store


@dataclass
class Staged(WriterCommitMessage):
    """(name, name in the staging folder) of the files of one task."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, folder = store(self.folder)
        task, done = TaskContext.get().taskAttemptId(), []
        for row in iterator:
            if not row.name or row.name.startswith(("_", ".", "/")) or ".." in row.name:
                raise ValueError(f"not a name for a file: {row.name!r}")
            staged = f"{row.name}.{task}"
            fs.create_dir(f"{folder}/{self.staging}", recursive=True)
            with fs.open_output_stream(f"{folder}/{self.staging}/{staged}", compression=None) as out:
                out.write(row.content)
            done.append((row.name, staged))
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, folder = store(self.folder)
        fs.create_dir(folder, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for name, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("two files of one name")
        for name, staged in files:
            fs.move(f"{folder}/{self.staging}/{staged}", f"{folder}/{name}")
        with fs.open_output_stream(f"{folder}/_SUCCESS", compression=None):
            pass
        self._clean(fs, folder)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*store(self.folder))

    def _clean(self, fs, folder: str) -> None:
        from pyarrow.fs import FileType

        place = f"{folder}/{self.staging}"
        if fs.get_file_info(place).type != FileType.NotFound:
            fs.delete_dir(place)


class FileSink(DataSource):
    """(name, content) rows as files of the folder that ``path``, with its scheme, names."""

    @classmethod
    def name(cls) -> str:
        return "grid_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"))
