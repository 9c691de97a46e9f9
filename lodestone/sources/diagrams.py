"""Folders of diagrams as a source and sink: ``register(spark)``, then ``spark.read.format("diagrams").load(root)`` and ``df.write.format("diagrams").mode("append").save(root)``.

Below ``root`` each folder holds diagrams, one a file.  Reading gives (folder, name, i, t): a row for each line, counted from 1.  Folders that begin with an underscore hold shared material and are left out,
as are files that begin with one or end otherwise than SUFFIXES.  A partition is up to FILES files of one folder (option ``files``), so a large folder is read by many tasks and a task holds one file.

Writing takes (folder, name, text), a file for each row.  A file is written beside its place and moved there, so a reader sees it whole, and a task that runs twice leaves the same bytes.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SUFFIXES = (".puml", ".plantuml")
FILES = 200
LINES = 8192


def filesystem(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    local = re.match(r"file:/*(/.*)$", path)
    return (fs.LocalFileSystem(), local[1] if local else path) if local or "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    folder: str
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, root: str, files: int):
        self.root, self.files = root, files

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = filesystem(self.root)
        below = lambda path: sorted(store.get_file_info(fs.FileSelector(path)), key=lambda x: x.base_name)
        out = []
        for folder in below(base):
            if folder.type == fs.FileType.Directory and not folder.base_name.startswith("_"):
                names = [x.base_name for x in below(folder.path) if x.type == fs.FileType.File and x.base_name.endswith(SUFFIXES) and not x.base_name.startswith("_")]
                out += [Files(folder.base_name, tuple(names[k : k + self.files])) for k in range(0, len(names), self.files)]
        return out or [Files("", ())]

    def read(self, partition: Files):
        import pyarrow as pa

        store, base = filesystem(self.root)
        for name in partition.names:
            with store.open_input_stream(f"{base.rstrip('/')}/{partition.folder}/{name}") as f:
                lines = f.read().decode("utf-8", "replace").splitlines()
            for k in range(0, len(lines), LINES):
                some = lines[k : k + LINES]
                yield pa.RecordBatch.from_arrays([pa.array([partition.folder] * len(some)), pa.array([name] * len(some)), pa.array(range(k + 1, k + len(some) + 1), pa.int32()), pa.array(some)], ["folder", "name", "i", "t"])


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows) -> WriterCommitMessage:
        store, base = filesystem(self.root)
        made = set()
        for row in rows:
            if not row.folder or not row.name or "/" in row.folder + row.name:
                raise ValueError(f"not the name of a folder and a file: {row.folder!r}, {row.name!r}")
            folder = f"{base.rstrip('/')}/{row.folder}"
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            staged = f"{folder}/_{uuid.uuid4().hex}"
            with store.open_output_stream(staged, compression=None) as f:
                f.write((row.text or "").encode())
            store.move(staged, f"{folder}/{row.name}")
        return WriterCommitMessage()


class Diagrams(DataSource):
    @classmethod
    def name(cls) -> str:
        return "diagrams"

    def schema(self) -> str:
        return "folder string, name string, i int, t string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("files", FILES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a folder of diagrams is only added to")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Diagrams)
