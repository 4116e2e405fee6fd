"""Zip archives of texts as a Python data source (`archives`), and tables of contents unnested by a table function."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.functions import udtf

from textloom.shipping import ship

SCHEMA = "path string, ord int, name string, content binary"
#: Archives are dealt out by size: a partition ends at so many bytes, unless one archive is larger.
PARTITION_BYTES = 64 << 20


def _open(uri: str):
    """The file system and the path of an address; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class _Archives(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, uri: str, suffix: str):
        self.uri, self.suffix = uri, suffix

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = _open(self.uri)
        found = sorted((f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")))
        out, size = [[]], 0
        for p, n in found:
            if out[-1] and size + n > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(p)
            size += n
        return [_Archives(tuple(g)) for g in out]

    def read(self, partition: _Archives) -> Iterator[tuple]:
        store, _ = _open(self.uri)
        for path in partition.paths:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for i, name in enumerate(z.namelist()):
                    yield path, i, name, z.read(name)


class _Writer(DataSourceWriter):
    """Each task writes an archive of its own beside the place; those of the tasks that count are renamed when all are done."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite = uri, overwrite

    def write(self, rows) -> _Written:
        store, path = _open(self.uri)
        store.create_dir(path, recursive=True)
        name, n = f"_{uuid.uuid4().hex}.tmp", 0
        with store.open_output_stream(f"{path}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(zipfile.ZipInfo(r["name"]), bytes(r["content"]), zipfile.ZIP_DEFLATED)
                n += 1
        return _Written(name, n)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, path = _open(self.uri)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path, recursive=False)):
                if f.base_name.endswith(".zip"):
                    store.delete_file(f.path)
        for m in messages:
            if m and m.rows:
                store.move(f"{path}/{m.name}", f"{path}/part-{m.name[1:-4]}.zip")
            elif m:
                store.delete_file(f"{path}/{m.name}")

    def abort(self, messages: list[_Written | None]) -> None:
        store, path = _open(self.uri)
        for m in messages:
            if m:
                store.delete_file(f"{path}/{m.name}")


class ArchiveSource(DataSource):
    """Members of zip archives under a path as rows: path, ord (place in the archive), name, content. Option suffix: `.zip` unless set (`.epub` for books).

    An archive is opened by one task and its members are read one by one; archives are dealt over tasks by size. Writing takes name and content; a task's rows become one archive.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".zip"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


@udtf(returnType="ord int, depth int, title string, href string")
class _Contents:
    def eval(self, tree: str):
        try:
            found = json.loads(tree or "[]")
        except ValueError:
            return
        stack, ord_ = [(0, x) for x in reversed(found if isinstance(found, list) else [found])], 0
        while stack:
            depth, x = stack.pop()
            if isinstance(x, dict):
                if x.get("title") or x.get("href"):
                    yield ord_, depth, x.get("title") or "", x.get("href") or ""
                    ord_ += 1
                stack += [(depth + 1, c) for c in reversed(x.get("children") or [])]


def register(spark: SparkSession) -> None:
    """The data source `archives` and the table function `flatten_contents` in a session."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    spark.udtf.register("flatten_contents", _Contents)


def flatten_contents(books: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """(keys..., ord, depth, title, href) of nested contents in JSON ({title, href, children}), depth first. Entries without title and href only hold their children; invalid or null trees give no rows."""
    register(books.sparkSession)
    books.createOrReplaceTempView("__contents")
    return books.sparkSession.sql(f"SELECT {', '.join(f'b.`{k}`' for k in keys)}, c.* FROM __contents b, LATERAL flatten_contents(b.`{tree}`) c")
