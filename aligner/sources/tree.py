"""Experiment trees as a data source: ``spark.read.format("run_tree").load(root)`` gives ``(path, content)``.

A partition is a bucket of the run and trace folders of some experiments; its task lists and reads them, so that the driver only lists the
experiments and one with most of the runs is spread. A metric series may have grown for long and only its last line counts: it is read from
its end.

An archive (``*.tar.gz``) beside the experiments stands for its files as if they were unpacked there: small files cost their bytes, not a
block and a folder each. An archive is a partition and is read once from front to end, a file at a time.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zlib
from collections.abc import Iterator
from typing import IO, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, content string"
# Folder names of the layout.
TRACES = "traces"
SERIES = "metrics"
ARCHIVE = ".tar.gz"

#: Experiments per group, and buckets that the folders of a group are dealt out to.
GROUP = 64
BUCKETS = 4
_BLOCK = 1 << 16


#: Rows and bytes of a batch of archived files, and bytes that are unpacked ahead.
_ROWS, _BYTES, _BUFFER = 1 << 12, 1 << 22, 1 << 18
_RECORD = 512


class Bucket(InputPartition):
    """Folders of some experiments whose names fall in one bucket; the first bucket also reads the files beside them."""

    def __init__(self, experiments: list[str], bucket: int) -> None:
        super().__init__((tuple(experiments), bucket))
        self.experiments, self.bucket = experiments, bucket


class Archive(InputPartition):
    """All files of an archive."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class RunTree(DataSource):
    """Options: ``path``; ``group`` and ``buckets`` (see above); ``names_only``, a folder name below which files are listed, their content null."""

    @classmethod
    def name(cls) -> str:
        return "run_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RunTreeReader:
        return RunTreeReader(self.options["path"], int(self.options.get("group", GROUP)), int(self.options.get("buckets", BUCKETS)),
                             self.options.get("names_only"))


class RunTreeReader(DataSourceReader):
    def __init__(self, root: str, group: int, buckets: int, names_only: str | None) -> None:
        self.root, self.group, self.buckets, self.names_only = root, group, buckets, names_only

    def partitions(self) -> list[Bucket | Archive]:
        system, root = fs.FileSystem.from_uri(self.root)
        children = sorted(system.get_file_info(fs.FileSelector(root)), key=lambda c: c.path)
        folders = [c.path for c in children if c.type == fs.FileType.Directory]
        groups = [folders[i:i + self.group] for i in range(0, len(folders), self.group)]
        archives = [Archive(c.path) for c in children if c.type == fs.FileType.File and c.path.endswith(ARCHIVE)]
        return [Bucket(g, b) for g in groups for b in range(self.buckets)] + archives or [Bucket([], 0)]

    def read(self, partition: Bucket | Archive) -> Iterator[tuple[str, str | None] | pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        if isinstance(partition, Archive):
            yield from self._packed(system, partition.path)
            return
        for experiment in partition.experiments:
            for item in self._own(system, experiment, partition.bucket):
                inner = [item] if item.type == fs.FileType.File else system.get_file_info(fs.FileSelector(item.path, recursive=True))
                for file in inner:
                    if file.type == fs.FileType.File:
                        yield file.path, self._content(system, file, experiment)

    def _own(self, system: fs.FileSystem, folder: str, bucket: int) -> Iterator[fs.FileInfo]:
        for child in system.get_file_info(fs.FileSelector(folder)):
            if child.type == fs.FileType.Directory and child.base_name == TRACES:
                yield from self._own(system, child.path, bucket)
            elif (zlib.crc32(child.base_name.encode()) % self.buckets if child.type == fs.FileType.Directory else 0) == bucket:
                yield child

    def _packed(self, system: fs.FileSystem, archive: str) -> Iterator[pa.RecordBatch]:
        """The files of an archive in batches: a row each would cost more than reading it."""
        folder, paths, contents, held = posixpath.dirname(archive), [], [], 0
        for name, content in self._members(system, archive):
            paths.append(f"{folder}/{name}")
            contents.append(None if content is None else content.decode("utf-8", "replace"))
            held += len(content or b"")
            if len(paths) >= _ROWS or held >= _BYTES:
                yield _batch(paths, contents)
                paths, contents, held = [], [], 0
        if paths:
            yield _batch(paths, contents)

    def _members(self, system: fs.FileSystem, archive: str) -> Iterator[tuple[str, bytes | None]]:
        """Names and contents of the files in folders. Headers are read here, an archive with others than plain ones by ``tarfile`` from there on."""
        done = 0
        try:
            with system.open_input_stream(archive, compression=None) as f, io.BufferedReader(gzip.GzipFile(fileobj=f), _BUFFER) as stream:
                for name, size in _plain(stream):
                    if "/" not in name:
                        _skip(stream, size)
                        continue
                    opened = _Limited(stream, size)
                    content = self._cut(name, opened)
                    _skip(stream, opened.left, size - opened.left)
                    yield name, content
                    done += 1
            return
        except (_NotPlain, OSError, EOFError, zlib.error):
            pass
        with system.open_input_stream(archive, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as files:
            for file in files:
                if not file.isfile() or "/" not in file.name:
                    continue
                if done:
                    done -= 1
                    continue
                yield file.name, self._cut(file.name, files.extractfile(file))

    def _cut(self, name: str, opened: IO[bytes]) -> bytes | None:
        """What counts of a file."""
        parents = name.split("/")[1:-1]
        if self.names_only in parents:
            return None
        return last_line_ahead(opened) if parents[-1:] == [SERIES] else opened.read()

    def _content(self, system: fs.FileSystem, file: fs.FileInfo, experiment: str) -> str | None:
        parents = file.path[len(experiment):].split("/")[:-1]
        if self.names_only in parents:
            return None
        with system.open_input_file(file.path) as f:
            raw = last_line(f, file.size) if parents[-1:] == [SERIES] else f.read()
        return raw.decode("utf-8", "replace")


def _batch(paths: list[str], contents: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.string())], ["path", "content"])


class _NotPlain(Exception):
    pass


class _Limited:
    """A file of ``size`` bytes that begins here in a stream."""

    def __init__(self, stream: BinaryIO, size: int) -> None:
        self.stream, self.left = stream, size

    def read(self, most: int = -1) -> bytes:
        asked = self.left if most < 0 else min(most, self.left)
        data = self.stream.read(asked) if asked else b""
        if len(data) < asked:
            raise _NotPlain
        self.left -= asked
        return data


def _skip(stream: BinaryIO, size: int, before: int = 0) -> None:
    """Go ``size`` bytes on and to the next record, after ``before`` bytes of the file."""
    left = size + -(before + size) % _RECORD
    while left:
        done = len(stream.read(min(left, _BUFFER)))
        if not done:
            raise _NotPlain
        left -= done


def _plain(stream: BinaryIO) -> Iterator[tuple[str, int]]:
    """Names and sizes of the files of a tar stream, which stands at a file's content when it is given; folders are passed over."""
    while True:
        header = stream.read(_RECORD)
        if not header or (not header[0] and not any(header)):
            return
        if len(header) < _RECORD or header[257:265] != b"ustar\x0000" or header[124] & 0x80:
            raise _NotPlain
        name, prefix = header[:100].partition(b"\0")[0], header[345:500].partition(b"\0")[0]
        try:
            checksum, size = int(header[148:156].strip(b" \0"), 8), int(header[124:136].strip(b" \0") or b"0", 8)
        except ValueError as e:
            raise _NotPlain from e
        if sum(header) - sum(header[148:156]) + 256 != checksum or not name.isascii() or not prefix.isascii():
            raise _NotPlain
        if header[156:157] == b"5" and not size:
            continue
        if header[156:157] != b"0":
            raise _NotPlain
        yield (prefix + b"/" + name if prefix else name).decode(), size


def last_line(file: BinaryIO, size: int, block: int = _BLOCK) -> bytes:
    """The last line that isn't blank, read from the end in blocks that double until they hold all of it."""
    at, tail = size, b""
    while at > 0:
        at, end = max(0, at - block), at
        file.seek(at)
        tail = file.read(end - at) + tail
        block *= 2
        line = tail.rstrip().rsplit(b"\n", 1)
        if len(line) == 2:
            return line[1]
    return tail.strip()


def last_line_ahead(file: IO[bytes], block: int = _BLOCK) -> bytes:
    """The same of a file that can only be read ahead; no more than that line and a block is held."""
    tail = b""
    while piece := file.read(block):
        tail += piece
        tail = tail[max(tail.rstrip().rfind(b"\n"), 0):]
    line = tail.rstrip().rsplit(b"\n", 1)
    return line[1] if len(line) == 2 else tail.strip()


def read_tree(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(RunTree)
    return spark.read.format(RunTree.name()).options(**options).load(path)
