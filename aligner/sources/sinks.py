"""Writers: versioned match-database snapshots and telemetry tables."""

from __future__ import annotations

import gzip
import itertools
import os
import posixpath
import tarfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from aligner.operators.telemetry import Telemetry
from aligner.session import new_path
from aligner.sources.files import COMMIT, COMMITS, TELEMETRY_KINDS, read_commits
from aligner.sources.tree import ARCHIVE

#: Files of an archive; more of a task go to further ones.
ARCHIVE_FILES = 1 << 15
#: Bytes that are compressed at a time.
_PIECE = 1 << 18


def write_match_db(aliases: DataFrame, root: str | None = None, version: str | None = None) -> str:
    """Write a full snapshot to a new versioned folder, never over one that may be read; returns its path."""
    path = os.path.join(root, version) if root and version else new_path(aliases.sparkSession, "match-db")
    aliases.write.mode("overwrite").parquet(path)
    return path


def write_telemetry(telemetry: Telemetry, root: str, run: str, fmt: str = "json") -> dict[str, str]:
    """Write traces, observations, scores, events and ground-truth items of a run below ``root``, by kind, run, attempt and day.

    Every call is an attempt with folders of its own. The record of the attempt is written after all its tables, and ``files.read_committed``
    reads the last recorded attempt of a run: a run half written is never seen, one written again replaces what it wrote before. Superseded
    attempts stay until the folder's retention removes them.
    """
    attempt, paths = uuid.uuid4().hex, {}
    for kind in TELEMETRY_KINDS:
        df = getattr(telemetry, kind)
        if df is not None:
            paths[kind] = os.path.join(root, kind, f"run={run}", f"attempt={attempt}")
            at = next(c for c in ("timestamp", "start_time", "created_at") if c in df.columns)
            df.withColumn("day", F.to_date(at)).write.partitionBy("day").format(fmt).save(paths[kind])
    spark = telemetry.traces.sparkSession
    before = read_commits(spark, root).where(F.col("run") == run).agg(F.max("number")).first()[0]
    record = spark.createDataFrame([(run, attempt, (before or 0) + 1)], COMMIT)
    record.coalesce(1).write.mode("append").parquet(os.path.join(root, COMMITS))
    return paths


def write_filestore(files: DataFrame, root: str, archives: bool = False, archive_files: int = ARCHIVE_FILES) -> str:
    """Write ``(path, content)`` as files below ``root``; a path starts with a slash. A task that runs again writes the same files again.

    With ``archives`` the files ``/tree/experiment/...`` go in archives below ``/tree``, which ``files.read_filestore`` reads as if unpacked
    there: a run of a few short files then takes their compressed bytes, not a block for every file and folder. Paths are dealt out to the
    tasks and sorted; of equal ones the last by content stands.
    """
    def put(rows: Iterator[Row]) -> None:
        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for row in rows:
            path = base + row["path"]
            folder = posixpath.dirname(path)
            if folder not in made:
                system.create_dir(folder)
                made.add(folder)
            with system.open_output_stream(path) as f:
                f.write((row["content"] or "").encode())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        part = TaskContext.get().partitionId()
        for tree, own in itertools.groupby(_last_of_each(batches), key=lambda r: r[0].split("/", 2)[1]):
            folder = posixpath.join(base, tree)
            system.create_dir(folder)
            for n in itertools.count():
                if not (first := next(own, None)):
                    break
                name = f"part-{part:05}-{n:05}{ARCHIVE}"
                unfinished = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
                with system.open_output_stream(unfinished, compression=None) as f, gzip.GzipFile(fileobj=f, mode="wb", compresslevel=4, mtime=0) as out:
                    for piece in _pieces(itertools.chain([first], itertools.islice(own, archive_files - 1))):
                        out.write(piece)
                system.move(unfinished, posixpath.join(folder, name))
        yield from ()

    if archives:
        parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        files.repartition(parts, "path").sortWithinPartitions("path", "content").select("path", "content").mapInArrow(pack, "none int").collect()
    else:
        files.foreachPartition(put)
    return root


def _last_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None]]:
    """The last of every run of rows of one path."""
    last = None
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last and last[0] != row[0]:
                yield last
            last = row
    if last:
        yield last


def _pieces(rows: Iterable[tuple[str, str | None]]) -> Iterator[bytes]:
    """The bytes of a tar archive of the files, a number of files at a time."""
    held, size, whole = [], 0, 0
    for path, text in rows:
        content = (text or "").encode()
        header = _header(path.split("/", 2)[2], len(content))
        gap = -len(content) % tarfile.BLOCKSIZE
        held += [header, content, bytes(gap)]
        size += len(header) + len(content) + gap
        if size >= _PIECE:
            yield b"".join(held)
            held, size, whole = [], 0, whole + size
    whole += size + 2 * tarfile.BLOCKSIZE
    yield b"".join([*held, bytes(2 * tarfile.BLOCKSIZE + -whole % tarfile.RECORDSIZE)])


def _header(name: str, size: int) -> bytes:
    """As ``tarfile`` makes it; short names in ASCII take the place in a header that is made once."""
    if len(name) > tarfile.LENGTH_NAME or not name.isascii() or size >= 8 ** 11:
        file = tarfile.TarInfo(name)
        file.size = size
        return file.tobuf()
    own, digits = name.encode(), b"%011o" % size
    total = _BARE_SUM + sum(own) + sum(digits)
    return own.ljust(tarfile.LENGTH_NAME, b"\0") + _BARE[100:124] + digits + _BARE[135:148] + b"%06o\0" % total + _BARE[155:]


def _bare() -> bytes:
    """The header of a file without name, size and checksum."""
    header = bytearray(tarfile.TarInfo("").tobuf())
    header[124:135], header[148:156] = bytes(11), b" " * 8
    return bytes(header)


_BARE = _bare()
_BARE_SUM = sum(_BARE)
