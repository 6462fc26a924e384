"""Archives and tensor files read by byte ranges, from any file system that Arrow opens.

Files are listed by Spark, without their content. A first pass reads headers only and gives a table of members (archive,
member, offset, length) or tensors (path, key, type, shape, offset, length). What a caller filters out of it is
never read; the rest is dealt to tasks in ranges of bounded bytes, so one archive is read by several tasks, and files may
be larger than one binary value.

Members of compressed zip archives are inflated by the task that reads them; a compressed tar has no ranges, and is read by
``archives``. ``opener`` turns a path into a seekable file; it is sent to the tasks, so a caller may bring a client of its own.
"""

from __future__ import annotations

import json
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tensors import TYPES

Opener = Callable[[str], BinaryIO]
#: Bytes that a task reads, about.
TASK_BYTES = 64 << 20
#: Bytes of small members that go on together; one that is larger goes by itself.
BATCH_BYTES = 8 << 20


def open_path(path: str) -> BinaryIO:
    """A seekable file of a path as Spark lists it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file(unquote("/" + (rest if colon else path).lstrip("/")))
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length of the files below a folder whose names match; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")


def store(files: DataFrame, folder: str) -> None:
    """(path, content): write each file below ``folder``, which driver and executors share, under another name first."""
    root = folder.rstrip("/")

    def run(rows) -> None:
        for r in rows:
            target = f"{root}/{r.path.lstrip('/')}"
            scheme, colon, rest = target.partition(":")
            local = not colon or scheme == "file"
            fs, inner = (pyarrow.fs.LocalFileSystem(), "/" + (rest if colon else target).lstrip("/")) if local else pyarrow.fs.FileSystem.from_uri(target)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            part = f"{inner}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as f:
                f.write(r.content)
            fs.move(part, inner)

    files.select("path", "content").foreachPartition(run)


def _over_files(files: DataFrame, columns: str, each: Callable[[str], Iterator[tuple]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(columns))

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = list(each(path))
                for at in range(0, len(rows), 10_000):
                    cols = zip(*rows[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    # a header pass waits for its file system more than it works: a task for every few files
    return files.select("path").repartition(F.xxhash64("path")).mapInArrow(run, columns)


def members(files: DataFrame, opener: Opener = open_path) -> DataFrame:
    """(path) of tar and zip files -> archive, member, offset (null in a compressed zip), length (of the content), by their headers."""

    def each(path: str) -> Iterator[tuple]:
        with opener(path) as f:
            if path.endswith(".zip"):
                for i in zipfile.ZipFile(f).infolist():
                    if not i.is_dir():
                        stored = i.compress_type == zipfile.ZIP_STORED
                        if stored:  # the local header has a name and an extra field of its own lengths
                            f.seek(i.header_offset + 26)
                            name, extra = struct.unpack("<HH", f.read(4))
                        yield (path, i.filename, i.header_offset + 30 + name + extra if stored else None, i.file_size)
            else:
                for i in tarfile.open(fileobj=f, mode="r:"):
                    if i.isfile():
                        yield (path, i.name, i.offset_data, i.size)

    return _over_files(files, "archive string, member string, offset long, length long", each)


def dealt(entries: DataFrame, file: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Entries in tasks of about ``task_bytes``, neighbours in a file together."""
    total = entries.agg(F.sum("length")).first()[0] or 0
    return entries.repartitionByRange(max(1, -(-total // task_bytes)), file, "offset").sortWithinPartitions(file, "offset")


def ranges(rows: Iterator[tuple[str, int | None, int, str]], opener: Opener) -> Iterator[bytes]:
    """(path, offset, length, member) -> the bytes, each file opened once while its rows follow one another."""
    name, f, z = None, None, None
    try:
        for path, offset, length, member in rows:
            if path != name:
                if f is not None:
                    f.close()
                name, f, z = path, opener(path), None
            if offset is None:
                z = z or zipfile.ZipFile(f)
                yield z.read(member)
            else:
                f.seek(offset)
                data = f.read(length)
                if len(data) != length:
                    raise EOFError(f"{path} ends within {member}")
                yield data
    finally:
        if f is not None:
            f.close()


def contents(entries: DataFrame, opener: Opener = open_path, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Entries of ``members`` -> archive, member, content."""

    def run(batches):
        for b in batches:
            archive, member, offset, length = (b.column(c).to_pylist() for c in range(4))
            data, size, first = [], 0, 0
            for i, content in enumerate(ranges(zip(archive, offset, length, member, strict=True), opener), 1):
                data.append(content)
                size += len(content)
                if size >= BATCH_BYTES or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i - first), b.column(1).slice(first, i - first), pa.array(data, pa.binary())], ["archive", "member", "content"])
                    data, size, first = [], 0, i

    return dealt(entries, "archive", task_bytes).select("archive", "member", "offset", "length").mapInArrow(run, "archive string, member string, content binary")


def tensor_entries(files: DataFrame, opener: Opener = open_path) -> DataFrame:
    """(path) of keyed tensor files -> path, position, key, dtype, shape, offset, length, by their headers."""

    def each(path: str) -> Iterator[tuple]:
        with opener(path) as f:
            (n,) = struct.unpack("<Q", f.read(8))
            header = {k: v for k, v in json.loads(f.read(n)).items() if k != "__metadata__"}
        for position, key in enumerate(sorted(header, key=lambda k: header[k]["data_offsets"])):
            a, z = header[key]["data_offsets"]
            yield (path, position, key, header[key]["dtype"], header[key]["shape"], 8 + n + a, z - a)

    return _over_files(files, "path string, position int, key string, dtype string, shape array<long>, offset long, length long", each)


def tensor_values(entries: DataFrame, opener: Opener = open_path, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Entries of ``tensor_entries`` -> path, position, key, shape, values (float64): only their own bytes are read."""
    columns = "path string, position int, key string, shape array<long>, values array<double>"

    def run(batches):
        for b in batches:
            path, position, key, dtype, offset, length = (b.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6))
            for i, data in enumerate(ranges(zip(path, offset, length, key, strict=True), opener)):
                values = np.frombuffer(data, TYPES[dtype[i]]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path[i]]), pa.array([position[i]], pa.int32()), pa.array([key[i]]), b.column(4).slice(i, 1), pa.array([values], pa.list_(pa.float64())),
                ], ["path", "position", "key", "shape", "values"])

    return dealt(entries, "path", task_bytes).select("path", "position", "key", "dtype", "shape", "offset", "length").mapInArrow(run, columns)
