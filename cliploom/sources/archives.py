"""A data source of archive members: ``spark.read.format("clip_archive").load(folder)``.

One partition per tar or zip file, members streamed one by one: clip_id, member, archive, content.
"""

from __future__ import annotations

import os
import re
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ranges

#: The clip of a member: its name without folders and endings.
CLIP = r"([^/]+?)(?:\.[^/]*)?$"


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.member = re.compile(options.get("member", r".*"))
        self.clip = re.compile(options.get("clip", CLIP))
        self.process, self.processes = int(options.get("process", 0)), int(options.get("processes", 1))

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.folder) for f in fs if f.endswith((".tar", ".tar.gz", ".tgz", ".zip")))
        return [_Archive(p) for p in found[self.process :: self.processes]]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        if partition is None:
            return
        for name, data in self._members(partition.path):
            m = self.clip.search(name)
            yield (m[1] if m else name, name, partition.path, data)

    def _members(self, path: str) -> Iterator[tuple[str, bytes]]:
        if path.endswith(".zip"):
            with zipfile.ZipFile(path) as z:
                for i in z.infolist():
                    if not i.is_dir() and self.member.search(i.filename):
                        yield i.filename, z.read(i)
            return
        with tarfile.open(path, "r|*") as t:
            for i in t:
                if i.isfile() and self.member.search(i.name):
                    yield i.name, t.extractfile(i).read()


class ClipArchive(DataSource):
    """Options: member (pattern a name must match), clip (pattern with the id as group 1), process and processes (a static split)."""

    @classmethod
    def name(cls) -> str:
        return "clip_archive"

    def schema(self) -> str:
        return "clip_id string, member string, archive string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipArchive)


def sidecars(spark: SparkSession, folder: str, fields: str, split: str, pattern: str | None = None) -> DataFrame:
    """JSON members of archives as flat rows with the fields of the DDL string, tagged with the split.

    With ``pattern``, the archives below ``folder`` whose names match, plain tar or zip, are read by ranges on any file
    system, one by several tasks. Without, all archives on a shared disk are streamed, compressed tars too, each by one task.
    """
    if pattern is not None:
        m = ranges.members(ranges.listed(spark, folder, pattern)).filter(F.col("member").endswith(".json"))
        r = ranges.contents(m).select(F.regexp_extract("member", CLIP, 1).alias("clip_id"), "content")
    else:
        register(spark)
        r = spark.read.format("clip_archive").option("member", r"\.json$").load(folder)
    return r.select("clip_id", F.from_json(F.decode("content", "UTF-8"), fields).alias("j")).select("clip_id", "j.*", F.lit(split).alias("split"))
