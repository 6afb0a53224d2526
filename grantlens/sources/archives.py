"""Zip archives of filings as a Spark data source, and filings as a table function for SQL."""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .filings import _COLUMNS, SCHEMA, _open, parse

FORMAT, FUNCTION = "filing_archives", "parse_filing"
#: Bytes of an archive that one task reads, and bytes of members in one Arrow batch.
SPLIT, BATCH = 64 << 20, 4 << 20

_STORED = {"archive", "member", "object_id", "size"}


def _object_id(member: str) -> str:
    """As ``functions.text.object_id`` gives it."""
    hit = re.search(r"([^/]+?)(_public)?\.xml\Z", member)
    return hit.group(1) if hit else ""


@dataclass
class Split(InputPartition):
    """The members of an archive whose headers begin in [start, end)."""

    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    """Takes no filters from Spark: Spark 4.1 keeps them in what ``load`` returned, and a second query on it would lose rows."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.first, self.below = options.get("idFrom"), options.get("idBelow")
        self.columns, self.arrow = schema.fieldNames(), to_arrow_schema(schema)

    def wanted(self, name: str, object_id: str) -> bool:
        return name.endswith(".xml") and (self.first is None or object_id >= self.first) and (self.below is None or object_id < self.below)

    def partitions(self) -> list[Split]:
        """Archives are cut by their size."""
        store, at = fs.FileSystem.from_uri(self.path if "://" in self.path else re.sub("^file:/*", "file:///", self.path))
        found = store.get_file_info(at)
        files = store.get_file_info(fs.FileSelector(at, recursive=True)) if found.type == fs.FileType.Directory else [found]
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        host = "" if not scheme or scheme == "file://" else self.path[len(scheme) :].split("/")[0]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.endswith(".zip"):
                # some stores give paths with the host or bucket, some without
                name = f.path if not scheme or not host else scheme + (f.path if f.path.startswith(host + "/") else f"{host}/{f.path.lstrip('/')}")
                out += [Split(name, a, a + self.split) for a in range(0, max(f.size, 1), self.split)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        with _open(split.archive) or nullcontext() as z:
            for info in z.infolist() if z else []:
                row = dict(archive=split.archive, member=info.filename, object_id=_object_id(info.filename), size=info.file_size)
                if not split.start <= info.header_offset < split.end or not self.wanted(info.filename, row["object_id"]):
                    continue
                if "content" in self.columns:
                    try:
                        row["content"] = z.read(info)
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
                        row["content"] = None
                    held += len(row["content"] or b"")
                rows.append({c: row[c] for c in self.columns})
                held += 100
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)


class ArchiveSource(DataSource):
    """archive, member, object_id, size, content of the XML members of zip archives in a file or folder.

    A schema with fewer of these columns reads only them; without ``content`` nothing is unpacked.
    A broken archive has no members; a member that is damaged, locked or packed in an unknown way has null content. Options:
    ``idFrom`` and ``idBelow`` bound the object ids, and members outside are not unpacked; ``splitBytes`` is how much of
    an archive one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, member string, object_id string, size long, content binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        if unknown := set(schema.fieldNames()) - _STORED - {"content"}:
            raise ValueError(f"no such columns in archives: {sorted(unknown)}")
        return ArchiveReader(self.options, schema)


@udtf(returnType=SCHEMA, useArrow=True)
class ParseFiling:
    """The row of ``filings.shred`` of a filing (object_id, content) that parses; none for others and for null.

    For inner LATERAL joins in SQL: with LEFT JOIN LATERAL, Spark 4.1 drops the rows without output just the same.
    """

    def eval(self, object_id: str, content: bytes) -> Iterator[tuple]:
        row = parse(bytes(content)) if content is not None else None
        if row:
            yield tuple(({"object_id": object_id} | row)[c] for c in _COLUMNS)


def register(spark: SparkSession) -> None:
    """Makes the source and the table function known to the session."""
    spark.dataSource.register(ArchiveSource)
    spark.udtf.register(FUNCTION, ParseFiling)
