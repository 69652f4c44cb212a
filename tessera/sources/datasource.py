"""Readers as data sources: ``spark.read.format("captions").load(path)`` and ``"markdown"``, in batch and as streams.

A file is a partition; it is read where its task runs, through the file system that its address names. Files are taken in
the order of their times, so a stream's place among them is a number: files that come later must not be older, and none
may go while a stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions import texts
from tessera.sources import captions as caption_files
from tessera.sources import markdown as markdown_files
from tessera.sources.runs import BLOCK_SCHEMA


class _File(InputPartition):
    def __init__(self, address: str, path: str):
        self.address, self.path = address, path


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    if "://" in address or address.startswith("file:"):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def listed(address: str) -> list[str]:
    """The files at an address, by time and name; those whose names begin with a dot or an underscore aren't data."""
    system, path = _opened(address)
    if system.get_file_info(path).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(x[0] in "._" for x in p.removeprefix(path).split("/") if x)
    return [i.path for i in sorted((i for i in found if i.type == fs.FileType.File and not hidden(i.path)), key=lambda i: (i.mtime_ns or 0, i.path))]


def decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("windows-1252", "replace")


class _Reading:
    """What batch and stream readers share. ``parse`` gives rows of the schema without its first column, the path."""

    def __init__(self, address: str, schema: StructType, parse):
        self.address, self.schema, self.parse = address, schema, parse

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(partition.address)
        with system.open_input_stream(partition.path) as f:
            text = decoded(f.read())
        arrow = to_arrow_schema(self.schema)
        held: list[tuple] = []
        for row in self.parse(text):
            held.append((partition.path, *row))
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(self.address, p) for p in listed(self.address)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self, *_) -> dict:
        return {"files": len(listed(self.address))}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(self.address, p) for p in listed(self.address)[start["files"] : end["files"]]]


class _Source(DataSource):
    ddl = ""

    @staticmethod
    def parse(text: str) -> Iterator[tuple]:
        raise NotImplementedError

    def schema(self) -> str:
        return self.ddl

    def _made(self, kind, schema: StructType):
        if "path" not in self.options:
            raise ValueError(f"{self.name()}: load() needs a path")
        return kind(self.options["path"], schema, type(self).parse)

    def reader(self, schema: StructType) -> _Batch:
        return self._made(_Batch, schema)

    def streamReader(self, schema: StructType) -> _Stream:
        return self._made(_Stream, schema)


class Captions(_Source):
    """SRT, VTT and SBV files and pasted transcripts as raw cues; ``told`` cleans them."""

    ddl = "path string, cue_no int, seconds double, raw string"

    @classmethod
    def name(cls) -> str:
        return "captions"

    @staticmethod
    def parse(text: str) -> Iterator[tuple]:
        return ((k, *cue) for k, cue in enumerate(caption_files.cues(text)))


class Markdown(_Source):
    """Markdown files as blocks."""

    ddl = "path string, " + BLOCK_SCHEMA.removeprefix("doc_id long, ")

    @classmethod
    def name(cls) -> str:
        return "markdown"

    @staticmethod
    def parse(text: str) -> Iterator[tuple]:
        return ((k, *b[:-1], [r._asdict() for r in b[-1]]) for k, b in enumerate(markdown_files.blocks(text)))


def register(spark: SparkSession) -> None:
    for source in (Captions, Markdown):
        spark.dataSource.register(source)


def told(cues: DataFrame, scene_notes: bool = False) -> DataFrame:
    """Raw cues with ``text`` and ``speaker`` in place of ``raw``."""
    parts = cues.withColumn("_s", texts.speaker(F.col("raw")))
    return parts.withColumns({"text": texts.without_noise(F.col("_s.said"), scene=not scene_notes), "speaker": F.col("_s.speaker")}).drop("raw", "_s")
