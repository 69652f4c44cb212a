"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, as a regular expression class (ASCII only).
SPACES = r"[\x20\x09-\x0D]+"
#: What separates words made of ASCII letters, digits and any non-ASCII character.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        directory = spark.sparkContext._jsc.sc().getCheckpointDir()
        if directory.isDefined():
            found = directory.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths in the shared folder that this driver has given out and not taken away.
_given: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    _given.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[str]]:
    """Takes away what was written in the shared folder inside, but for what was written last, whose path the list then holds."""
    begin = len(_given)
    last: list[str] = []
    yield last
    for path in _given[begin:-1]:
        remove(spark, path)
    last += _given[max(begin, len(_given) - 1) :]
    del _given[begin:]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, _UPPER, _UPPER.lower())


def split_words(text: Column, separator: str) -> Column:
    """Words between ``separator`` matches; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def listed_files(manifest: DataFrame, column: str) -> DataFrame:
    """The names in a written manifest, a few to a partition, so that tasks read files in parallel."""
    return manifest.select(column).repartition(max(1, min(manifest.count(), 10_000)), column)


def _size(setting: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", setting.strip().lower()).groups()
    return int(number) << (10 * " kmgt".index(unit or " "))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, batch: str = "8m", partition: str = "16m") -> Iterator[None]:
    """What is run inside takes little memory in a task: Python gets few rows and bytes at a time, and adaptive partitions are small.

    Settings that are smaller already stay.
    """
    most = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": batch,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": partition,
    }
    before = {name: spark.conf.get(name) for name in most}
    for name, value in most.items():
        if not 0 < _size(before[name]) < _size(value):
            spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when its query ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
