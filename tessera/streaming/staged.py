"""Long inputs in stages: files a trigger at a time, exactly once, in smaller parts after failures."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sinks.folders import UNFINISHED, remove, rename

ATTEMPTS = 4
LEAST_FILES = 1
_ONE_WRITER = "spark.sql.streaming.stopActiveRunOnRestart"


class Stages:
    """The sink: each stage is a folder ``stage=N`` of ``out``, whole or not there.

    A stage is written part by part into another folder, which takes its name at the end, so a stage that is done again
    replaces what is left of its first run. A part that fails is halved, by files, and so are the parts after it; one file
    that fails alone fails the stage.
    """

    def __init__(self, out: str, schema: str, format: str, transform: Callable[[DataFrame], DataFrame], most_files: int):
        self.out, self.schema, self.format, self.transform = out.rstrip("/"), schema, format, transform
        self.size = most_files
        self.done: list[dict] = []
        self.halved: list[int] = []

    def __call__(self, batch: DataFrame, stage: int) -> None:
        spark = batch.sparkSession
        paths = [unquote(r.path) for r in batch.select("path").orderBy("path").collect()]  # one stage's files at most
        final, draft = f"{self.out}/stage={stage}", f"{self.out}/{UNFINISHED}/stage={stage}"
        remove(spark, draft)
        parts: list[dict] = []
        while paths:
            part = paths[: self.size]
            try:
                rows = self._write(spark, part, f"{draft}/part={len(parts)}")
            except Exception:
                remove(spark, f"{draft}/part={len(parts)}")
                if len(part) <= LEAST_FILES:
                    raise
                self.size = max(LEAST_FILES, len(part) // 2)
                self.halved.append(self.size)
                continue
            parts.append({"stage": stage, "files": len(part), "rows": rows})
            paths = paths[len(part) :]
        remove(spark, final)
        if parts:
            rename(spark, draft, final)
        self.done += parts

    def _write(self, spark: SparkSession, paths: list[str], to: str) -> int:
        seen = Observation()
        read = spark.read.schema(self.schema).format(self.format).load(paths).observe(seen, F.count(F.lit(1)).alias("rows"))
        self.transform(read).write.parquet(to)
        return seen.get["rows"]


def ingest(spark: SparkSession, source: str, checkpoint: str, sink: Stages, files_per_stage: int = 60) -> StreamingQuery:
    """Takes what is in ``source`` and the checkpoint doesn't know yet, stage by stage, then stops.

    The stream carries paths alone; a stage reads its files itself, so it can read fewer of them at a time. A checkpoint takes
    one writer: a second query on it is refused while the first one runs.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    paths = files.option("maxFilesPerTrigger", files_per_stage).option("pathGlobFilter", "[!._]*").load(source).select("path")
    before = spark.conf.get(_ONE_WRITER, "true")
    spark.conf.set(_ONE_WRITER, "false")
    try:
        return paths.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_ONE_WRITER, before)


def run(
    spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_stage: int = 60, format: str = "parquet"
) -> list[dict]:
    """``ingest`` to its end. Returns stage, files and rows of each part that was written.

    A stage that fails with a single file fails the query, which is tried again some times from where it stood: that stage
    only, with parts as small as they have become. What can't be planned at all is raised at once.
    """
    sink = Stages(out, schema, format, transform, files_per_stage)
    for attempt in range(1, ATTEMPTS + 1):
        query = ingest(spark, source, checkpoint, sink, files_per_stage)
        try:
            query.awaitTermination()
            break
        except StreamingQueryException:
            if attempt == ATTEMPTS:
                raise
    return sink.done


def result(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all stages."""
    return spark.read.parquet(out).drop("stage", "part")
