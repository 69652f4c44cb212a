"""Delimited tables: delimiter by what the first line holds most, header names made unique, empty cells as ''."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import charsets
from tessera.functions.texts import printable
from tessera.operators.mapping import unique_names

BOM = chr(0xFEFF)
DELIMITERS = (";", ",", "\t", "|")
SNIFFED = 8192
#: Of a file whose cells may hold line ends, so much is looked at for the header.
HEADER_BYTES = 1 << 16


def sniff(path: str, first_line: str) -> str:
    """The delimiter: tab by the file's name, else the most frequent; of equals the earlier, ``;`` if there is none."""
    if path.lower().endswith((".tsv", ".tab")):
        return "\t"
    counts = [first_line[:SNIFFED].count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))]


def _decoded(latin: str) -> str:
    """What ``charsets.as_text`` does, for a header."""
    data = latin.encode("latin-1")
    try:
        return data.decode().lstrip(BOM)
    except UnicodeDecodeError:
        return data.decode("windows-1252", "replace")


def _parsed(line: str, sep: str) -> list[str]:
    csv.field_size_limit(max(csv.field_size_limit(), len(line) + 1))
    return next(csv.reader(io.StringIO(line, newline=""), delimiter=sep), [])


def _heads(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """(head, file): the different beginnings of files, each byte as a character, with one file of each."""
    if multi_line:
        whole = spark.read.format("binaryFile").load(path)
        heads = whole.select(F.col("path").alias("file"), charsets.latin(F.substring("content", 1, HEADER_BYTES)).alias("head"))
    else:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
        first = lines.where("block = 0").groupBy("file").agg(F.min_by(F.col("value").cast("binary"), "row").alias("value"))
        heads = first.select("file", F.regexp_replace(charsets.latin(F.col("value")), "^ï»¿|\r$", "").alias("head"))
    return heads.groupBy("head").agg(F.min("file").alias("file"))


def header_of(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[str, list[str]]:
    """(delimiter, names as given); ValueError where files have unlike headers, in names or in their order."""
    found = _heads(spark, path, multi_line).orderBy("file").take(1000)
    if not found:
        return ";", []
    sep = sniff(path, _decoded(found[0]["head"]).splitlines()[0] if found[0]["head"] else "")
    headers = [(_parsed(_decoded(r["head"]), sep), r["file"]) for r in found]
    for names, file in headers:
        if names != headers[0][0]:
            raise ValueError(f"{file} has another header than {headers[0][1]}: {names} and {headers[0][0]}")
    return sep, headers[0][0]


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, with the header's names, and ``ordinal``, by which rows stand as in their files.

    All files must have the same header, which is all that the driver reads (it takes a look at each file's first line; a
    thousand different ones at most). Cells that aren't UTF-8 are read as Windows-1252, each for itself. multi_line: quoted
    cells, the header's too, may hold line ends; such a file is read by one task.
    """
    sep, given = header_of(spark, path, multi_line)
    names = unique_names(given)
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("header", True).option("multiLine", multi_line)
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    # bytes as characters until the cells are apart, so that each cell is decoded for itself
    df = reader.schema(schema).option("enforceSchema", True).option("columnPruning", False).option("encoding", "ISO-8859-1").csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    ordinal = unique_names([*names, "ordinal"])[-1]
    cell = lambda k: F.coalesce(printable(charsets.as_text(F.encode(f"c{k}", "ISO-8859-1"))), F.lit(""))
    return df.select(*[cell(k).alias(n) for k, n in enumerate(names)], place.alias(ordinal))
