"""What reads a file, by extension, and why some files aren't read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import charsets
from tessera.operators import blocks
from tessera.sources import captions, delimited, html, markdown, spreadsheet

#: Bytes that a file may have where sizes are checked, by extension.
LIMITS = {**dict.fromkeys(("csv", "tsv", "tab", "xlsx", "html", "htm", "xhtml", "md", "markdown", "txt"), 15 << 20), **dict.fromkeys(("srt", "vtt", "sbv"), 5 << 20)}
REFUSED = {
    "doc": "old Word files: save as text, Markdown or HTML",
    "docx": "Word files: save as HTML or Markdown",
    "epub": "e-books: take the HTML chapters out",
    "odt": "OpenDocument files: save as HTML",
    "pdf": "PDF: give the positioned pieces of text as a table (see tessera.operators.grid)",
    "rtf": "rich text: save as HTML",
    "xls": "old Excel files: save as XLSX or CSV",
}


def _texts(spark: SparkSession, path: str, page: bool = False) -> DataFrame:
    """(doc_id, text) of whole files, in whatever character set; the id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), charsets.as_text(F.col("content"), page).alias("text"))


def _plain(spark: SparkSession, path: str) -> DataFrame:
    return blocks.exploded(_texts(spark, path), blocks.flat_blocks(F.col("text")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **dict.fromkeys(("csv", "tsv", "tab"), delimited.read_delimited),
    "xlsx": spreadsheet.read_sheets,
    **dict.fromkeys(("srt", "vtt", "sbv"), lambda spark, path: captions.read_captions(_texts(spark, path))),
    **dict.fromkeys(("html", "htm", "xhtml"), lambda spark, path: html.read_html(_texts(spark, path, page=True).withColumnRenamed("text", "html"))),
    **dict.fromkeys(("md", "markdown"), lambda spark, path: markdown.read_markdown(_texts(spark, path))),
    "txt": _plain,
}


def extension(path: str) -> str:
    return path.rstrip("/*").rpartition(".")[2].lower()


def register(extensions: str | list[str], reader: Callable[[SparkSession, str], DataFrame], limit: int | None = None) -> None:
    """Adds or replaces the reader of some extensions, with the bytes that such a file may have."""
    for kind in [extensions] if isinstance(extensions, str) else extensions:
        READERS[kind.lower()] = reader
        LIMITS.pop(kind.lower(), None)
        if limit is not None:
            LIMITS[kind.lower()] = limit


def read(spark: SparkSession, path: str, checked: bool = False) -> DataFrame:
    """Reads a file by its extension; ValueError says what to do with those that aren't read.

    checked: files over the limit of their kind, and files without anything to read, are refused too. Tables need a header,
    documents a block.
    """
    kind = extension(path)
    if kind not in READERS:
        raise ValueError(REFUSED.get(kind, f"nothing reads .{kind} files; known are {', '.join(sorted(READERS))}"))
    if checked and kind in LIMITS:
        large = too_large(spark, path, LIMITS[kind]).orderBy("path").first()
        if large:
            raise ValueError(f"{large['path']} has {large['length']} bytes; .{kind} files may have {LIMITS[kind]}")
    df = READERS[kind](spark, path)
    if checked and not (len(df.columns) > 2 if kind in ("csv", "tsv", "tab") else df.head(1)):
        raise ValueError(f"{path} has " + ("fewer than two columns" if kind in ("csv", "tsv", "tab") else "nothing to read"))
    return df


def too_large(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Files over the limit, by their metadata only."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > limit)
