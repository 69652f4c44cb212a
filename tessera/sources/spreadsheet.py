"""Spreadsheets (XLSX): the first sheet's rows as texts.

A task takes a file's parts apart and no more: cells as they are stored, the strings they share, the styles and the number
formats. What a cell shows comes out of joins of those (shared strings by number, styles by their format), its place out of its
reference, and rows out of a grouping, so the cells of one large file are dealt over all tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.sinks.scratch import written

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in number formats that are dates or times.
DATE_FORMATS = (*range(14, 23), *range(45, 48))
#: kind is cell (row, place in the row, reference, type, style, value), string (its number, text), style (its number, format) or format (its number, code).
PARTS = "file string, kind string, number long, place int, ref string, type string, style int, value string"
_BATCH = 10_000


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The sheet that the workbook names first."""
    try:
        sheet = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"))
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == sheet.get(_REL))
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    except (KeyError, StopIteration):
        return "xl/worksheets/sheet1.xml"


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_NS}t"))


def file_parts(data: bytes) -> Iterator[tuple]:
    """Rows of PARTS without the file, streamed out of the zip."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        if "xl/sharedStrings.xml" in there:
            with z.open("xl/sharedStrings.xml") as part:
                strings = (e for _, e in ElementTree.iterparse(part) if e.tag == f"{_NS}si")
                for k, e in enumerate(strings):
                    yield "string", k, None, None, None, None, _text(e)
                    e.clear()
        if "xl/styles.xml" in there:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            for f in root.iter(f"{_NS}numFmt"):
                yield "format", int(f.get("numFmtId")), None, None, None, None, f.get("formatCode", "")
            cells = root.find(f"{_NS}cellXfs")
            for k, xf in enumerate(cells if cells is not None else []):
                yield "style", k, None, None, None, int(xf.get("numFmtId", 0)), None
        with z.open(_first_sheet(z)) as sheet:
            rows = (e for _, e in ElementTree.iterparse(sheet) if e.tag == f"{_NS}row")
            for k, row in enumerate(rows):
                for place, c in enumerate(row.iter(f"{_NS}c")):
                    kind = c.get("t")
                    yield "cell", k, place, c.get("r"), kind, int(c.get("s", 0)), _text(c) if kind == "inlineStr" else c.findtext(f"{_NS}v")
                row.clear()


def sheet_parts(files: DataFrame) -> DataFrame:
    """PARTS of ``files(path, content)``."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = file_parts(content.as_py())
                while rows := list(islice(found, _BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), kinds[0]), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds[1:]))], names=names)

    return files.select("path", "content").mapInArrow(run, PARTS)


def date_styles(parts: DataFrame) -> DataFrame:
    """(file, style) of the cell styles that show dates: built-in formats, and own ones with a day, month or year and no digits."""
    codes = parts.where("kind = 'format'").select("file", F.col("number").cast("int").alias("format"), F.regexp_replace("value", '"[^"]*"', "").alias("code"))
    styles = parts.where("kind = 'style'").select("file", F.col("number").cast("int").alias("style"), F.col("style").alias("format")).join(codes, ["file", "format"], "left")
    own = F.col("code").rlike("(?i)[dmy]") & ~F.col("code").rlike("[#0]")
    return styles.where(F.col("format").isin(*DATE_FORMATS) | F.coalesce(own, F.lit(False))).select("file", "style").distinct()


def shown_cells(parts: DataFrame) -> DataFrame:
    """(file, number, place, ref, text): what each cell shows."""
    strings = parts.where("kind = 'string'").select("file", F.col("number").alias("_string"), F.col("value").alias("_shared"))
    dates = date_styles(parts).withColumn("_date", F.lit(True))
    cells = parts.where("kind = 'cell'").withColumn("_string", F.when(F.col("type") == "s", F.col("value").try_cast("long")))
    cells = cells.join(strings, ["file", "_string"], "left").join(dates, ["file", "style"], "left")
    plain, serial = F.coalesce("value", F.lit("")), F.col("value").try_cast("double")
    is_date = F.col("_date") & F.coalesce(F.col("type") == "n", F.lit(True)) & serial.between(*values.SERIALS)
    text = F.when(F.col("type") == "s", F.coalesce("_shared", F.lit(""))).when(is_date, values.serial_text(F.floor(serial))).otherwise(plain)
    return cells.select("file", "number", "place", "ref", F.trim(text).alias("text"))


def placed(ref: Column, row: Sequence[str]) -> Column:
    """The column of a cell, from 0: by its reference; one without any stands after the cell before it."""
    w = Window.partitionBy(*row).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    letters = F.regexp_extract(ref, "^([A-Za-z]+)", 1)
    index = F.when(letters != "", values.column_index(letters))
    last = F.last(F.when(index.isNotNull(), F.struct(index.alias("at"), "place")), ignorenulls=True).over(w)
    return F.coalesce(last["at"] + F.col("place") - last["place"], F.col("place")).cast("int")


def read_sheets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, row_no and cells of the files at a path, or of these files: rows that aren't blank, by their place in the sheet, with '' where there is no cell."""
    parts = written(sheet_parts(spark.read.format("binaryFile").load(path)), "sheet-parts")
    row = ["file", "number"]
    cells = shown_cells(parts).withColumn("at", placed(F.col("ref"), row)).where("text <> ''")
    one = cells.groupBy(*row, "at").agg(F.max_by("text", "place").alias("text"))  # of cells in one place the last
    rows = one.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("at", "text"))).alias("_cells"), F.max("at").alias("_last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: F.coalesce(F.try_element_at("_cells", k), F.lit("")))
    return rows.select("file", F.col("number").alias("row_no"), dense.alias("cells"))
