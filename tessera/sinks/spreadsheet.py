"""Spreadsheets (XLSX): a file per partition, rows streamed into the zip; empty values leave no cell."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from datetime import date
from itertools import chain, islice
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.sinks import folders

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Fixed value: rows that a sheet may have.
SHEET_ROWS = 1_048_576
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SHEETS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEETS}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SHEETS}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_SHEETS}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Foglio1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><numFmts count="2"><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="#,##0.00"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, value, kind: str) -> str:
    if value is None or value == "":
        return ""
    if kind == "date" and isinstance(value, date):
        return f'<c r="{ref}" s="1"><v>{value.toordinal() - date(1899, 12, 30).toordinal()}</v></c>'
    if kind in ("currency", "number", "integer") and isinstance(value, (int, float)):
        shown = f"{value:.6f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)
        return f'<c r="{ref}"{" s=\"2\"" if kind == "currency" else ""}><v>{shown}</v></c>'
    plain = "".join(ch for ch in str(value) if ch >= " " or ch in "\t\n\r")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'


def workbook(headers: list[str], rows: Iterable[tuple], kinds: list[str], first_column: int = 0) -> bytes:
    """A workbook of one sheet with a frozen header."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in PARTS.items():
            z.writestr(name, _HEAD + body)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
            for r, row in enumerate([headers, *rows] if isinstance(rows, list) else _chain(headers, rows), 1):
                cells = "".join(_cell(f"{letters(first_column + k)}{r}", v, "text" if r == 1 else kinds[k]) for k, v in enumerate(row))
                sheet.write(f'<row r="{r}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _chain(headers: list[str], rows: Iterable[tuple]) -> Iterator[tuple]:
    yield tuple(headers)
    yield from rows


def write_sheets(df: DataFrame, path: str, kinds: Mapping[str, str] = {}, headers: Mapping[str, str] = {}, first_column: int = 0, sheet_rows: int = SHEET_ROWS) -> DataFrame:  # noqa: B006
    """Writes ``part-N-A-K.xlsx`` below ``path``, a folder that all executors see; the result, once evaluated, lists them.

    A task that is done again writes files of its own (A is its attempt); what the result doesn't list isn't part of the
    table: read what ``listed`` names; ``tidied`` takes the rest away. Evaluate the result once, and keep it. A sheet holds SHEET_ROWS rows, header included; a partition with more goes on in further files. A file is put together
    in the task's memory, compressed.
    """
    names, of = [headers.get(c, c) for c in df.columns], [kinds.get(c, "text") for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for number, first in enumerate(rows):
            n = 0

            def sheet(first=first):
                nonlocal n
                for n, row in enumerate(chain([first], islice(rows, sheet_rows - 2)), 1):
                    yield row

            data = workbook(names, sheet(), of, first_column)
            task = TaskContext.get()
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId():06d}-{number:03d}.xlsx"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_rows"])

    return df.mapInArrow(run, "file string, n_rows long")


def listed(path: str, written: DataFrame) -> list[str]:
    """The sheets below ``path`` that are part of the table ``written``, an evaluated result of ``write_sheets``: one for many rows."""
    return [f"{path}/{r.file}" for r in written.select("file").orderBy("file").collect()]


def tidied(spark: SparkSession, path: str, written: DataFrame) -> list[str]:
    """Takes away the sheets below ``path`` that ``written``, an evaluated result of ``write_sheets``, doesn't list; returns their names."""
    there = spark.createDataFrame([(x,) for x in folders.names(spark, path) if x.endswith(".xlsx")], "file string")
    gone = [r.file for r in there.join(written, "file", "left_anti").orderBy("file").collect()]
    for name in gone:
        folders.remove(spark, f"{path}/{name}")
    return gone
