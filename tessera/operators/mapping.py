"""Column mapping: one narrow select per table, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values

KINDS = ("text", "integer", "currency", "date", "number")
NAME_LIMIT, VALUE_LIMIT = 120, 200
ANOMALIES = "key string, client string, reason string, field string, proposed string, severity string"


@dataclass(frozen=True)
class MappedColumn:
    """An output column: from a source column, or a fixed value, or empty."""

    name: str
    source: str = ""
    value: str = ""
    kind: str = "text"


def unique_names(names: Sequence[str]) -> list[str]:
    """Header names, blank ones as ``Colonna n``, repeated ones with a number that makes them unique."""
    out: list[str] = []
    taken: set[str] = set()
    for n, name in enumerate(names, 1):
        base = name.strip() or f"Colonna {n}"
        unique, k = base, 2
        while unique in taken:
            unique, k = f"{base} ({k})", k + 1
        taken.add(unique)
        out.append(unique)
    return out


def unique_header(names: Column) -> Column:
    """``unique_names`` on a column of header rows."""

    @F.arrow_udf("array<string>")
    def unique(rows: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unique_names([n or "" for n in x]) for x in rows.to_pylist()], pa.list_(pa.string()))

    return unique(names)


def checked(mapping: Sequence[MappedColumn], header: Sequence[str]) -> list[MappedColumn]:
    """Nameless columns dropped, long names and values cut, unknown kinds as text; the identity if nothing is left."""
    out = [
        replace(m, name=m.name.strip()[:NAME_LIMIT], value=m.value[:VALUE_LIMIT], kind=m.kind if m.kind in KINDS else "text")
        for m in mapping
        if m.name.strip()
    ]
    return out or [MappedColumn(name, name) for name in header]


def _typed(c: Column, source_type: str, kind: str) -> Column:
    """A source value in the column's kind; texts are read by the Italian rules."""
    if kind == "text" or source_type != "string":
        return values.text(c.cast("string")) if kind == "text" else c
    if kind == "integer":
        return values.amount(c).cast("long")
    if kind == "date":
        return values.parse_date(c)
    return values.amount(c)


def map_columns(df: DataFrame, mapping: Sequence[MappedColumn]) -> DataFrame:
    """The mapped columns. A source that the table lacks gives an empty column."""
    types = dict(df.dtypes)
    columns = []
    for m in checked(mapping, df.columns):
        if m.source in types:
            c = _typed(F.col(f"`{m.source}`"), types[m.source], m.kind)
        else:
            c = _typed(F.lit("" if m.source else m.value), "string", m.kind)
        columns.append(c.alias(m.name))
    return df.select(*columns)


def missing_sources(df: DataFrame, mapping: Sequence[MappedColumn]) -> DataFrame:
    """An anomaly to correct for each source column that the table lacks."""
    rows = [("", "", f"La colonna «{m.source}» non c'è", m.name, "", "correggi") for m in checked(mapping, df.columns) if m.source and m.source not in df.columns]
    return df.sparkSession.createDataFrame(rows, ANOMALIES)


def skip_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with something in any column; judged after mapping, so a fixed value keeps all."""
    return df.where(F.trim(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns])) != "")


def cell_text(c: Column, kind: str) -> Column:
    """A value as the delimited sink shows it."""
    if kind == "date":
        return values.text(F.date_format(c, "dd/MM/yyyy"))
    if kind == "currency":
        return values.text(F.replace(F.format_string("%.2f", F.round(c, 2)), F.lit("."), F.lit(",")))
    if kind == "number":
        return values.text(F.replace(values.six_decimals(c.cast("double")), F.lit("."), F.lit(",")))
    return values.text(c.cast("string"))


def typed_cells(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """All columns as cell texts by kind."""
    return df.select(*[cell_text(F.col(f"`{c}`"), kinds.get(c, "text")).alias(c) for c in df.columns])


def densified(cells: Column, width: int | Column) -> Column:
    """A sparse row (map of column number to text) as an array without gaps."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit("")))
