"""Delimited tables as Italian spreadsheets open them: ``;``, byte-order mark, comma decimals, dd/mm/yyyy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tessera.operators.mapping import typed_cells

BOM = chr(0xFEFF)


def write_delimited(df: DataFrame, path: str, kinds: Mapping[str, str] = {}, headers: Mapping[str, str] = {}) -> None:  # noqa: B006
    """A file per partition, each with the mark and the header; the mark is part of the first header cell."""
    cells = typed_cells(df, dict(kinds))
    names = [headers.get(c, c) for c in df.columns]
    names[0] = BOM + names[0]
    cells.toDF(*names).write.option("sep", ";").option("quote", '"').option("escape", '"').option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
