"""Stretches of text with the same looks (bold, italic, code, link), as readers of Markdown and HTML give them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa

RUN_TYPE = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("code", pa.bool_()), ("link", pa.string())])
BLOCK_SCHEMA = (
    "doc_id long, block_no int, kind string, level int, ordered boolean, text string, rows array<array<string>>, extra string, "
    "runs array<struct<text:string,bold:boolean,italic:boolean,code:boolean,link:string>>"
)
BLOCK_TYPES = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.list_(pa.string())), pa.string(), pa.list_(RUN_TYPE))
BLOCK_NAMES = ("doc_id", "block_no", "kind", "level", "ordered", "text", "rows", "extra", "runs")


class Run(NamedTuple):
    text: str
    bold: bool = False
    italic: bool = False
    code: bool = False
    link: str | None = None


def merged(runs: Iterable[Run]) -> list[Run]:
    """Neighbours of the same looks as one; empty ones go."""
    out: list[Run] = []
    for run in runs:
        if out and out[-1][1:] == run[1:]:
            out[-1] = out[-1]._replace(text=out[-1].text + run.text)
        elif run.text:
            out.append(run)
    return out


def squeezed(runs: Iterable[Run]) -> list[Run]:
    """White space as one space, also from run to run, and none at the ends."""
    out: list[Run] = []
    for run in merged(runs):
        text = re.sub(r"\s+", " ", run.text)
        if not out or out[-1].text.endswith(" "):
            text = text.removeprefix(" ")
        if text:
            out.append(run._replace(text=text))
    while out and not out[-1].text.rstrip():
        out.pop()
    if out:
        out[-1] = out[-1]._replace(text=out[-1].text.rstrip())
    return merged(out)


def plain(runs: Iterable[Run]) -> str:
    return "".join(r.text for r in runs)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of BLOCK_SCHEMA."""
    columns = list(zip(*rows)) or [[]] * len(BLOCK_TYPES)
    columns[-1:] = [[[r._asdict() for r in runs] for runs in columns[-1]]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, BLOCK_TYPES)], names=list(BLOCK_NAMES))
