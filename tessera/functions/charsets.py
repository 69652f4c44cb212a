"""Bytes to text: UTF-8 where it is that, a declared set, else Windows-1252. All in expressions.

Sets of one byte a character are read as Latin-1 and translated, by tables that come from Python's codecs.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 2048
#: Names under which pages declare sets of one byte; Latin-1 is read as Windows-1252, whose signs it lacks.
SINGLE = {
    "windows-1252": ("windows-1252", "cp1252", "iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii"), "iso-8859-15": ("iso-8859-15", "latin9", "latin-9"),
    "windows-1250": ("windows-1250", "cp1250"), "iso-8859-2": ("iso-8859-2", "latin2"), "windows-1251": ("windows-1251", "cp1251"), "iso-8859-5": ("iso-8859-5",),
    "koi8-r": ("koi8-r",), "windows-1253": ("windows-1253", "cp1253"), "iso-8859-7": ("iso-8859-7",), "windows-1254": ("windows-1254", "cp1254", "iso-8859-9", "latin5"), "mac-roman": ("macintosh", "x-mac-roman"),
}
WIDE = {"utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}


@cache
def _table(name: str) -> tuple[str, str]:
    """Characters of Latin-1 that stand for others in a set, and those others."""
    pairs = [(chr(b), bytes([b]).decode(name, "replace")) for b in range(128, 256)]
    changed = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed)


def latin(data: Column) -> Column:
    """Each byte as the character of its number; nothing is lost."""
    return F.decode(data, "ISO-8859-1")


def single(data: Column, name: str = "windows-1252") -> Column:
    return F.translate(latin(data), *_table(name))


def declared(head: Column) -> Column:
    """The set that the first 2 KB of a page name in small letters, or null."""
    found = F.lower(F.regexp_extract(F.substring(head, 1, HEAD), r"(?i)charset\s*=\s*[\"']?\s*([a-z0-9_-]+)", 1))
    return F.nullif(found, F.lit(""))


def _by_name(data: Column, name: Column) -> Column:
    out = F.lit(None).cast("string")
    for codec, names in SINGLE.items():
        out = F.when(name.isin(*names), single(data, codec)).otherwise(out)
    for known, codec in WIDE.items():
        # an odd last byte isn't a character
        even = F.substring(data, F.lit(1), F.length(data) - F.length(data) % 2)
        out = F.when((name == known) & (F.length(data) > 1), F.decode(even, codec)).otherwise(out)
    return out


def as_text(data: Column, page: bool = False) -> Column:
    """A file's bytes as text, without a byte order mark; page: a set that it declares counts first."""
    plain = data.cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(single(data))
    if page:
        text = F.coalesce(_by_name(data, declared(latin(F.substring(data, 1, HEAD)))), text)
    return F.regexp_replace(text, "^﻿", "")


def repaired(text: Column, page: bool = False) -> Column:
    """A text as it is; one that isn't UTF-8 is read anew from its bytes."""
    return F.when(F.is_valid_utf8(text), text).otherwise(as_text(text.cast("binary"), page))
