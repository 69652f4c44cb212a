"""HTML pages as blocks, by the standard library's event parser, one page at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import charsets
from tessera.sources.runs import BLOCK_SCHEMA, Run, batch, merged, plain, squeezed

SKIPPED = {"script", "style", "noscript", "template", "svg"}
#: What may stand in a head without ending it.
HEAD = {"title", "meta", "link", "base", *SKIPPED}
LOOKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "code": "code", "kbd": "code", "samp": "code"}
TITLES = {f"h{k}": k for k in range(1, 7)}
FLOWS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "body", "html", "figure", "address", "form", "dl", "dt", "dd"}


class _Blocks(HTMLParser):
    """Collects (kind, level, ordered, text, rows, extra, runs)."""

    def __init__(self):
        super().__init__()
        self.out: list[tuple] = []
        self.runs: list[Run] = []
        self.skip = 0
        self.head = False
        self.lists: list[bool] = []
        self.open: list[str] = []
        self.looks: list[str] = []
        self.links: list[str] = []
        self.table: list[list[str]] | None = None
        self.inner = 0  # tables inside the table's cells, whose texts are the cell's

    def say(self, text: str) -> None:
        on = {LOOKS[t] for t in self.looks}
        self.runs.append(Run(text, "bold" in on, "italic" in on, "code" in on, self.links[-1] if self.links else None))

    def flush(self) -> None:
        kind = next((t for t in reversed(self.open) if t in TITLES or t in ("li", "blockquote", "pre")), "")
        raw, self.runs = self.runs, []
        runs = merged([Run(plain(raw).strip("\n"))]) if kind == "pre" else squeezed(raw)
        text = plain(runs)
        if not text.strip():
            return
        if self.table is not None:
            if self.table and self.table[-1]:
                self.table[-1][-1] = f"{self.table[-1][-1]} {text}".strip()
            return
        name = {"li": "list", "blockquote": "quote", "pre": "code"}.get(kind, "title" if kind in TITLES else "paragraph")
        level = TITLES.get(kind, max(0, len(self.lists) - 1) if name == "list" else 0)
        self.out.append((name, level, bool(self.lists and self.lists[-1]) and name == "list", text, None, "", runs))

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif tag not in HEAD:  # a head's end tag may be missing
            self.head = False
        if tag in SKIPPED:
            self.skip += 1
        if self.skip or self.head:
            return
        if tag == "br":
            self.say("\n" if "pre" in self.open else " ")
        elif tag in LOOKS:
            self.looks.append(tag)
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
        elif tag == "hr":
            self.flush()
            self.out.append(("rule", 0, False, "", None, "", []))
        elif tag == "img":
            self.flush()
            names = dict(attrs)
            self.out.append(("image", 0, False, names.get("alt") or "", None, names.get("src") or "", []))
        elif tag == "table":
            self.flush()
            if self.table is None:
                self.table = []
            else:
                self.inner += 1
        elif tag == "tr" and self.table is not None:
            self.flush()
            if not self.inner:
                self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.flush()
            if not self.inner:
                self.table[-1].append("")
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append(tag == "ol")
        elif tag in TITLES or tag in ("li", "blockquote", "pre"):
            self.flush()
            self.open.append(tag)
        elif tag in FLOWS:
            self.flush()

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip or self.head:
            return
        if tag in LOOKS and tag in self.looks:
            del self.looks[len(self.looks) - 1 - self.looks[::-1].index(tag)]
        elif tag == "a":
            self.links = self.links[:-1]
        elif tag == "table" and self.table is not None:
            self.flush()
            if self.inner:
                self.inner -= 1
                return
            rows, self.table = [r for r in self.table if any(r)], None
            if rows:
                self.out.append(("table", 0, False, " ".join(c for r in rows for c in r if c), rows, "", []))
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = self.lists[:-1]
        elif tag in TITLES or tag in ("li", "blockquote", "pre"):
            self.flush()
            if tag in self.open:  # by name, so a stray end tag closes nothing else
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag)]
        elif tag in FLOWS or tag in ("td", "th", "tr"):
            self.flush()

    def handle_data(self, data):
        if not self.skip and not self.head:
            self.say(data)


def page_blocks(html: str | None) -> list[tuple]:
    """The blocks of a page; an unfinished page gives what it has."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def read_html(pages: DataFrame) -> DataFrame:
    """Blocks of ``pages(doc_id, html)``, with runs. Pages that aren't UTF-8 are read in the set they declare, else as Windows-1252."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield batch([(d, k, *b) for d, h in zip(part.column(0).to_pylist(), part.column(1)) for k, b in enumerate(page_blocks(h.as_py()))])

    text = charsets.repaired(F.col("html"), page=True).alias("html")
    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, BLOCK_SCHEMA)
