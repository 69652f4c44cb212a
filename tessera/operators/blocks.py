"""Documents as blocks: rows (doc_id, block_no, kind, level, ordered, text).

Kinds: title, paragraph, list, quote, code, table, image, rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.texts import squeezed, words
from tessera.operators import folds

PREVIEW_BLOCKS = 40
LIST_ITEM = r"^([-*•·]|\d+[.)])\s+"
_ITEM_LINE = r"(?m)^([ \t]*(?:[-*•]|\d+[.)])[ \t]+.*)$"


def flat_blocks(text: Column) -> Column:
    """Array of struct(kind, level, ordered, text) of a plain text: blank lines end a paragraph, list lines are items.

    All in one row: separators (U+0001, which the text itself loses) are put round list lines, and the text is cut at them and
    at blank lines.
    """
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x01"), F.lit("")), _ITEM_LINE, "\x01$1\x01")
    parts = F.split(F.regexp_replace(marked, r"\n[ \t\r]*\n", "\x01"), "\x01")
    parts = F.filter(parts, lambda p: squeezed(p) != "")

    def block(p):
        item = F.ltrim(F.regexp_replace(p, r"^\n+", "")).rlike(LIST_ITEM) & ~F.contains(F.trim(F.translate(p, "\n", " ")), F.lit("\x01"))
        indent = F.length(F.regexp_extract(F.regexp_replace(p, r"^\n+", ""), r"^([ \t]*)", 1))
        return F.struct(
            F.when(item, "list").otherwise("paragraph").alias("kind"),
            F.when(item, F.floor(indent / 2)).otherwise(0).cast("int").alias("level"),
            (item & F.ltrim(p).rlike(r"^\d")).alias("ordered"),
            squeezed(F.when(item, F.regexp_replace(F.ltrim(p), LIST_ITEM, "")).otherwise(p)).alias("text"),
        )

    return F.filter(F.transform(parts, block), lambda b: b["text"] != "")


def exploded(docs: DataFrame, blocks: Column) -> DataFrame:
    """One row per block."""
    return docs.select("doc_id", F.posexplode(blocks).alias("block_no", "b")).select("doc_id", "block_no", "b.*")


def not_blank(blocks: DataFrame) -> DataFrame:
    """Without blocks that have no text; rules and images need none."""
    return blocks.where(F.col("kind").isin("rule", "image") | (F.trim("text") != ""))


def merged_code(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "block_no", extra: str = "extra") -> DataFrame:
    """Code blocks in a row with the same language as one, their texts joined by line ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = (F.col("kind") == "code") & (F.lag("kind").over(w) == "code") & F.col(extra).eqNullSafe(F.lag(extra).over(w))
    islands = blocks.withColumn("_island", F.sum(F.when(same, 0).otherwise(1)).over(w))
    listed = F.array_sort(F.collect_list(F.struct(order, "text")))
    return islands.groupBy(*keys, "_island").agg(
        F.min(order).alias(order), F.min("kind").alias("kind"), F.min(extra).alias(extra), F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_merged")
    ).drop("_island")


def merged_runs(runs: Column) -> Column:
    """Runs (text, bold, italic, code, link) in a row with the same looks as one; empty ones go.

    Each run is looked at once: first where the looks change, then each stretch between two changes as one run.
    """
    runs = F.filter(runs, lambda r: r["text"] != "")
    looks = ("bold", "italic", "code", "link")

    def merge(all_runs):
        def changes(i):
            here, before = F.get(all_runs, i), F.get(all_runs, i - 1)
            out = i == 0
            for k in looks:
                out |= ~here[k].eqNullSafe(before[k])
            return out

        starts = F.filter(F.sequence(F.lit(0), F.size(all_runs) - 1), changes)
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(all_runs)))

        def stretch(a, b):
            return F.struct(F.array_join(F.transform(F.slice(all_runs, a + 1, b - a), lambda r: r["text"]), "").alias("text"), *[F.get(all_runs, a)[k].alias(k) for k in looks])

        return F.when(F.size(all_runs) > 0, F.zip_with(starts, ends, stretch)).otherwise(F.slice(all_runs, 1, 0))

    # The filtered runs are bound once, as the only element of an array.
    return F.flatten(F.transform(F.array(runs), merge))


def list_numbers(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "block_no") -> DataFrame:
    """Adds ``number`` to ordered list items, counted by level.

    An ordered item starts the levels below it anew; any block that isn't a list starts all; unordered items start none.
    The counters are a stack, so an item costs the same at any depth.
    """

    def step(stack: list[list[int]], kind: str | None, ordered: bool | None, level: int | None) -> int | None:
        if kind != "list":
            stack.clear()
        if kind != "list" or not ordered:
            return None
        level = level or 0
        while stack and stack[-1][0] > level:
            stack.pop()
        if not stack or stack[-1][0] < level:
            stack.append([level, 0])
        stack[-1][1] += 1
        return stack[-1][1]

    return folds.annotated(blocks, keys, [order], ["kind", "ordered", "level"], list, step, "number", "int")


def chapters(blocks: DataFrame, cut: int = 1, keys: Sequence[str] = ("doc_id",), order: str = "block_no") -> DataFrame:
    """Adds ``chapter``: a title of level ``cut`` or less starts one, unless nothing stands before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = (F.col("kind") == "title") & (F.col("level") <= cut) & (F.row_number().over(w) > 1)
    return blocks.withColumn("_starts", starts.cast("int")).withColumn("chapter", F.sum("_starts").over(w)).drop("_starts")


def contents(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), to_level: int = 3) -> DataFrame:
    """Titles to level 3, for a table of contents."""
    return blocks.where((F.col("kind") == "title") & (F.col("level") <= to_level)).select(*keys, "chapter", "block_no", "level", "text")


def heading_levels(lines: DataFrame, sizes: DataFrame, keys: Sequence[str], longest: int = 120) -> DataFrame:
    """Adds ``level``: 1 to 3 for lines in a font 5, 3 or 1.5 above the body size and not too long, else 0."""
    above = F.col("font_size") - F.col("body_size")
    level = F.when(F.length("text") > longest, 0).when(above >= 5, 1).when(above >= 3, 2).when(above >= 1.5, 3).otherwise(0)
    return lines.join(sizes, list(keys)).withColumn("level", level)


def body_size(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, body_size): the font size that most characters have; of equals the smallest."""
    weights = lines.groupBy(*keys, "font_size").agg(F.sum(F.length("text")).alias("_weight"))
    return weights.groupBy(*keys).agg(F.max_by("font_size", F.struct("_weight", -F.col("font_size"))).alias("body_size"))


def paragraph_breaks(lines: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "line_no") -> DataFrame:
    """Adds ``paragraph``: a new one on a new page, and where the gap is over 1.8 times the body size."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.lag("y").over(w) - F.col("y")
    fresh = (F.col("page") != F.lag("page").over(w)) | (gap > 1.8 * F.col("body_size"))
    return lines.withColumn("_fresh", F.coalesce(fresh, F.lit(False)).cast("int")).withColumn("paragraph", F.sum("_fresh").over(w)).drop("_fresh")


def type_counts(blocks: DataFrame) -> DataFrame:
    """How many blocks of each kind, and their words."""
    return blocks.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size(words(F.col("text")))).alias("n_words"))


def preview(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "block_no", n: int = PREVIEW_BLOCKS) -> DataFrame:
    """The first blocks of each document, and whether there are more (``partial``)."""
    sizes = blocks.groupBy(*keys).agg(F.count("*").alias("_n"))
    return blocks.where(F.col(order) < n).join(sizes, list(keys)).withColumn("partial", F.col("_n") > n).drop("_n")


def tagged_lists(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "block_no") -> DataFrame:
    """Adds ``opens`` and ``closes``: where a list element begins and ends in HTML (by kind of list)."""
    w = Window.partitionBy(*keys).orderBy(order)
    tag = F.when(F.col("kind") == "list", F.when(F.col("ordered"), "ol").otherwise("ul"))
    marked = blocks.withColumn("_tag", tag)
    opens = F.when(F.col("_tag").isNotNull() & ~F.col("_tag").eqNullSafe(F.lag("_tag").over(w)), F.col("_tag"))
    closes = F.when(F.col("_tag").isNotNull() & ~F.col("_tag").eqNullSafe(F.lead("_tag").over(w)), F.col("_tag"))
    return marked.withColumn("opens", opens).withColumn("closes", closes).drop("_tag")


def markdown_escaped(c: Column) -> Column:
    """Backslashes and marks escaped; an underscore inside a word is a letter; what would open a block at the start of a line."""
    c = F.regexp_replace(c, r"[\\`*\[\]]|(?<!\w)_|_(?!\w)", r"\\$0")
    return F.regexp_replace(c, r"(?m)^(\s*)([#>+-]|\d+\.)(?=\s)", r"$1\\$2")


def markdown_runs(runs: Column) -> Column:
    """Runs (text, bold, italic, code, link) as a line of Markdown."""

    def run(r):
        out = F.when(r["code"], F.concat(F.lit("`"), r["text"], F.lit("`"))).otherwise(markdown_escaped(r["text"]))
        for look, mark in (("bold", "**"), ("italic", "*")):
            out = F.when(r[look], F.concat(F.lit(mark), out, F.lit(mark))).otherwise(out)
        return F.when(r["link"] != "", F.concat(F.lit("["), out, F.lit("]("), r["link"], F.lit(")"))).otherwise(out)

    return F.trim(F.array_join(F.transform(runs, run), ""))


def markdown(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "block_no") -> DataFrame:
    """(keys, text): each document as Markdown. Blocks have ``number`` where ordered (``list_numbers``).

    Where they are there, ``runs`` give the looks of the text, ``rows`` a table's cells, and ``extra`` a fence's language or
    an image's target.
    """
    of = lambda c, other: F.col(c) if c in blocks.columns else other
    plain, level, extra = markdown_escaped(F.col("text")), F.greatest(F.lit(1), F.col("level")), F.coalesce(of("extra", F.lit("")), F.lit(""))
    if "runs" in blocks.columns:
        plain = F.when(F.size("runs") > 0, markdown_runs(F.col("runs"))).otherwise(plain)
    rendered = (
        F.when(F.col("kind") == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), plain))
        .when(F.col("kind") == "list", F.concat(F.repeat(F.lit("  "), F.col("level")), F.when(F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- "), plain))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.replace(plain, F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "code", F.concat(F.lit("```"), extra, F.lit("\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("kind") == "image", F.concat(F.lit("!["), markdown_escaped(F.col("text")), F.lit("]("), extra, F.lit(")")))
        .when(F.col("kind") == "rule", "---")
    )
    if "rows" in blocks.columns:
        rendered = rendered.when((F.col("kind") == "table") & (F.size("rows") > 0), markdown_table(F.transform("rows", lambda r: F.transform(r, markdown_escaped))))
    w = Window.partitionBy(*keys).orderBy(order)
    # Items of one list stand line under line, all other blocks a blank line apart.
    gap = F.when(F.lag("kind").over(w).isNull(), "").when((F.col("kind") == "list") & (F.lag("kind").over(w) == "list"), "\n").otherwise("\n\n")
    parts = blocks.withColumn("_part", F.concat(gap, rendered.otherwise(plain)))
    listed = F.array_sort(F.collect_list(F.struct(order, "_part")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_part"]), "").alias("text"))


def markdown_table(rows: Column) -> Column:
    """Rows (array of arrays of cells) as a Markdown table, padded to the widest row, the first one as header."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def line(row):
        padded = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.replace(F.coalesce(F.get(row, i), F.lit("")), F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table line: parted by pipes that aren't escaped."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def most_frequent(values: DataFrame, keys: Sequence[str], value: str, order: str, out: str) -> DataFrame:
    """(keys, out): the value met most; of equals the one met first."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_at", value)).alias(out))


def wrapped(text: Column, width: int = 78, lead: Column | int = 0) -> Column:
    """Lines of at most ``width`` characters, filled greedily; longer words stand alone. ``lead``: characters before the first line."""
    zero = F.array().cast("array<string>")
    lead = lead if isinstance(lead, Column) else F.lit(lead)

    def step(acc, word):
        last = F.get(acc, F.size(acc) - 1)
        used = F.length(last) + F.when(F.size(acc) == 1, lead).otherwise(0)
        fits = (F.size(acc) > 0) & (used + 1 + F.length(word) <= width)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, word)))).otherwise(F.concat(acc, F.array(word)))

    return F.aggregate(words(text), zero, step)


def aligned_table(rows: Column) -> Column:
    """Rows (array of arrays of cells) as lines of text: columns as wide as their widest cell, two spaces apart, the first row underlined."""
    cell = lambda r, k: F.coalesce(F.get(r, k), F.lit(""))
    last = F.array_max(F.transform(rows, lambda r: F.size(r))) - 1
    widths = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_max(F.transform(rows, lambda r: F.length(cell(r, k)))))

    def table(widths):
        line = lambda r: F.rtrim(F.array_join(F.transform(widths, lambda w, k: F.rpad(cell(r, k), w, " ")), "  "))
        rule = F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("─"), w)), "  ")
        lines = F.transform(rows, line)
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")

    # the widths are bound once, as the only element of an array
    return F.when(last >= 0, F.get(F.transform(F.array(widths), table), 0)).otherwise("")


def plain_text(blocks: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "block_no", width: int = 78) -> DataFrame:
    """(keys, text): each document as plain text, titles underlined, lines filled, tables aligned, a blank line between blocks.

    Blocks have ``number`` where ordered (``list_numbers``); ``rows`` and ``extra`` are used where they are there.
    """
    kind, level, plain = F.col("kind"), F.col("level"), F.coalesce("text", F.lit(""))
    indent = F.repeat(F.lit("  "), level)
    mark = F.when(F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("· ")
    lead = F.when(kind == "list", F.concat(indent, mark)).when(kind == "quote", F.repeat(F.lit(" "), F.lit(4))).otherwise("")
    hang = F.when(kind == "list", F.concat(indent, F.lit("   "))).when(kind == "quote", F.repeat(F.lit(" "), F.lit(4))).otherwise("")
    filled = F.concat(lead, F.replace(F.array_join(wrapped(plain, width, F.length(lead)), "\n"), F.lit("\n"), F.concat(F.lit("\n"), hang)))
    under = lambda sign: F.concat(F.lit("\n"), F.repeat(F.lit(sign), F.least(F.length(plain), F.lit(width))))
    title = F.when(level <= 1, F.concat(F.upper(plain), under("═"))).when(level == 2, F.concat(plain, under("─"))).otherwise(F.concat(F.repeat(F.lit("  "), level - 3), plain))
    name = F.when(plain != "", plain).otherwise(F.substring_index("extra", "/", -1) if "extra" in blocks.columns else plain)
    body = (
        F.when(kind == "title", title)
        .when(kind == "rule", F.repeat(F.lit("─"), F.lit(width)))
        .when(kind == "code", F.concat(F.lit("    "), F.replace(plain, F.lit("\n"), F.lit("\n    "))))
        .when(kind == "image", F.concat(F.lit("[immagine: "), name, F.lit("]")))
    )
    if "rows" in blocks.columns:
        body = body.when((kind == "table") & (F.size("rows") > 0), aligned_table(F.col("rows")))
    listed = F.array_sort(F.collect_list(F.struct(order, body.otherwise(filled).alias("_body"))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_body"]), "\n\n").alias("text"))


#: What a format can't hold, by format and kind of block, in the words that are shown.
LOST = {
    "txt": {"image": "immagini non riportate", "table": "tabelle ridotte a testo", "title": "livelli dei titoli ridotti a due"},
    "csv": {"image": "immagini non riportate", "title": "titoli non riportati", "list": "elenchi non riportati", "quote": "citazioni non riportate", "code": "codice non riportato"},
    "md": {},
}


def losses(blocks: DataFrame, format: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The loss register: (keys, reason, field, n, severity) of what ``format`` doesn't hold of each document."""
    reasons = LOST[format]
    reason = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in reasons.items()], F.lit(None).cast("string"))
    found = blocks.withColumn("reason", reason).where("reason is not null").groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return found.withColumns({"field": F.lit(format.upper()), "severity": F.lit("informativa")})
