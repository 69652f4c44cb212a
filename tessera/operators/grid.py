"""Tables out of page geometry: pieces of text with positions become rows and columns.

A piece is (page, x, y, text, width). Pages are independent until columns are found, for which only the distinct
places that text covers are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lookups, texts
from tessera.operators import folds
from tessera.operators.mapping import unique_header
from tessera.sinks.scratch import written


def estimated_width(c: Column, font: Column) -> Column:
    return F.length(c) * font * 0.5


def not_blank(pieces: DataFrame) -> DataFrame:
    """Without pieces of white space only (any that Unicode knows)."""
    return pieces.where(F.coalesce("text", F.lit("")).rlike(r"(?U)\S"))


def head_sample(pieces: DataFrame, book: Sequence[str], most_pages: int = 300, first_pages: int = 30) -> DataFrame:
    """The first pages of books with more than ``most_pages``, all of the others; ``sampled`` says which.

    For analyses at a glance: of a sampled book, counts over all pages aren't known (``known_count``).
    """
    sizes = pieces.groupBy(*book).agg((F.max("page") > most_pages).alias("sampled"))
    return pieces.join(sizes, list(book)).where(~F.col("sampled") | (F.col("page") <= first_pages))


def known_count(n: Column) -> Column:
    """A count, null for sampled books."""
    return F.when(~F.col("sampled"), n)


def cluster_rows(pieces: DataFrame, keys: Sequence[str] = ("page",), tolerance: float = 3.0) -> DataFrame:
    """Adds ``row``: pieces from the top down, a new row where y is more than the tolerance below the row's first piece.

    The distance counts from the row's first piece, not from the last one: a fold over the page's pieces.
    """

    def step(state: list, y: float) -> int:
        if state[0] is None or state[0] - y > tolerance:
            state[:] = y, state[1] + 1
        return state[1]

    return folds.annotated(pieces, keys, [F.desc("y"), "x"], ["y"], lambda: [None, -1], step, "row", "int")


def line_signatures(rows: DataFrame, keys: Sequence[str], text: str = "text", pieces: str = "pieces") -> DataFrame:
    """Adds ``signature`` and ``digit_signature`` to printed lines."""
    sig = texts.signature(F.col(text))
    return rows.withColumn("signature", sig).withColumn("digit_signature", texts.digit_signature(F.col("signature"), F.col(pieces)))


def recurring(lines: DataFrame, book: Sequence[str], page: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """(book, signature) of lines on at least ``share`` of the book's pages, and on ``least``."""
    pages = lines.groupBy(*book).agg(F.count_distinct(page).alias("_pages"))
    both = F.array_compact(F.array("signature", "digit_signature")) if "digit_signature" in lines.columns else F.array("signature")
    seen = lines.select(*book, page, F.explode(F.array_distinct(both)).alias("signature")).distinct().groupBy(*book, "signature").agg(F.count("*").alias("n_pages"))
    enough = F.greatest(F.lit(least), F.floor(F.col("_pages") * share))
    return seen.join(pages, list(book)).where((F.col("_pages") >= least) & (F.col("n_pages") >= enough)).select(*book, "signature", "n_pages")


def without_recurring(lines: DataFrame, book: Sequence[str], page: str, **options) -> DataFrame:
    """Lines whose signature doesn't recur."""
    bad = recurring(lines, book, page, **options).drop("n_pages")
    out = lines.join(bad, [*book, "signature"], "left_anti")
    if "digit_signature" in lines.columns:
        out = out.join(bad.withColumnRenamed("signature", "digit_signature"), [*book, "digit_signature"], "left_anti")
    return out


def corridors(pieces: DataFrame, book: Sequence[str], corridor: float = 6.0) -> DataFrame:
    """(book, boundary): the middle of each empty stretch, at least ``corridor`` wide, between places that text covers."""
    places = pieces.select(*book, F.explode(F.sequence(F.floor("x").cast("int"), F.ceil(F.col("x") + F.col("width")).cast("int"))).alias("place")).distinct()
    before = F.lag("place").over(Window.partitionBy(*book).orderBy("place"))
    gaps = places.withColumn("_before", before).where(F.col("place") - F.col("_before") - 1 >= corridor)
    return gaps.select(*book, ((F.col("_before") + 1 + F.col("place")) / 2).alias("boundary"))


def assign_columns(pieces: DataFrame, boundaries: DataFrame, book: Sequence[str]) -> DataFrame:
    """Adds ``column``: how many boundaries are at or left of the piece. A book has as many as fit into its width."""
    listed = boundaries.groupBy(*book).agg(F.sort_array(F.collect_set("boundary")).alias("_bounds"))
    both = pieces.join(listed, list(book), "left")
    return both.withColumn("column", lookups.rank_in(F.coalesce("_bounds", F.array().cast("array<double>")), F.col("x"))).drop("_bounds")


def cells(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces of a row and column as one text, from the top down, then left to right."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "text")))
    return pieces.groupBy(*keys, "row", "column").agg(F.array_join(F.transform(listed, lambda p: p["text"]), " ").alias("text"))


def sparse_rows(cell_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A map of column to text per row."""
    return cell_rows.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("cells"))


def repeated_header(rows: DataFrame, book: Sequence[str]) -> DataFrame:
    """(book, header): of the recurring rows of page 1 that stand above its first other row, the one that fills most columns; ties go to the last.

    Rows have ``recurs``, ``row``, ``y`` and ``cells`` (a map).
    """
    first = rows.where(F.col("page") == 1)
    data_y = F.max(F.when(~F.col("recurs"), F.col("y"))).over(Window.partitionBy(*book))
    above = first.withColumn("_data_y", data_y).where(F.col("recurs") & (F.col("y") > F.coalesce("_data_y", F.lit(float("-inf")))))
    return above.groupBy(*book).agg(F.max_by("cells", F.struct(F.size("cells"), "row")).alias("header"))


@dataclass(frozen=True)
class Found:
    """A book's table: rows (book, page, row, cells as an array), columns (book, names, n_columns), and what recurs (book, signature, n_pages)."""

    rows: DataFrame
    columns: DataFrame
    repeated: DataFrame


def tables(pieces: DataFrame, book: Sequence[str], corridor: float = 6.0, named: bool = True, skip_repeated: bool = True) -> Found:
    """The table of each book of positioned pieces (book, page, x, y, text, width), in two passes.

    The first finds the lines that recur from page to page; the second the corridors between columns, of all other lines.
    named: columns have the names of the repeated header; if no header recurs, those of the first data row, which then is no
    data; else they are ``Colonna n``. Without skip_repeated, recurring lines are data too. Blank rows are left out.
    """
    page = [*book, "page"]
    placed = written(cluster_rows(not_blank(pieces), page), "table-pieces")
    down = F.struct((-F.col("y")).alias("down"), "x", "text")
    lines = placed.groupBy(*page, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(down)), lambda p: p["text"]), " ").alias("text"), F.count("*").alias("pieces"), F.max("y").alias("y"))
    lines = written(line_signatures(lines, []), "table-lines")
    repeated = written(recurring(lines, book, "page"), "table-repeated")
    either = [repeated.select(*book, F.col("signature").alias(c), F.lit(True).alias(f"_{c}")) for c in ("signature", "digit_signature")]
    marked = lines.join(either[0], [*book, "signature"], "left").join(either[1], [*book, "digit_signature"], "left")
    marked = written(marked.select(*page, "row", "y", F.coalesce("_signature", "_digit_signature", F.lit(False)).alias("recurs")), "table-marks")
    pieces = placed.join(marked.select(*page, "row", "recurs"), [*page, "row"])
    bounds = written(corridors(pieces.where("NOT recurs"), book, corridor), "table-bounds")
    widths = placed.select(*book).distinct().join(bounds.groupBy(*book).agg(F.count("*").alias("_n")), list(book), "left")
    widths = widths.select(*book, (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias("n_columns"))
    sparse = sparse_rows(cells(assign_columns(pieces, bounds, book), page), page).join(marked, [*page, "row"])
    sparse = written(sparse, "table-rows")
    data = sparse.where(~F.col("recurs")) if skip_repeated else sparse
    header = widths
    if named:
        above = repeated_header(sparse, book) if skip_repeated else repeated_header(sparse.limit(0), book)
        head_row = data.groupBy(*book).agg(F.min_by(F.struct("page", "row", "cells"), F.struct("page", "row")).alias("_first"))
        header = widths.join(above, list(book), "left").join(head_row, list(book), "left")
        header = header.withColumns({"cells": F.coalesce("header", "_first.cells"), "_used": F.when(F.col("header").isNull(), F.struct("_first.page", "_first.row"))})
        data = data.join(header.where("_used IS NOT NULL").select(*book, F.col("_used.page").alias("page"), F.col("_used.row").alias("row")), [*page, "row"], "left_anti")
        names = unique_header(F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(""))))
    else:
        names = unique_header(F.array_repeat(F.lit(""), F.col("n_columns")))
    columns = written(header.select(*book, names.alias("names"), "n_columns"), "table-columns")
    dense = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit("")))
    rows = data.join(columns, list(book)).select(*page, "row", dense.alias("cells"))
    return Found(rows.where(F.trim(F.array_join("cells", "")) != ""), columns, repeated)


def named_table(found: Found, book: dict[str, object]) -> DataFrame:
    """One book's rows under its own column names, in order by page and row."""
    own = F.lit(True)
    for c, value in book.items():
        own &= F.col(c).eqNullSafe(F.lit(value))
    names = found.columns.where(own).first()
    rows = found.rows.where(own)
    return rows.select("page", "row", *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names.names if names else [])])


def anchor_bands(anchors: DataFrame, book: Sequence[str]) -> DataFrame:
    """(book, label, low, high): each label's band of x, with boundaries midway between labels."""
    w = Window.partitionBy(*book).orderBy("x")
    return anchors.select(
        *book,
        "label",
        F.coalesce((F.lag("x").over(w) + F.col("x")) / 2, F.lit(float("-inf"))).alias("low"),
        F.coalesce((F.lead("x").over(w) + F.col("x")) / 2, F.lit(float("inf"))).alias("high"),
    )


def in_bands(pieces: DataFrame, bands: DataFrame, book: Sequence[str]) -> DataFrame:
    """Adds ``label``, the band that a piece's x lies in: an equi-join on the book, one array of bands each, which adjoin."""
    listed = bands.groupBy(*book).agg(F.array_sort(F.collect_list(F.struct("low", "high", "label"))).alias("_bands"))
    both = pieces.join(listed, list(book)).withColumn("_band", F.get("_bands", lookups.rank_in(F.transform("_bands", lambda b: b["low"]), F.col("x")) - 1))
    return both.withColumn("label", F.when(F.col("x") < F.col("_band.high"), F.col("_band.label"))).drop("_bands", "_band")


def numbered_records(pieces: DataFrame, starts: DataFrame, page: Sequence[str], pitch: float = 10.2) -> DataFrame:
    """Adds ``record``, ``line`` and ``is_start``: the last start that is above the piece, or at most half a pitch below it, and the line from there.

    Starts (rows like the pieces) are sorted among the pieces from the top down, and stay as rows of their own, so each of
    them has a record. What stands above all starts is left out.
    """
    marks = starts.withColumns({"_top": F.col("y"), "_edge": F.col("y") + pitch / 2})
    both = pieces.withColumn("_edge", F.col("y")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*page).orderBy(F.desc("_edge"), F.col("_top").isNull(), "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({"record": F.count("_top").over(w).cast("int") - 1, "_above": F.last("_top", ignorenulls=True).over(w), "is_start": F.col("_top").isNotNull()})
    line = F.greatest(F.round((F.col("_above") - F.col("y")) / pitch), F.lit(0)).cast("int")
    return found.where(F.col("record") >= 0).withColumn("line", line).drop("_top", "_above", "_edge")


def record_bands(pieces: DataFrame, starts: DataFrame, book: Sequence[str], pitch: float = 10.2) -> DataFrame:
    """``numbered_records`` for starts that are known by their y alone; the starts themselves are left out."""
    marks = starts.select(*book, "y").distinct().withColumn("x", F.lit(0.0))
    plain = pieces if "x" in pieces.columns else pieces.withColumn("x", F.lit(0.0))
    found = numbered_records(plain, marks, book, pitch).where(~F.col("is_start")).drop("is_start")
    return found.select(*pieces.columns, "record", "line")


def anchored(pieces: DataFrame, anchors: Sequence[tuple[str, Sequence[str] | None]], page: Sequence[str], pitch: float = 10.2) -> DataFrame:
    """Adds ``label`` and ``header_y``: the column of a printed table that a piece stands in, by the labels in the page's header.

    anchors: (key, the ways its label may be written), from the left. The first one's label is looked for from the top, and
    its line is the header's; the others must stand within half a pitch of it. A key without labels is printed vertically:
    its place is that of the first piece in the header's line between its neighbours, else midway between them. Columns meet
    midway between places. Pages on which a place is missing hold no table and are left out. A vertical column next to another
    one has no place.
    """
    number, texts_of = anchors[0][0], [t for _, labels in anchors for t in labels or ()]
    known = pieces.select(*page, "x", "y", F.trim("text").alias("text")).where(F.col("text").isin(texts_of))
    listed = known.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "text"))).alias("_known"))
    head = F.get(F.filter("_known", lambda p: p["text"].isin(*anchors[0][1])), 0)
    pages = listed.withColumn("_head", head).where("_head IS NOT NULL").withColumn("header_y", -F.col("_head.down"))

    def place(labels: Sequence[str]) -> Column:
        return F.get(F.filter("_known", lambda p: (F.abs(-p["down"] - F.col("header_y")) <= pitch / 2) & p["text"].isin(*labels)), 0)["x"]

    pages = pages.withColumns({f"_x_{number}": F.col("_head.x"), **{f"_x_{k}": place(labels) for k, labels in anchors[1:] if labels}}).drop("_known", "_head")
    for k, labels in anchors:
        if labels:
            pages = pages.where(F.col(f"_x_{k}").isNotNull())
    out = pieces.join(pages, list(page))
    for (before, _), (key, labels), (after, _) in zip(anchors, anchors[1:], anchors[2:]):
        if not labels:
            low, high = F.col(f"_x_{before}"), F.col(f"_x_{after}")
            between = (F.abs(F.col("y") - F.col("header_y")) < 1) & (F.col("x") > low) & (F.col("x") < high)
            first = F.min_by("x", F.when(between, F.struct(-F.col("y"), "x"))).over(Window.partitionBy(*page))
            out = out.withColumn(f"_x_{key}", F.coalesce(first, (low + high) / 2))
    places = [F.col(f"_x_{k}") for k, _ in anchors]
    x, label = F.col("x"), F.lit(None).cast("string")
    for k in reversed(range(len(anchors))):  # the first column that takes the piece counts
        inside = F.lit(True)
        if k:
            inside &= x >= (places[k - 1] + places[k]) / 2
        if k + 1 < len(anchors):
            inside &= x < (places[k] + places[k + 1]) / 2
        label = F.when(inside, anchors[k][0]).otherwise(label)
    return out.withColumn("label", label).drop(*[f"_x_{k}" for k, _ in anchors])


RECORD_NUMBER = r"^\s*(\d{1,3}(\.\d{3})+|\d{3,6})\s*$"


def is_record_start(label: Column, y: Column, text: Column, below: Column, first: str) -> Column:
    """Under the header, in the first column, a record number: 3 to 6 digits, or with dots by threes."""
    return (y < below) & (label == first) & text.rlike(RECORD_NUMBER)


def _sorted_pieces() -> Column:
    """A record's pieces as an array, from the top down and left to right."""
    return F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "label", "line", "text")))


def field_columns(pieces: str, placements: Sequence[tuple[str, str, str, int]]) -> list[Column]:
    """A column for each field that a layout declares, out of a record's sorted pieces: (field, label, mode, line).

    ``line``: the pieces on that line of the column, a space between them; ``number``: the same without any space, as a
    number's parts are printed apart; ``all``: the pieces of all lines, each on its own.
    """

    def fields(label: str, mode: str, line: int) -> Column:
        if mode == "all":
            return F.array_join(F.transform(F.filter(pieces, lambda p: p["label"] == label), lambda p: F.rtrim(p["text"])), "\n")
        inside = F.filter(pieces, lambda p: (p["label"] == label) & (p["line"] == line))
        joined = F.trim(F.array_join(F.transform(inside, lambda p: F.trim(p["text"])), " "))
        return F.regexp_replace(joined, r"\s+", "") if mode == "number" else joined

    return [fields(*how).alias(field) for field, *how in placements]


def place_fields(pieces: DataFrame, keys: Sequence[str], placements: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    """A row per record with the fields that the layout declares. Pieces have label, line, x and y."""
    return pieces.groupBy(*keys).agg(_sorted_pieces().alias("_p")).select(*keys, *field_columns("_p", placements))


def _texts_of(pieces: str, label: str) -> Column:
    return F.transform(F.filter(pieces, lambda p: p["label"] == label), lambda p: p["text"])


PHONE_PIECE = r"^\+?\d[\d\s./+-]*$"


def identity_columns(pieces: Column) -> dict[str, Column]:
    """surname, name, phone and email out of the sorted texts of one column, by what they hold.

    What has an ``@`` is part of the email, what has only digits and separators part of the phone. Of the rest, the very first
    piece is the surname, and all others the name.
    """
    named = F.filter(F.transform(pieces, lambda t: F.trim(t)), lambda t: t != "")
    is_email = lambda t: F.contains(t, F.lit("@"))
    is_phone = lambda t: ~is_email(t) & t.rlike(PHONE_PIECE)
    is_name = lambda t: ~is_email(t) & ~t.rlike(PHONE_PIECE)
    names, first = F.filter(named, is_name), F.get(named, 0)
    led = F.coalesce(is_name(first), F.lit(False))
    rest = F.slice(names, F.when(led, 2).otherwise(1), F.greatest(F.size(names), F.lit(1)))
    return {"surname": F.when(led, first).otherwise(""), "name": F.array_join(rest, " "), "phone": F.array_join(F.filter(named, is_phone), " "), "email": F.array_join(F.filter(named, is_email), "")}


def identity_fields(pieces: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """surname, name, phone and email of each record from the pieces of one column."""
    listed = pieces.groupBy(*keys).agg(_sorted_pieces().alias("_p")).select(*keys, _texts_of("_p", label).alias("_who"))
    return listed.select(*keys, *[c.alias(name) for name, c in identity_columns(F.col("_who")).items()])


def records(pieces: DataFrame, page: Sequence[str], anchors: Sequence[tuple[str, Sequence[str] | None]], placements: Sequence[tuple[str, str, str, int]], who: str, header_lines: int, pitch: float = 10.2) -> DataFrame:
    """Printed records as rows: (page, record, number, surname, name, phone, email, fields).

    Labels give columns, numbers in the first column give records, and a record's pieces its fields: one shuffle by page.
    """
    first = anchors[0][0]
    cells = anchored(not_blank(pieces), anchors, page, pitch).withColumn("_below", F.col("header_y") - ((header_lines - 1) * pitch + 4))
    cells = cells.where(F.col("y") < F.col("_below"))
    starts = cells.where(is_record_start(F.col("label"), F.col("y"), F.col("text"), F.col("_below"), first))
    found = numbered_records(cells, starts, page, pitch)
    number = F.max(F.when(F.col("is_start"), F.trim("text"))).alias("number")
    inside = found.withColumn("label", F.when(~F.col("is_start"), F.col("label")))
    rows = inside.groupBy(*page, "record").agg(number, _sorted_pieces().alias("_p")).withColumn("_who", _texts_of("_p", who))
    return rows.select(*page, "record", "number", *[c.alias(n) for n, c in identity_columns(F.col("_who")).items()], *field_columns("_p", placements))


def layout(pages: DataFrame, titles: Sequence[tuple[str, str]], book: Sequence[str]) -> DataFrame:
    """(book, layout): the first layout, by priority, whose title stands on the book's first page; null if none."""
    named = F.coalesce(*[F.when(F.contains("text", F.lit(title)), name) for name, title in titles], F.lit(None).cast("string"))
    return pages.where(F.col("page") == 1).groupBy(*book).agg(F.min_by(named, F.lit(0)).alias("layout"))


def page_period(pieces: DataFrame, book: Sequence[str]) -> DataFrame:
    """(book, first, last): the days of the first ``Dal … al …`` of each book, from the top."""
    pattern = r"(?i)dal\s+(\d{1,2}/\d{1,2}/\d{2,4})\s+al\s+(\d{1,2}/\d{1,2}/\d{2,4})"
    found = pieces.where(F.col("text").rlike(pattern))
    first = F.min_by("text", F.struct("page", -F.col("y")))
    return found.groupBy(*book).agg(first.alias("_t")).select(*book, F.regexp_extract("_t", pattern, 1).alias("first"), F.regexp_extract("_t", pattern, 2).alias("last"))


def page_header(pieces: DataFrame, book: Sequence[str], title: str = "Stampa", left: float = 40, above: float = 500) -> DataFrame:
    """(book, structure, first, last) of each book's first page: the first longer text in its upper left corner that isn't the title, and the period."""
    upper = pieces.where(F.col("page") == 1).withColumn("text", F.trim("text"))
    is_name = (F.col("x") < left) & (F.col("y") > above) & (F.length("text") > 8) & ~F.startswith("text", F.lit(title))
    named = upper.groupBy(*book).agg(F.coalesce(F.min_by("text", F.when(is_name, F.struct(-F.col("y"), "x"))), F.lit("")).alias("structure"))
    return named.join(page_period(upper, book), list(book), "left")


def named_rows(rows: DataFrame, header: Sequence[str] | None, width: int) -> DataFrame:
    """Dense rows under the repeated header's names, else under ``Colonna n``."""
    from tessera.operators.mapping import densified, unique_names

    names = unique_names([*(header or []), *[""] * width][:width])
    dense = rows.withColumn("_cells", densified(F.col("cells"), width))
    return dense.select(*[c for c in rows.columns if c != "cells"], *[F.get("_cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
