"""Page geometry on pieces of text derived from parts, suppliers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import blocks, grid
from tessera.plans.registry import query, table
from tessera.sinks.scratch import written

_PIECES = """p AS (SELECT p_partkey, p_size % 4 AS book, p_partkey % 25 AS page, CAST(p_partkey * 7 % 400 AS DOUBLE) + (p_partkey % 10) / 10.0 AS y,
CAST(60 + 140 * (p_partkey % 4) + p_partkey % 9 AS DOUBLE) AS x, p_brand AS text, len(p_brand) * 9 * 0.5 AS width, CAST(p_size % 5 + 8 AS DOUBLE) AS font_size FROM part)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pieces of text: pages by key, y and x by remainders, in four columns."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key,
        (F.col("p_size") % 4).alias("book"),
        (key % 25).alias("page"),
        ((key * 7 % 400).cast("double") + (key % 10) / 10.0).alias("y"),
        (60 + 140 * (key % 4) + key % 9).cast("double").alias("x"),
        F.col("p_brand").alias("text"),
        (F.col("p_size") % 5 + 8).cast("double").alias("font_size"),
    )
    return rows.withColumn("width", grid.estimated_width(F.col("text"), F.lit(9)))


@query(f"""WITH RECURSIVE {_PIECES}, d AS (SELECT DISTINCT book, page, -y AS t FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY t) AS k FROM d),
f AS (SELECT book, page, k, t, t AS top, 0 AS r FROM s WHERE k = 1
UNION ALL SELECT s.book, s.page, s.k, s.t, CASE WHEN s.t - f.top > 3.0 THEN s.t ELSE f.top END, CASE WHEN s.t - f.top > 3.0 THEN f.r + 1 ELSE f.r END FROM f JOIN s ON s.book = f.book AND s.page = f.page AND s.k = f.k + 1)
SELECT p_partkey, CAST(r AS INT) AS row FROM p JOIN f ON f.book = p.book AND f.page = p.page AND f.t = -p.y""")
def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pieces, anchored at each row's first y."""
    return grid.cluster_rows(_pieces(spark, sf_dir), ["book", "page"]).select("p_partkey", "row")


@query(f"""WITH {_PIECES}, c AS (SELECT DISTINCT book, unnest(range(CAST(floor(x) AS INT), CAST(ceil(x + width) AS INT) + 1)) AS place FROM p),
g AS (SELECT book, place, lag(place) OVER (PARTITION BY book ORDER BY place) AS before FROM c)
SELECT book, (before + 1 + place) / 2 AS boundary FROM g WHERE place - before - 1 >= 6""")
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of columns, by book."""
    return grid.corridors(_pieces(spark, sf_dir), ["book"])


@query(f"""WITH {_PIECES}, c AS (SELECT DISTINCT book, unnest(range(CAST(floor(x) AS INT), CAST(ceil(x + width) AS INT) + 1)) AS place FROM p),
g AS (SELECT book, place, lag(place) OVER (PARTITION BY book ORDER BY place) AS before FROM c),
b AS (SELECT book, (before + 1 + place) / 2 AS boundary FROM g WHERE place - before - 1 >= 6)
SELECT p_partkey, CAST((SELECT count(*) FROM b WHERE b.book = p.book AND p.x >= b.boundary) AS INT) AS col FROM p""")
def assign_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of each piece."""
    pieces = _pieces(spark, sf_dir)
    return grid.assign_columns(pieces, grid.corridors(pieces, ["book"]), ["book"]).select("p_partkey", F.col("column").alias("col"))


@query(f"""WITH {_PIECES}, k AS (SELECT DISTINCT book FROM p), a AS (SELECT book, 'a' AS label, 60.0 AS x FROM k UNION ALL SELECT book, 'b', 200.0 + book FROM k UNION ALL SELECT book, 'c', 340.0 FROM k UNION ALL SELECT book, 'd', 480.0 FROM k),
b AS (SELECT book, label, coalesce((lag(x) OVER w + x) / 2, '-inf'::DOUBLE) AS low, coalesce((lead(x) OVER w + x) / 2, 'inf'::DOUBLE) AS high FROM a WINDOW w AS (PARTITION BY book ORDER BY x))
SELECT p_partkey, label FROM p JOIN b ON b.book = p.book AND p.x >= b.low AND p.x < b.high""")
def anchor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of each piece, by the places of four labels in its book."""
    pieces = _pieces(spark, sf_dir)
    label = lambda name, x: F.struct(F.lit(name).alias("label"), x.alias("x"))
    labels = F.array(label("a", F.lit(60.0)), label("b", 200.0 + F.col("book")), label("c", F.lit(340.0)), label("d", F.lit(480.0)))
    anchors = pieces.select("book").distinct().select("book", F.inline(labels))
    return grid.in_bands(pieces, grid.anchor_bands(anchors, ["book"]), ["book"]).select("p_partkey", "label")


@query(f"""WITH {_PIECES}, w AS (SELECT book, font_size, sum(len(text)) AS n FROM p GROUP BY ALL)
SELECT book, arg_max(font_size, struct_pack(n := n, s := -font_size)) AS body_size FROM w GROUP BY book""")
def body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font size most characters have, by book."""
    return blocks.body_size(_pieces(spark, sf_dir), ["book"])


@query(f"""WITH {_PIECES}, w AS (SELECT book, font_size, sum(len(text)) AS n FROM p GROUP BY ALL),
b AS (SELECT book, arg_max(font_size, struct_pack(n := n, s := -font_size)) AS body FROM w GROUP BY book)
SELECT p_partkey, CASE WHEN font_size - body >= 5 THEN 1 WHEN font_size - body >= 3 THEN 2 WHEN font_size - body >= 1.5 THEN 3 ELSE 0 END AS level FROM p JOIN b USING (book)""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels by font size over the body's."""
    pieces = _pieces(spark, sf_dir)
    return blocks.heading_levels(pieces, blocks.body_size(pieces, ["book"]), ["book"]).select("p_partkey", "level")


_LINES = r"""l AS (SELECT source, doc_id, line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
s AS (SELECT source, doc_id, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS signature FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; a source stands for a book, a document for a page."""
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")


@query(f"""WITH {_LINES}, n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM s GROUP BY source),
r AS (SELECT source, signature, count(DISTINCT doc_id) AS n_pages FROM s GROUP BY ALL)
SELECT r.source, signature, n_pages FROM r JOIN n USING (source) WHERE pages >= 3 AND n_pages >= greatest(3, CAST(floor(pages * 0.02) AS BIGINT))""")
def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on a fiftieth of a source's documents, and on three."""
    lines = _lines(spark, sf_dir).withColumn("signature", texts.signature(F.col("line")))
    return grid.recurring(lines, ["source"], "doc_id", share=0.02)


@query(r"""WITH p AS (SELECT p_partkey, lower(trim(p_name)) AS signature, p_size % 4 + 1 AS pieces FROM part)
SELECT p_partkey, signature, CASE WHEN pieces <= 2 AND len(signature) <= 60 AND regexp_matches(signature, '\d') THEN regexp_replace(signature, '\d+', '#', 'g') END AS digit_signature FROM p""")
def line_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of part names as lines of one to four pieces."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), (F.col("p_size") % 4 + 1).alias("pieces"))
    return grid.line_signatures(rows, []).select("p_partkey", "signature", "digit_signature")


@query(f"""WITH {_PIECES}, b AS (SELECT *, CASE WHEN x < 130 THEN 'a' WHEN x < 270 THEN 'b' WHEN x < 410 THEN 'c' ELSE 'd' END AS label, CAST(floor(y / 100) AS INT) AS line FROM p)
SELECT book, page, coalesce(string_agg(text, chr(10) ORDER BY y DESC, x, text) FILTER (label = 'a'), '') AS whole, coalesce(replace(string_agg(text, '' ORDER BY y DESC, x, text) FILTER (label = 'b' AND line = 1), ' ', ''), '') AS joined,
coalesce(string_agg(text, ' ' ORDER BY y DESC, x, text) FILTER (label = 'c' AND line = 2), '') AS third FROM b GROUP BY book, page""")
def place_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of records (pages) by band and line: all lines, a line joined as a number, one line."""
    x = F.col("x")
    pieces = _pieces(spark, sf_dir).withColumn("label", F.when(x < 130, "a").when(x < 270, "b").when(x < 410, "c").otherwise("d")).withColumn("line", F.floor(F.col("y") / 100).cast("int"))
    return grid.place_fields(pieces, ["book", "page"], [("whole", "a", "all", 0), ("joined", "b", "number", 1), ("third", "c", "line", 2)])


@query(f"""WITH {_PIECES}, s AS (SELECT unnest([400.0, 300.0, 200.0, 100.0]) AS top), m AS (SELECT p_partkey, y, min(top) AS top, count(*) - 1 AS record FROM p JOIN s ON s.top + 5.1 >= p.y GROUP BY p_partkey, y)
SELECT p_partkey, CAST(record AS INT) AS record, greatest(0, CAST(round((top - y) / 10.2) AS INT)) AS line FROM m""")
def record_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that a piece belongs to, of four on a page, and the line within it."""
    pieces = _pieces(spark, sf_dir)
    starts = pieces.select("book").distinct().select("book", F.explode(F.array(*map(F.lit, (400.0, 300.0, 200.0, 100.0)))).alias("y"))
    return grid.record_bands(pieces, starts, ["book"]).select("p_partkey", "record", "line")


@query(r"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\s\x{0B}]') GROUP BY doc_id""")
def not_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a document hold more than white space."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return grid.not_blank(lines).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, max(l_linenumber) > 4 AS sampled FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, count(*) AS shown, CASE WHEN NOT any_value(sampled) THEN count(*) END AS known FROM lineitem JOIN s USING (l_orderkey) WHERE NOT sampled OR l_linenumber <= 2 GROUP BY l_orderkey""")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of long orders, all of others; of long ones the number isn't known."""
    rows = grid.head_sample(table(spark, sf_dir, "lineitem").withColumn("page", F.col("l_linenumber")), ["l_orderkey"], most_pages=4, first_pages=2)
    return rows.groupBy("l_orderkey", "sampled").agg(F.count("*").alias("shown")).select("l_orderkey", "shown", grid.known_count(F.col("shown")).alias("known"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS page, 'Periodo: dal ' || strftime(o_orderdate, '%d/%m/%Y') || ' al ' || strftime(o_orderdate + INTERVAL 7 DAYS, '%d/%m/%Y') AS text, o_orderdate FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY page, o_orderkey DESC) AS k FROM p)
SELECT o_custkey, strftime(o_orderdate, '%d/%m/%Y') AS first, strftime(o_orderdate + INTERVAL 7 DAYS, '%d/%m/%Y') AS last FROM f WHERE k = 1""")
def page_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first period that a customer's pages name, from the top."""
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    text = F.concat(F.lit("Periodo: dal "), day(F.col("o_orderdate")), F.lit(" al "), day(F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")))
    pieces = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("page"), F.col("o_orderkey").alias("y"), text.alias("text"))
    return grid.page_period(pieces, ["o_custkey"])


_ROWS = """c AS (SELECT *, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) AS rn FROM customer)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ten printed lists, three to a page, in four columns, with page numbers.

    Lists of even number repeat title and header on each page, the others print their header once.
    """
    w = Window.partitionBy("book").orderBy("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("book", F.col("c_custkey") % 10).withColumn("rn", F.row_number().over(w))
    rows = rows.withColumns({"page": F.expr("cast((rn - 1) div 3 as int) + 1"), "y": 700.0 - 20 * ((F.col("rn") - 1) % 3)})
    at = lambda x, y, t: F.struct(F.lit(x).alias("x"), y.alias("y"), t.alias("text"))
    y = F.col("y")
    money = F.concat(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit(" EUR"))
    name = F.split("c_name", "#")
    data = F.array(at(60.0, y, F.concat(F.lit("C-"), F.col("c_custkey").cast("string"))), at(200.0, y - 1, F.get(name, 0)), at(238.0, y - 1.5, F.coalesce(F.get(name, 1), F.lit(" "))), at(400.0, y, F.when(F.col("rn") % 4 == 0, " ").otherwise(F.col("c_mktsegment"))), at(520.0, y + 1, money))
    top = lambda v: F.lit(v).cast("double")
    pages = rows.select("book", "page").distinct()
    title = F.array(at(250.0, top(780), F.when(F.col("book") % 2 == 0, "Elenco clienti").otherwise(" ")), at(290.0, top(30), F.concat(F.lit("Pagina "), F.col("page").cast("string"))))
    header = F.array(at(60.0, top(740), F.lit("Codice")), at(200.0, top(740), F.lit("Nome")), at(400.0, top(740), F.lit("Nome")))
    heads = pages.where((F.col("book") % 2 == 0) | (F.col("page") == 1)).select("book", "page", F.inline(header))
    out = rows.select("book", "page", F.inline(data)).unionByName(pages.select("book", "page", F.inline(title))).unionByName(heads)
    return out.withColumn("width", grid.estimated_width(F.col("text"), F.lit(9)))


@query(rf"""WITH {_ROWS}, v AS (SELECT c_custkey % 10 AS book, CAST((rn - 1) // 3 AS INT) + 1 AS page, rn, unnest(['Codice', 'Nome', 'Nome (2)', 'Colonna 4']) AS name,
unnest(['C-' || c_custkey, replace(c_name, '#', ' '), CASE WHEN rn % 4 = 0 THEN '' ELSE c_mktsegment END, CAST(c_acctbal AS DECIMAL(12,2)) || ' EUR']) AS value FROM c)
SELECT book, page, CAST(row_number() OVER (PARTITION BY book, name ORDER BY rn) AS BIGINT) AS line, name, value FROM v""")
def piece_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables out of printed lists: named by a repeated header, or by the first row."""
    found = grid.tables(written(_listing(spark, sf_dir), "list-pieces"), ["book"])
    w = Window.partitionBy("book").orderBy("page", "row")
    rows = found.rows.withColumn("line", F.row_number().over(w).cast("long")).join(found.columns, "book")
    return rows.select("book", "page", "line", F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("value"))))
