"""Bookings, files in and out, grids, and streams."""

import os
import random
import shutil
import tempfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, corrections, grid, mapping, transcripts
from tessera.plans import bookings as plan
from tessera.plans import reports
from tessera.sinks import delimited as delimited_sink
from tessera.sinks import documents as document_sink
from tessera.sinks import spreadsheet as sheet_sink
from tessera.sources import captions, delimited, html, markdown, registry, spreadsheet
from tessera.streaming import staged, throttle


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def guests(spark, rows):
    names = ["npren", "cognome", "nome", "arrivo", "camera", "importo", "caparre", "pax", "trattamento", "convenzione", "telefono", "commenti", "data_opzione"]
    data = [(*[str(r.get(n, "")) for n in names], 1, k) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names) + ", page int, ordinal long")


def test_bookings(spark):
    rows = [
        {"npren": "4.871", "cognome": "ROSSI", "nome": "ANNA", "arrivo": "01/06/26", "camera": "1", "importo": "680,00", "pax": 2, "trattamento": "Mezza Pensione"},
        {"npren": "999", "cognome": "BIANCHI", "arrivo": "02/06/2026", "camera": "5", "importo": "", "pax": 1, "trattamento": "Strano", "telefono": "349 674"},
        {"npren": "4.871", "cognome": "VERDI", "camera": "2", "importo": ""},
        {"npren": "4.871", "cognome": "NERI", "camera": "7", "importo": "1.490,20", "commenti": "Booking.com guests: 2"},
        {"npren": "4.871", "cognome": "BLU", "camera": ""},
        {"npren": "12", "cognome": "VIA", "camera": "3", "trattamento": "ANNULLATA"},
    ]
    found = plan.bookings(guests(spark, rows))
    assert found.columns[2:] == [k for k, _, _ in plan.COLUMNS] and len(plan.COLUMNS) == 32
    out = [(r.id, r.camera, r.prezzo_retta, r.adulti, r.cognome, r.retta) for r in found.orderBy("at").collect()]
    assert out == [(4871, "1", 680.0, 1, "ROSSI", "Mezza Pensione"), (999, "5", None, 1, "BIANCHI", "Strano"), (4871, "2", None, 1, "ROSSI", "Mezza Pensione"), (4871, "7", 1490.2, 1, "ROSSI", "Mezza Pensione")]
    whole = plan.bookings(guests(spark, rows), plan.Rules(split_rooms=False, first_day="01/06/2026", last_day="01/06/2026")).collect()
    assert [(r.id, r.camera, r.adulti, r.note_ota) for r in whole] == [(4871, "1, 2, 7", 4, "Booking.com guests: 2")]
    said = {(r.npren, r.field, r.severity) for r in plan.anomalies(guests(spark, rows)).collect()}
    assert said == {("4.871", "Adulti · Bambini", "correggi"), ("4.871", "Camera", "informativa"), ("999", "Retta", "correggi"), ("999", "Telefono Cliente", "correggi")}
    fixes = spark.createDataFrame([("999", "Adulti · Bambini", "9 · 3"), ("999", "Prezzo Retta", "1.234,50"), ("999", "Data di Arrivo", "03/06/2026"), ("4.871", "Camera", " ")], "key string, field string, value string")
    fixed = plan.corrected(found, fixes).where("id = 999").first()
    assert (fixed.adulti, fixed.bambini, fixed.prezzo_retta, str(fixed.arrivo)) == (9, 3, 1234.5, "2026-06-03")


def test_mapping(spark):
    assert mapping.unique_names(["a", "a", "a (2)", "", "a"]) == ["a", "a (2)", "a (2) (2)", "Colonna 4", "a (3)"]
    df = spark.createDataFrame([("01/01/2025", "1.200", " ")], "a string, b string, c string")
    row = mapping.map_columns(df, [mapping.MappedColumn("d", "a", kind="date"), mapping.MappedColumn("n", "b", kind="integer"), mapping.MappedColumn("x", "zz"), mapping.MappedColumn(" ", "a")]).first()
    assert (str(row.d), row.n, row.x) == ("2025-01-01", 1200, "")
    assert mapping.skip_blank_rows(df.select("c")).count() == 0
    assert spark.range(1).select(mapping.densified(F.create_map(F.lit(1), F.lit("x")), 3).alias("r")).first().r == ["", "x", ""]


def test_delimited(spark, folder):
    path = f"{folder}/t.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('codice;descrizione;prezzo;codice\nA1;"Vite ""M4""; zinco";1,50;x\n\nB2;;2,00;y\n')
    df = registry.read(spark, path)
    assert df.columns == ["codice", "descrizione", "prezzo", "codice (2)", "ordinal"]
    assert [tuple(r)[:4] for r in df.orderBy("ordinal").collect()] == [("A1", 'Vite "M4"; zinco', "1,50", "x"), ("B2", "", "2,00", "y")]
    delimited_sink.write_delimited(spark.createDataFrame([("a", 1234.5)], "n string, v double").coalesce(1), f"{folder}/out", {"v": "currency"})
    part = next(x for x in os.listdir(f"{folder}/out") if x.endswith(".csv"))
    assert open(f"{folder}/out/{part}", encoding="utf-8-sig").read().split() == ["n;v", "a;1234,50"]


def test_wide_and_different_headers(spark, folder):
    names = [f"colonna numero {k:04d}" for k in range(1000)]
    os.mkdir(f"{folder}/wide")
    with open(f"{folder}/wide/a.csv", "w") as f:
        f.write(";".join(names) + "\n" + ";".join(map(str, range(1000))) + "\n")
    wide = delimited.read_delimited(spark, f"{folder}/wide")
    assert wide.columns == [*names, "ordinal"] and list(wide.first())[:1000] == [str(k) for k in range(1000)]
    os.mkdir(f"{folder}/two")
    for name, head in (("a", "x;y"), ("b", "y;x")):
        with open(f"{folder}/two/{name}.csv", "w") as f:
            f.write(f"{head}\n1;2\n")
    with pytest.raises(Exception, match="header"):
        delimited.read_delimited(spark, f"{folder}/two").collect()
    with open(f"{folder}/one.csv", "w") as f:
        f.write("solo\n1\n")
    with pytest.raises(ValueError, match="two columns"):
        registry.read(spark, f"{folder}/one.csv", checked=True)
    registry.register("dat", delimited.read_delimited, 3)
    with open(f"{folder}/x.dat", "w") as f:
        f.write("a;b\n1;2\n")
    with pytest.raises(ValueError, match="may have 3"):
        registry.read(spark, f"{folder}/x.dat", checked=True)
    assert registry.read(spark, f"{folder}/x.dat").drop("ordinal").first() == ("1", "2")


def test_long_sheets_go_on(spark, folder):
    written = sheet_sink.write_sheets(spark.range(7).coalesce(1), f"file://{folder}/x", sheet_rows=4).orderBy("file").collect()
    assert [r.n_rows for r in written] == [3, 3, 1]
    assert sorted(r.cells[0] for r in spreadsheet.read_sheets(spark, f"{folder}/x").collect()) == sorted([*map(str, range(7)), "id", "id", "id"])


def test_stored_cells(spark, folder):
    """Shared strings, rich text, built-in and own date formats, cells without references, gaps, repeated places, blank rows, the first sheet by the workbook."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = (
        '<row r="1"><c r="B1" t="s"><v>1</v></c><c t="s"><v>0</v></c><c r="E1" t="s"><v>9</v></c><c r="F1" t="str"><v>x</v></c></row><row r="2"><c r="A2"/></row>'
        '<row r="3"><c><v>7</v></c><c s="1"><v>45658.5</v></c><c s="2"><v>45658</v></c><c s="3"><v>45658</v></c><c s="1"><v>0.5</v></c><c r="AA3" t="n" s="4"><v>1</v></c></row>'
        '<row r="4"><c r="A4" t="inlineStr"><is><r><t>uno </t></r><r><t>due </t></r></is></c><c r="A4"><v>tre</v></c></row>'
    )
    with zipfile.ZipFile(f"{folder}/a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="a" r:id="r2"/><sheet name="b" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd.mm"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="46"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>città</t></si><si><r><t>due </t></r><r><t>pezzi</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c><v>no</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/other.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    with zipfile.ZipFile(f"{folder}/b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c><v>solo</v></c></row></sheetData></worksheet>')
    found = {(r.file[-6:], r.row_no): r.cells for r in spreadsheet.read_sheets(spark, f"{folder}/*.xlsx").collect()}
    assert found == {
        ("a.xlsx", 0): ["", "due pezzi", "città", "", "", "x"], ("a.xlsx", 2): ["7", "01/01/2025", "01/01/2025", "45658", "0.5", *[""] * 21, "31/12/1899"],
        ("a.xlsx", 3): ["tre"], ("b.xlsx", 0): ["solo"],
    }


def test_sheets_of_lost_attempts(spark, folder):
    path = f"file://{folder}/x"
    rows = sheet_sink.write_sheets(spark.range(5).repartition(2), path).collect()
    with open(f"{folder}/x/part-00000-999999-000.xlsx", "wb") as f:
        f.write(b"cut off")
    written = spark.createDataFrame(rows)
    assert sheet_sink.tidied(spark, path, written) == ["part-00000-999999-000.xlsx"] and sheet_sink.tidied(spark, path, written) == []
    assert sorted(r.cells[0] for r in spreadsheet.read_sheets(spark, path).collect()) == sorted([*map(str, range(5)), *["id"] * len(rows)])


def test_sheet_query_reads_listed_sheets(spark, folder, monkeypatch):
    """A sheet that a lost attempt left whole isn't read a second time."""
    from tessera.plans import content

    spark.sql("SELECT id AS c_custkey, concat('c', id) AS c_name, 'm' AS c_mktsegment, 1.5D AS c_acctbal FROM range(20)").write.parquet(f"{folder}/sf/customer.parquet")
    write, paths, names = sheet_sink.write_sheets, [], content.scratch.written
    monkeypatch.setattr(content.spreadsheet_sink, "write_sheets", lambda df, path, *a, **k: paths.append(path) or write(df, path, *a, **k))

    def retried(df, name):
        out = names(df, name)
        here = paths[0].removeprefix("file://")
        shutil.copy(f"{here}/{out.first().file}", f"{here}/part-00000-999999-000.xlsx")
        return out

    monkeypatch.setattr(content.scratch, "written", retried)
    assert sorted(int(r.code) for r in content.sheet_files(spark, f"{folder}/sf").collect()) == list(range(20))


def test_children_from_supplements(spark):
    rows = [("1", "a", "Letto agg. Bambino"), ("1", "b", ""), ("1", "c", "letto agg.  bambino 2"), ("2", "d", "Letto agg. Bambino"), ("3", "e", "")]
    data = spark.createDataFrame([(*r, 1, k) for k, r in enumerate(rows)], "npren string, cognome string, supplementi string, page int, ordinal long")
    ages = lambda rules: {r.id: (r.adulti, r.bambini, r.neonati) for r in plan.bookings(data, rules).collect()}
    assert ages(plan.Rules()) == {1: (3, 0, 0), 2: (1, 0, 0), 3: (1, 0, 0)}
    asked = plan.Rules(children_from_supplements=True)
    assert ages(asked) == {1: (1, 2, 0), 2: (1, 0, 0), 3: (1, 0, 0)}
    said = {r.npren: (r.reason, r.proposed) for r in plan.anomalies(data, asked).where("field = 'Adulti · Bambini'").collect()}
    assert said == {"1": ("1 adulto e 2 bambini?", "1·2"), "2": ("1 ospite con 1 letti per bambini: il conteggio non torna", "1·0")}


def test_spreadsheet(spark, folder):
    df = spark.sql("SELECT 'uno & due' AS nome, DATE'2025-01-01' AS quando, 12.5D AS quanto UNION ALL SELECT 'due', NULL, 3.0D").coalesce(1).sortWithinPartitions(F.desc("nome"))
    written = sheet_sink.write_sheets(df, f"file://{folder}/xlsx", {"quando": "date", "quanto": "currency"}, first_column=1).collect()
    assert [r.n_rows for r in written] == [2]
    with zipfile.ZipFile(f"{folder}/xlsx/{written[0].file}") as z:
        assert z.testzip() is None and "xl/workbook.xml" in z.namelist()
    rows = [r.cells for r in spreadsheet.read_sheets(spark, f"{folder}/xlsx").orderBy("row_no").collect()]
    assert rows == [["", "nome", "quando", "quanto"], ["", "uno & due", "01/01/2025", "12.5"], ["", "due", "", "3"]]
    with pytest.raises(ValueError, match="PDF"):
        registry.read(spark, "x.pdf")


def test_captions(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\n>> ANNA: ciao a tutti\n\n2\n00:00:03,500 --> 00:00:05,000\n[Musica] ciao a tutti &amp; bene\n"
    vtt = "WEBVTT\n\nNOTE x\ny\n\n00:00:01.000 --> 00:00:02.000\n<v Mario>uno <00:00:01.500><c>due</c>\n"
    glued = "0:077 secondiil mare era calmo e 1:051 minuto e 5 secondi la barca alle 10:30 1:02:031 ora, 2 minuti e 3 secondipartì"
    found = captions.read_captions(spark.createDataFrame([(1, srt), (2, vtt), (3, glued), (4, None)], "doc_id long, text string"))
    rows = {(r.doc_id, r.cue_no): (r.seconds, r.text, r.speaker) for r in found.collect()}
    assert rows == {(1, 0): (1.0, "ciao a tutti", "ANNA"), (1, 1): (3.5, "ciao a tutti & bene", ""), (2, 0): (1.0, "uno due", "Mario"), (3, 0): (7.0, "il mare era calmo e", ""), (3, 1): (65.0, "la barca alle 10:30", ""), (3, 2): (3723.0, "partì", "")}
    paragraphs = transcripts.paragraphs(found.where("doc_id = 1")).collect()
    assert [(p.speaker, p.text) for p in paragraphs] == [("ANNA", "ciao a tutti & bene")]


CUES = "doc_id long, cue_no int, seconds double, text string, speaker string"


def test_paragraphs_lose_no_word(spark):
    words = [f"w{k}" for k in range(400)]
    found = transcripts.paragraphs(spark.createDataFrame([(1, 0, 0.0, " ".join(words), "")], CUES)).orderBy("paragraph").collect()
    assert [w for p in found for w in p.text.split()] == words and max(p.n_words for p in found) <= 120
    cues = spark.createDataFrame([(1, 0, 0.0, "a b", "X"), (1, 1, 1.0, "c", ""), (1, 2, 2.0, "d", "Y"), (1, 3, 3.0, "d", "Y"), (2, 0, None, "d", None), (2, 1, 3700.0, " ", None)], CUES)
    islands = transcripts.paragraphs(cues, group="speaker").orderBy("doc_id", "paragraph").collect()
    assert [(p.seconds, p.speaker, p.text) for p in islands] == [(0.0, "X", "a b c"), (2.0, "Y", "d"), (None, "", "d")]


def test_time_marks(spark):
    cues = spark.createDataFrame([(1, 0, 5.9, "a b.", "X"), (1, 1, 65.0, "c", ""), (1, 2, 3723.0, "d", "Y"), (2, 0, None, "e", "")], CUES)
    shown = lambda **how: [p.shown for p in transcripts.paragraphs(cues, **how).orderBy("doc_id", "paragraph").collect()]
    assert shown(times="no") == ["X: a b. c", "Y: d", "e"]
    assert shown(times="paragraph") == ["[0:05] X: a b. c", "[1:02:03] Y: d", "e"]
    assert shown(times="cue") == shown(times="paragraph", group="cue") == ["[0:05] X: a b.", "[1:05] X: c", "[1:02:03] Y: d", "e"]
    with pytest.raises(ValueError):
        transcripts.paragraphs(cues, times="sometimes")


def test_folds_over_many_batches(spark):
    """A document of far more cues than an Arrow batch holds, beside small ones and none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(5000).selectExpr("if(id < 4990, 1, id) AS doc_id", "cast(id AS int) AS cue_no", "cast(id AS double) AS seconds", "concat('w', id div 2) AS text", "'' AS speaker")
        found = transcripts.rolling_dedup(rows).orderBy("doc_id", "cue_no").collect()
        assert [r.text for r in found if r.doc_id == 1] == [f"w{k}" for k in range(2495)] and len(found) == 2505
        one = [p.text for p in transcripts.paragraphs(rows.where("doc_id = 1")).orderBy("paragraph").collect()]
        assert " ".join(one) == " ".join(f"w{k}" for k in range(2495))
        assert transcripts.paragraphs(rows.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><h1>Tit&ograve;lo</h1><p><b>a<br>b</p><ul><li><p>uno</p><li>due</ul><table><tr><th>x</th><td>y</td></tr></table><script>if(a<b){}</script><blockquote><p>cit</p></blockquote><hr></body>"
    found = html.read_html(spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, html string")).orderBy("block_no").collect()
    assert [(b.kind, b.text) for b in found] == [("title", "Titòlo"), ("paragraph", "a b"), ("list", "uno"), ("list", "due"), ("table", "x y"), ("quote", "cit"), ("rule", "")]
    assert found[4].rows == [["x", "y"]]
    open_head = "<html><head><title>t</title><meta charset=x><body><p>a <b>b <i>c</i></b> <a href='u'>d</a></p>"
    found = html.read_html(spark.createDataFrame([(1, open_head)], "doc_id long, html string")).collect()
    assert [(b.kind, b.text) for b in found] == [("paragraph", "a b c d")]
    assert [tuple(r) for r in found[0].runs] == [("a ", False, False, False, None), ("b ", True, False, False, None), ("c", True, True, False, None), (" ", False, False, False, None), ("d", False, False, False, "u")]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("nome_file e 2 * 3 = 6", ["nome_file e 2 * 3 = 6"]), ("**a** _b_ `c*d`", [("a", "b"), " ", ("b", "i"), " ", ("c*d", "c")]),
        (r"\*x\* [y](http://z)", ["*x* ", ("y", "http://z")]), ("![](p/q.png) *a **b** c*", ["q.png ", ("a ", "i"), ("b", "bi"), (" c", "i")]), ("`aperto", ["`aperto"]), ("", []), ("[a [b] *c*](x(1) \"t\") d", [("a [b] ", "x(1)"), ("c", "ix(1)"), " d"]), ("[a](b", ["[a](b"]),
    ],
)
def test_inline_runs(line, expected):
    def shown(r):
        looks = "b" * r.bold + "i" * r.italic + "c" * r.code + (r.link or "")
        return (r.text, looks) if looks else r.text

    assert [shown(r) for r in markdown.runs(line)] == expected


def test_markdown_writer(spark):
    text = "# Uno **due**\n\n[y](http://z) e nome_file \\*\n\n![foto](a.png)\n\n```py\nx_1\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"
    read = markdown.read_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert blocks.markdown(blocks.list_numbers(read)).first().text == text
    lost = blocks.losses(read, "txt").orderBy("reason").collect()
    assert [(r.reason, r.n, r.severity) for r in lost] == [("immagini non riportate", 1, "informativa"), ("livelli dei titoli ridotti a due", 1, "informativa"), ("tabelle ridotte a testo", 1, "informativa")]


BLOCKS = "doc_id long, block_no int, kind string, level int, ordered boolean, text string"


def test_numbers_of_deep_items(spark):
    rows = [(1, k, kind, 11, True, "x") for k, kind in enumerate(["list", "list", "paragraph", "list"])]
    rows += [(2, k, "list", level, True, "x") for k, level in enumerate([0, 1000, 1000, 3, 1000, 0, 1000])] + [(2, 9, "list", 0, False, "x"), (2, 10, "list", 1000, True, "x"), (3, 0, "list", None, None, None)]
    found = blocks.list_numbers(spark.createDataFrame(rows, BLOCKS))
    assert [r.number for r in found.orderBy("doc_id", "block_no").collect()] == [1, 2, None, 1, 1, 1, 2, 1, 1, 2, 1, None, 2, None]


def test_head_sample(spark):
    pieces = spark.range(400).selectExpr("'a' AS book", "cast(id AS int) + 1 AS page", "'x' AS text").union(spark.sql("SELECT 'b', 1, ' \u00a0'"))
    found = {r.book: (r.n, r.known) for r in grid.head_sample(pieces, ["book"]).groupBy("book", "sampled").agg(F.count("*").alias("n")).withColumn("known", grid.known_count(F.col("n"))).collect()}
    assert found == {"a": (30, None), "b": (1, 1)} and grid.not_blank(pieces).count() == 400


def test_markdown_round_trip(spark):
    text = "# Uno\n\nParagrafo\ncontinua\n\n- a\n  1. b\n  2. c\n- d\n\n> cit\n\n```py\nx = 1\n```\n\n---\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    read = markdown.read_markdown(docs)
    kinds = [(b.kind, b.level, b.ordered) for b in read.orderBy("block_no").collect()]
    assert kinds == [("title", 1, False), ("paragraph", 0, False), ("list", 0, False), ("list", 1, True), ("list", 1, True), ("list", 0, False), ("quote", 0, False), ("code", 0, False), ("rule", 0, False), ("table", 0, False)]
    again = markdown.read_markdown(blocks.markdown(blocks.list_numbers(read.where("kind <> 'table'"))))
    assert [(b.kind, b.level, b.text) for b in again.orderBy("block_no").collect()] == [(b.kind, b.level, b.text) for b in read.where("kind <> 'table'").orderBy("block_no").collect()]
    preview = document_sink.html_preview(read, n=4).first()
    assert preview.partial and preview.html.startswith("<h1>Uno</h1><p>Paragrafo continua</p><ul><li>a</li></ul><ol><li>b</li></ol>")
    cells = spark.range(1).select(blocks.table_cells(F.lit("| 1 | 2\\|3 |")).alias("c"), blocks.markdown_table(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1")))).alias("t")).first()
    assert cells.c == ["1", "2|3"] and cells.t == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_grid(spark):
    pieces = []
    for page in range(1, 5):
        pieces += [(page, 40.0, 780.0, "Elenco articoli"), *[(page, x, 740.0, t) for x, t in ((60.0, "Codice"), (200.0, "Nome"), (460.0, "Prezzo"))], (page, 40.0, 30.0, f"Pagina {page}")]
        pieces += [(page, x, 700.0 - 20 * k + (k % 2), t) for k in range(12) for x, t in ((60.0, f"ART-{page}{k}"), (200.0, f"Articolo {page} {k}"), (460.0, f"{k},50"))]
    df = spark.createDataFrame([("b", *p) for p in pieces], "book string, page int, x double, y double, text string").withColumn("width", grid.estimated_width(F.col("text"), F.lit(9)))
    rows = grid.cluster_rows(df, ["book", "page"])
    lines = rows.groupBy("book", "page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda p: p["text"]), " ").alias("text"), F.count("*").alias("pieces"))
    kept = grid.without_recurring(grid.line_signatures(lines, []), ["book"], "page")
    assert kept.count() == 48
    data = rows.join(kept.select("book", "page", "row"), ["book", "page", "row"])
    placed = grid.assign_columns(data, grid.corridors(data, ["book"]), ["book"])
    assert sorted(r.column for r in placed.select("column").distinct().collect()) == [0, 1, 2]
    sparse = grid.sparse_rows(grid.cells(placed, ["book", "page"]), ["book", "page"])
    assert sparse.count() == 48 and sparse.where("cells[0] = 'ART-11'").first().cells[1] == "Articolo 1 1"
    assert grid.corridors(data, ["book"], corridor=250).count() == 0


def test_layout_fields(spark):
    rows = [("b", 0, "who", 60.0, 100.0, "ROSSI"), ("b", 0, "who", 60.0, 90.0, "ANNA"), ("b", 0, "who", 90.0, 90.0, " MARIA "), ("b", 0, "who", 60.0, 80.0, "0341"), ("b", 0, "who", 60.0, 70.0, "a@b"), ("b", 0, "who", 60.0, 60.0, ".it@"), ("b", 0, "who", 60.0, 50.0, "12 34"), ("c", 0, "who", 60.0, 50.0, "x@y"), ("c", 0, "who", 60.0, 40.0, "VERDI"), ("d", 0, "else", 1.0, 1.0, "x")]
    pieces = spark.createDataFrame(rows, "book string, record int, label string, x double, y double, text string").withColumn("line", F.lit(0))
    assert {tuple(r) for r in grid.identity_fields(pieces, ["book"], "who").collect()} == {("b", "ROSSI", "ANNA MARIA", "0341 12 34", "a@b.it@"), ("c", "", "VERDI", "", "x@y"), ("d", "", "", "", "")}
    pages = spark.createDataFrame([("b", 1, 700.0, "Stampa arrivi"), ("b", 1, 650.0, "Dal 01/06/2026 al 30/06/2026"), ("c", 1, 1.0, "altro")], "book string, page int, y double, text string")
    assert {r.book: r.layout for r in grid.layout(pages.groupBy("book", "page").agg(F.array_join(F.collect_list("text"), " ").alias("text")), [("x", "Stampa x"), ("arrivi", "Stampa arrivi")], ["book"]).collect()} == {"b": "arrivi", "c": None}
    assert tuple(grid.page_period(pages, ["book"]).first()) == ("b", "01/06/2026", "30/06/2026")
    sparse = spark.createDataFrame([("b", 1, {0: "x", 2: "z"})], "book string, row int, cells map<int,string>")
    assert grid.named_rows(sparse, ["Nome", "Nome"], 3).first().asDict() == {"book": "b", "row": 1, "Nome": "x", "Nome (2)": "", "Colonna 3": "z"}
    starts = spark.createDataFrame([("b", 100.0), ("b", 55.8)], "book string, y double")
    marks = spark.createDataFrame([("b", 100.0, "a"), ("b", 89.8, "b"), ("b", 56.0, "c"), ("b", 45.0, "d"), ("b", 200.0, "head")], "book string, y double, text string")
    assert {r.text: (r.record, r.line) for r in grid.record_bands(marks, starts, ["book"]).collect()} == {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (1, 1)}


PIECES = "book string, page int, x double, y double, text string"


def printed(book, layout, places, records, page=1, title=True, missing=()):
    """Pieces of a page of a report: records are lists of (key, dx, dy, text)."""
    out = [(book, page, 300.0, 580.0, layout.title)] if title else []
    out += [(book, page, x, 540.0 - 3.4 * (k == "caparre"), labels[-1]) for (k, labels), x in zip(layout.anchors, places) if labels and k not in missing]
    x_of = dict(zip([k for k, _ in layout.anchors], places))
    for n, cells in enumerate(records):
        out += [(book, page, x_of[k] + dx, 480.0 - 60 * n - dy, text) for k, dx, dy, text in cells]
    return out


def test_report_pages(spark):
    """Missing and vertical labels, labels elsewhere, starts closer than a line, and pieces above all starts."""
    places = [20.0, 70.0, 190.0, 260.0, 300.0, 340.0, 450.0, 540.0, 620.0, 700.0, 800.0]
    first = [("npren", 0, 0, "4.871"), ("npren", 1, 10.2, "01/05/26"), ("cognome", 0, 4.9, "ROSSI"), ("cognome", 0, 10, "ANNA"), ("pax", 0, 0, "3"), ("importo", 0, 0, "1"), ("importo", 9, 0, ".490,20"), ("importo", 0, 10.2, "9,00"), ("commenti", 0, 10, "due"), ("commenti", 0, 0, "uno "), ("camera", 0, -5.1, "7"), ("camera", 0, -5.2, "zz")]
    second = [("npren", 0, 0, "999"), ("npren", 0, 30, "x1234"), ("cognome", 0, 0, "VERDI"), ("arrivo", 0, 41, "02/06/2026")]
    near = [("npren", 0, 0, "100200"), ("npren", 0, 4.0, "100300"), ("cognome", 0, 4.0, "NERI")]
    pieces = printed("a", reports.GUESTS, places, [first, second, near]) + [("a", 1, 22.0, 530.0, "123456"), ("a", 1, 600.0, 300.0, "Cam.")]
    pieces += printed("a", reports.GUESTS, places, [second], page=2, title=False, missing=("importo",)) + printed("a", reports.GUESTS, places, [], page=3, title=False) + [("a", 4, 1.0, 1.0, "fine")]
    guests = [("npren", 0, 0, "555"), ("ospiti", 0, 0, "2"), ("ospiti", 0, 10, "1"), ("trattamento", 0, 30.6, "Doppia"), ("caparre", 0, 0, "5,00"), ("caparre", 0, 10, "6,00")]
    pieces += printed("b", reports.RESERVATIONS, places, [guests]) + [("b", 1, 400.0, 200.0, "A")] + [("c", 1, 300.0, 580.0, "Altro")] + [("d", 1, 0.0, 0.0, None), ("d", 1, 0.0, 0.0, " ")]
    found = {(r.book, r.page, r.ordinal): r for r in reports.report_guests(spark.createDataFrame(pieces, PIECES)).collect()}
    assert sorted(found) == [("a", 1, 0), ("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 1, 0)]
    r = found["a", 1, 0]
    assert (r.npren, r.data, r.cognome, r.nome, r.pax, r.importo, r.tassa_sogg, r.commenti, r.camera) == ("4.871", "01/05/26", "ROSSI", "ANNA", "3", "1.490,20", "9,00", "uno\ndue", "7")
    r = found["a", 1, 1]
    assert (r.npren, r.cognome, r.nome, r.arrivo, r.partenza, r.data) == ("999", "VERDI", "", "", "", "")
    assert [(found["a", 1, k].npren, found["a", 1, k].cognome) for k in (2, 3)] == [("100200", ""), ("100300", "NERI")]
    r = found["b", 1, 0]
    assert (r.npren, r.adulti, r.bambini, r.neonati, r.tipo_camera, r.caparre, r.acconti) == ("555", "2", "1", "", "Doppia", "5,00", "6,00")
    rows, said = reports.report_bookings(spark.createDataFrame(pieces, PIECES))
    assert {(r.id, r.prezzo_retta, r.adulti) for r in rows.collect()} == {(4871, 1490.2, 1), (999, None, 1), (100200, None, 1), (100300, None, 1), (555, None, 2)}
    assert said.where("npren = '4.871' AND reason LIKE 'Ospiti indicati%'").count() == 1
    assert reports.report_guests(spark.createDataFrame([], PIECES)).count() == 0
    header = grid.page_header(spark.createDataFrame([("a", 1, 10.0, 560.0, "Stampa clienti presenti"), ("a", 1, 10.0, 550.0, "Albergo Due"), ("a", 2, 10.0, 570.0, "Albergo Tre"), ("b", 1, 10.0, 100.0, "Dal 01/06/2026 al 30/06/2026")], PIECES), ["book"])
    assert {tuple(r) for r in header.collect()} == {("a", "Albergo Due", None, None), ("b", "", "01/06/2026", "30/06/2026")}


def test_plain_text(spark):
    text = "# Uno\n\n## Due\n\n#### Quattro\n\nuno **due** tre quattro\n\n1. a bb ccc dddd\n2. b\n- c\n\n> cit cit cit\n\n```\nx\ny\n```\n\n![](p/q.png)\n\n| a | bbb |\n| --- | --- |\n| ccccc |\n| d | e | f |\n\n---\n"
    read = markdown.read_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    expected = "UNO\n═══\n\nDue\n───\n\n  Quattro\n\nuno due\ntre\nquattro\n\n1. a bb\n   ccc dddd\n\n2. b\n\n· c\n\n    cit\n    cit cit\n\n    x\n    y\n\n[immagine: q.png]\n\na      bbb\n─────  ───  ─\nccccc\nd      e    f\n\n──────────"
    assert blocks.plain_text(blocks.list_numbers(read), width=10).first().text == expected
    shown = document_sink.html_preview(read).first().html
    assert shown.startswith("<h1>Uno</h1><h2>Due</h2><h4>Quattro</h4><p>uno <strong>due</strong> tre quattro</p><ol><li>a bb ccc dddd</li><li>b</li></ol><ul><li>c</li></ul>")
    assert shown.endswith("<p>q.png</p><table><thead><tr><th>a</th><th>bbb</th></tr></thead><tbody><tr><td>ccccc</td></tr><tr><td>d</td><td>e</td><td>f</td></tr></tbody></table><hr>")
    linked = markdown.read_markdown(spark.createDataFrame([(1, '*a <b>* [x](h"t) `c`')], "doc_id long, text string"))
    assert document_sink.html_preview(linked).first().html == '<p><em>a &lt;b&gt;</em> <span title="h&quot;t">x</span> <code>c</code></p>'


def test_upsert_deletes(spark):
    now = spark.createDataFrame([("j", "a", "1", False, 1), ("j", "b", "2", False, 1)], "job string, field string, value string, skipped boolean, at int")
    new = spark.createDataFrame([("j", "a", "", False, 2), ("j", "b", "", True, 2), ("j", "c", "3", False, 2)], now.schema)
    assert sorted((r.field, r.value) for r in corrections.upsert(now, new, ["job", "field"]).collect()) == [("b", ""), ("c", "3")]


def test_staged_is_one_shot(spark, folder):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k")
    df.repartition(10).write.parquet(f"{folder}/in")
    progress = staged.run(spark, f"{folder}/in", "id long, k long", f"{folder}/out", f"{folder}/checkpoint", lambda x: x.where("k <> 3"), files_per_stage=3)
    assert len(progress) == 4
    df.where("id < 10").withColumn("id", F.col("id") + 1000).repartition(1).write.mode("append").parquet(f"{folder}/in")
    staged.run(spark, f"{folder}/in", "id long, k long", f"{folder}/out", f"{folder}/checkpoint", lambda x: x.where("k <> 3"))
    expected = [r.id for r in spark.read.parquet(f"{folder}/in").where("k <> 3").orderBy("id").collect()]
    assert [r.id for r in spark.read.parquet(f"{folder}/out").orderBy("id").collect()] == expected


def test_throttle_stream_is_batch(spark, folder):
    from tessera.operators.control import throttle as batch

    rows = spark.range(300).select(F.col("id"), (F.col("id") % 3).cast("string").alias("key"), (F.col("id") * 97 % 40 * 60 + F.floor(F.col("id") / 40) * 2400 + 1_000_000).alias("at"), (F.col("id") % 17 != 0).alias("failed"))
    rows.repartition(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    query = throttle.throttle_stream(stream).writeStream.format("memory").queryName("throttled").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = {r.id: (r.recent, r.refused) for r in spark.table("throttled").collect()}
    assert streamed == {r.id: (r.recent, r.refused) for r in batch(rows).collect()} and len(streamed) == 300


def test_report_in_parts(spark, folder, monkeypatch):
    """Parts give the same bookings as all books at once, and only the bookings stay on disk."""
    from tessera.sinks import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{folder}")
    pieces = reports._printed(spark, "/root/testdata/sf0.001").where("book < 20")
    found = [sorted(map(repr, reports.bookings_in_parts(pieces, n).collect())) for n in (1, 3)]
    assert found[0] == found[1] and len(found[0]) > 100
    assert {x.rsplit("-", 1)[0] for x in os.listdir(folder)} == {"report-bookings"}


def test_throttle_with_dense_windows(spark):
    """Work that grew with attempts times their window's: a busy key against a plain count, and a size that took minutes."""
    from tessera.operators.control import throttle as batch

    rng = random.Random(4)
    rows = [(k, "ab"[k % 2], 1_000_000 + rng.randrange(9000), rng.random() < 0.9) for k in range(400)]
    found = {r.id: r.recent for r in batch(spark.createDataFrame(rows, "id long, key string, at long, failed boolean"), 100, 3).collect()}
    for id_, key, at, _ in rows:
        before = sorted((t, i, f) for i, k, t, f in rows if k == key and (t, i) <= (at, id_))
        since = max((n for n, (_, _, f) in enumerate(before) if not f), default=-1)
        assert found[id_] == sum(f and t > at - 100 for t, _, f in before[since + 1 :])
    many = spark.range(400_000).select("id", F.lit("a").alias("key"), (F.col("id") + 48_000_000).alias("at"), (F.col("id") % 50_000 != 7).alias("failed"))
    began = time.monotonic()
    assert batch(many, 1_000_000, 3).where("refused").count() > 390_000
    assert time.monotonic() - began < 60


def test_versions(spark, folder):
    path = f"{folder}/v"
    for k in (1, 2):
        document_sink.write_version(spark.range(k), path, k)
    document_sink.write_version(spark.range(5), path, 2)
    assert document_sink.versions(spark, path) == [1, 2] and document_sink.read_version(spark, path).count() == 5 and document_sink.read_version(spark, path, 1).count() == 1
    held = document_sink.read_version(spark, path)
    dies = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        document_sink.write_version(dies, path, 3)
    assert document_sink.versions(spark, path) == [1, 2] and os.listdir(f"{path}/_unfinished") == []
    assert document_sink.publish(spark, path, "published") == 2 and spark.table("published").count() == 5
    document_sink.write_version(spark.range(7), path, 3)
    assert held.count() == 5 and spark.table("published").count() == 5  # who reads the old version keeps it
    assert document_sink.publish(spark, path, "published") == 3 and spark.table("published").count() == 7
    assert document_sink.drop_versions(spark, path, keep=2) == [1] and document_sink.versions(spark, path) == [2, 3] and os.listdir(f"{path}/version=2") == ["attempt=2"]
    with pytest.raises(ValueError, match="no version 1"):
        document_sink.read_version(spark, path, 1)
    with pytest.raises(ValueError):
        document_sink.read_version(spark, f"{folder}/none")
    assert document_sink.evolved(spark.range(1), {"id": "long", "nuovo": "string"}).first() == (0, None)


def test_data_sources(spark, folder):
    from tessera.sources import datasource

    datasource.register(spark)
    os.makedirs(f"{folder}/in/sub")
    for name, data in (("a.srt", b"1\n00:00:01,000 --> 00:00:02,000\n>> ANNA: citt\xe0\n"), ("sub/b.vtt", b"WEBVTT\n\n00:05.000 --> 00:06.000\nuno\n\n00:07.000 --> 00:08.000\n[Musica]\n"), ("c.txt", b""), ("_x.srt", b"0:01 no")):
        with open(f"{folder}/in/{name}", "wb") as f:
            f.write(data)
    read = spark.read.format("captions").load(f"{folder}/in")
    assert read.rdd.getNumPartitions() == 3
    rows = sorted((os.path.basename(r.path), r.cue_no, r.seconds, r.text, r.speaker) for r in datasource.told(read).collect())
    assert rows == [("a.srt", 0, 1.0, "città", "ANNA"), ("b.vtt", 0, 5.0, "uno", ""), ("b.vtt", 1, 7.0, "", "")]
    stream = spark.readStream.format("captions").load(f"file://{folder}/in")
    seen = []
    for _ in range(2):
        stream.writeStream.foreachBatch(lambda df, k: seen.append((k, df.count()))).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
        with open(f"{folder}/in/d.srt", "w") as f:
            f.write("0:01 uno\n\n0:02 due\n")
    assert [n for _, n in seen] == [3, 2]
    with open(f"{folder}/x.md", "w") as f:
        f.write("# Uno *due*\n\n- a\n")
    found = spark.read.format("markdown").load(f"{folder}/x.md").orderBy("block_no").collect()
    assert [(b.kind, b.text, len(b.runs)) for b in found] == [("title", "Uno due", 2), ("list", "a", 1)]
    with pytest.raises(Exception, match="path"):
        spark.read.format("markdown").load().collect()


def test_stages_of_long_runs(spark, folder):
    spark.range(130).repartition(130).write.option("maxRecordsPerFile", 1).parquet(f"{folder}/in")
    n = len([x for x in os.listdir(f"{folder}/in") if x.endswith(".parquet")])
    progress = staged.run(spark, f"{folder}/in", "id long", f"{folder}/out", f"{folder}/c", files_per_stage=1)
    assert n > 100 and sum(p["rows"] for p in progress) == 130 and len(progress) > 100


def test_stage_that_fails(spark, folder):
    spark.range(4).repartition(4).write.parquet(f"{folder}/in")
    with open(f"{folder}/in/part-zz.snappy.parquet", "w") as f:
        f.write("broken")
    with pytest.raises(Exception):
        staged.run(spark, f"{folder}/in", "id long", f"{folder}/out", f"{folder}/c", files_per_stage=1)
    os.remove(f"{folder}/in/part-zz.snappy.parquet")


def test_stages_shrink(spark, folder):
    """Parts over three files fail: the same stage goes on with smaller ones, and no row is there twice."""
    spark.range(0, 1600, 1, 16).write.parquet(f"{folder}/in")
    tried = []

    def picky(df):
        tried.append(len(df.inputFiles()))
        if tried[-1] > 3:
            raise ValueError("too many files")
        return df.withColumn("twice", F.col("id") * 2)

    done = staged.run(spark, f"{folder}/in", "id long", f"{folder}/out", f"{folder}/c", picky, files_per_stage=8)
    assert tried[:4] == [8, 4, 2, 2] and max(tried[2:]) == 2 and {d["stage"] for d in done} == {0, 1} and sum(d["rows"] for d in done) == 1600
    assert staged.result(spark, f"{folder}/out").agg(F.count("*"), F.count_distinct("id"), F.sum("twice")).first() == (1600, 1600, 1599 * 1600)


def test_stage_done_again(spark, folder):
    """A stage that died half way through its parts, then again before it was committed, is replaced as a whole."""
    spark.range(0, 400, 1, 4).write.parquet(f"{folder}/in")
    state = {"calls": 0}

    def dies(df):
        state["calls"] += 1
        if 2 <= state["calls"] <= 3:  # the second part, then a single file of it
            raise ValueError("lost")
        return df

    sink = staged.Stages(f"{folder}/out", "id long", "parquet", dies, 2)
    with pytest.raises(Exception):
        staged.ingest(spark, f"{folder}/in", f"{folder}/c", sink, 4).awaitTermination()
    assert not os.path.exists(f"{folder}/out/stage=0")
    staged.ingest(spark, f"{folder}/in", f"{folder}/c", sink, 4).awaitTermination()
    assert staged.result(spark, f"{folder}/out").agg(F.count("*"), F.count_distinct("id")).first() == (400, 400)
    again = spark.createDataFrame([(f"file:{folder}/in/{x}",) for x in os.listdir(f"{folder}/in") if x.endswith(".parquet")], "path string")
    sink(again, 0)
    assert staged.result(spark, f"{folder}/out").agg(F.count("*"), F.count_distinct("id")).first() == (400, 400)


def test_one_writer(spark, folder):
    import threading

    spark.range(4).repartition(2).write.parquet(f"{folder}/in")
    hold = threading.Event()

    def slow(df):
        hold.wait(60)
        return df

    first = staged.ingest(spark, f"{folder}/in", f"{folder}/c", staged.Stages(f"{folder}/out", "id long", "parquet", slow, 9))
    try:
        with pytest.raises(Exception, match="(?i)same id|already active|concurrent"):
            staged.ingest(spark, f"{folder}/in", f"{folder}/c", staged.Stages(f"{folder}/out", "id long", "parquet", lambda df: df, 9)).awaitTermination()
    finally:
        hold.set()
        first.awaitTermination()
    assert staged.result(spark, f"{folder}/out").count() == 4


def test_piece_tables(spark):
    """Header repeated, printed once, or none; a recurring page number inside the width; a book of two pages; nulls and blanks."""
    def page(book, number, rows, header, at=720.0):
        out = [(book, number, 60.0, 780.0, "Elenco articoli")] * (book != "b") + [(book, number, 150.0, 30.0, f"Pagina {number}")]
        if header:
            out += [(book, number, 60.0, 750.0, "Listino 2026"), *[(book, number, x, 740.0, t) for x, t in ((60.0, "Codice"), (300.0, "Codice"))]]
        return out + [(book, number, x, at - 20 * k, t) for k, cells in enumerate(rows) for x, t in zip((60.0, 200.0, 300.0), cells)]

    pieces = [p for n in range(1, 5) for p in page("a", n, [(f"A{n}", f"b{n}", f"c{n}"), ("D" + "xyzw"[n - 1], "", "e")], True)]
    pieces += [p for n in range(1, 5) for p in page("b", n, [(f"A{n}x", f"b{n}", f"c{n}")], n == 1)]
    pieces += [p for n in (1, 2) for p in page("c", n, [("x", "y", "z")], False)] + [("d", 1, 10.0, 10.0, None), ("d", 1, 10.0, 10.0, " ")]
    df = spark.createDataFrame(pieces, PIECES).withColumn("width", grid.estimated_width(F.col("text"), F.lit(9)))
    found = grid.tables(df, ["book"])
    names = {r.book: (r.names, r.n_columns) for r in found.columns.collect()}
    assert names == {"a": (["Codice", "Colonna 2", "Codice (2)"], 3), "b": (["Listino 2026", "Colonna 2", "Colonna 3"], 3), "c": (["Elenco articoli", "Colonna 2", "Colonna 3", "Colonna 4"], 4)}
    rows = {b: [r.cells for r in found.rows.where(F.col("book") == b).orderBy("page", "row").collect()] for b in "abc"}
    assert rows["a"] == [c for n in range(1, 5) for c in ([f"A{n}", f"b{n}", f"c{n}"], ["D" + "xyzw"[n - 1], "", "e"])]
    assert rows["b"][0] == ["Codice", "", "Codice"] and rows["b"][1:] == [[f"A{n}x", f"b{n}", f"c{n}"] for n in range(1, 5)]
    assert len(rows["c"]) == 5  # two pages: nothing recurs, the first row gives the name
    assert {r.signature for r in found.repeated.where("book = 'b'").collect()} == {"pagina #"}
    table = grid.named_table(found, {"book": "a"})
    assert table.columns == ["page", "row", "Codice", "Colonna 2", "Codice (2)"] and table.count() == 8
    plain = grid.tables(df, ["book"], named=False, skip_repeated=False)
    assert plain.rows.where("book = 'a'").count() == 24 and plain.columns.where("book = 'a'").first().names == ["Colonna 1", "Colonna 2", "Colonna 3"]
    assert grid.tables(df.limit(0), ["book"]).rows.count() == 0
