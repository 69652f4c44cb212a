"""Files in other character sets, unlike headers, broken pages, nested tables."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import charsets
from tessera.operators import blocks
from tessera.sources import delimited, html, logs, registry


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_sets(spark):
    rows = [(k, t.encode(c, "replace"), t) for k, (c, t) in enumerate([("utf-8", "perché €"), ("cp1252", "perché €“ù”"), ("utf-8", ""), ("utf-8-sig", "a")])]
    found = spark.createDataFrame(rows, "k int, data binary, text string").select("text", charsets.as_text(F.col("data")).alias("found"))
    assert all(r.text == r.found for r in found.collect())
    names = ["windows-1252", "iso-8859-15", "windows-1250", "iso-8859-2", "windows-1251", "iso-8859-5", "koi8-r", "windows-1253", "iso-8859-7", "windows-1254", "utf-16le"]
    pages = [(n, f"<meta charset='{n}'>".encode() + b"\x20\x00" * (n == "utf-16le") + "aàžЖλşü€".encode(n, "ignore")) for n in names if n != "utf-16le"]
    shown = {r.n: r.t for r in spark.createDataFrame(pages, "n string, data binary").select("n", charsets.as_text(F.col("data"), page=True).alias("t")).collect()}
    assert shown == {n: f"<meta charset='{n}'>" + "aàžЖλşü€".encode(n, "ignore").decode(n) for n, _ in pages}
    odd = spark.createDataFrame([(b"<meta charset=nonsense>\xe8",), (b"<meta charset=utf-16le>a",), (None,), (b"charset=utf-8 \xe8",)], "data binary")
    assert [r.t for r in odd.select(charsets.as_text(F.col("data"), page=True).alias("t")).collect()][0] == "<meta charset=nonsense>è" and odd.select(charsets.as_text(F.col("data"), page=True).alias("t")).collect()[2].t is None


def test_pages(spark, folder):
    write(f"{folder}/a.html", "<p>perché</p>".encode("latin-1"))
    write(f"{folder}/b.html", "<meta charset='windows-1251'><p>Жук</p>".encode("cp1251"))
    write(f"{folder}/c.html", b"\xff\xfe\x00<p>x</p>")
    write(f"{folder}/d.html", "<p>già</p>".encode())
    assert {b.text for b in registry.read(spark, f"{folder}/*.html").collect() if b.kind == "paragraph"} >= {"perché", "Жук", "già"}
    broken = spark.createDataFrame([(1, b"<p>a\xe8</p>"), (2, b"<p>b</p>")], "doc_id long, html binary").withColumn("html", F.col("html").cast("string"))
    assert {(b.doc_id, b.text) for b in html.read_html(broken).collect()} == {(1, "aè"), (2, "b")}
    write(f"{folder}/t.txt", "città\n\n- voce".encode("cp1252"))
    assert [(b.kind, b.text) for b in registry.read(spark, f"{folder}/t.txt").orderBy("block_no").collect()] == [("paragraph", "città"), ("list", "voce")]


def test_nested_tables(spark):
    page = "<table><tr><td>a</td><td>b<table><tr><td>x</td><td>y</td></tr></table>c</td></tr><tr><td>d</td></tr></table><p>fine</p>"
    found = html.read_html(spark.createDataFrame([(1, page)], "doc_id long, html string")).orderBy("block_no").collect()
    assert [(b.kind, b.rows) for b in found] == [("table", [["a", "b x y c"], ["d"]]), ("paragraph", None)]


def test_separator_in_text(spark):
    docs = spark.createDataFrame([(1, "uno\x01due\n\n- tre"), (2, None)], "doc_id long, text string")
    assert [(b.kind, b.text) for b in blocks.exploded(docs, blocks.flat_blocks(F.col("text"))).orderBy("block_no").collect()] == [("paragraph", "unodue"), ("list", "tre")]


def test_cells_in_other_sets(spark, folder):
    write(f"{folder}/x.csv", "nome;città\n".encode("cp1252") + "Zoë;".encode() + "Forlì €\n".encode("cp1252") + "a;b\r\n".encode())
    df = delimited.read_delimited(spark, f"{folder}/x.csv")
    assert df.columns == ["nome", "città", "ordinal"] and [tuple(r)[:2] for r in df.orderBy("ordinal").collect()] == [("Zoë", "Forlì €"), ("a", "b")]


@pytest.mark.parametrize(("one", "two"), [("a;a;b", "b;a;a"), ("a; b", "b;a"), ("x;y", "y;x"), ("a;b", "a;b;c"), ("a;;b", ";a;b")])
def test_unlike_headers(spark, folder, one, two):
    for name, head in (("a", one), ("b", two)):
        write(f"{folder}/t/{name}.csv", f"{head}\n1;2;3\n".encode())
    with pytest.raises(ValueError, match="header"):
        delimited.read_delimited(spark, f"{folder}/t")


def test_like_headers(spark, folder):
    for k, head in enumerate((b"\xef\xbb\xbfa;a; b\n", b"a;a; b\r\n", b'"a";a; b\n')):
        write(f"{folder}/t/{k}.csv", head + f"{k};2;3\n".encode())
    write(f"{folder}/t/empty.csv", b"")
    df = delimited.read_delimited(spark, f"{folder}/t")
    assert df.columns == ["a", "a (2)", "b", "ordinal"] and sorted(r.a for r in df.collect()) == ["0", "1", "2"]


def test_line_ends_in_cells(spark, folder):
    write(f"{folder}/m/a.csv", '"due\nrighe";b\n"x\ny";è\n'.encode("cp1252"))
    write(f"{folder}/m/b.csv", '"due\nrighe";b\n1;2\n'.encode())
    df = delimited.read_delimited(spark, f"{folder}/m", multi_line=True)
    assert df.columns == ["due\nrighe", "b", "ordinal"] and sorted(tuple(r)[:2] for r in df.collect()) == [("1", "2"), ("x\ny", "è")]
    write(f"{folder}/m/c.csv", '"due\nrighe";c\n1;2\n'.encode())
    with pytest.raises(ValueError, match="header"):
        delimited.read_delimited(spark, f"{folder}/m", multi_line=True)


def test_logs(spark, folder):
    write(f"{folder}/log.jsonl", b'{"a": 1, "b": "x"}\nnot json\n\n{"a": "y"}\n{"a": 2}\n')
    found = logs.read_json_lines(spark, f"{folder}/log.jsonl", "a int, b string")
    assert sorted((r.a, r.b) for r in found.collect()) == [(1, "x"), (2, None)]
