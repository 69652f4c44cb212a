"""Scalar functions on single cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import charsets, texts, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (values.digits_id, "4.256", 4256), (values.digits_id, "145", 145), (values.digits_id, "x", None),
        (values.date_serial, "01/01/2025", 45658), (values.date_serial, "15/01/2025", 45672), (values.date_serial, "31/02/2024", None), (values.date_serial, "", None),
        (values.parse_date, "26/11/23", date(2023, 11, 26)), (values.parse_date, "1/2/85", date(1985, 2, 1)),
        (values.amount, "1.490,20", 1490.20), (values.amount, "416,00", 416.0), (values.amount, "", None), (values.amount, "NaN", None), (values.amount, "12a", None),
        (values.clock_seconds, "01:02:03,500", 3723.5), (values.column_index, "AA", 26),
        (texts.signature, "  Pagina   1 ", "pagina 1"), (texts.escaped, "a<b>&\"'", "a&lt;b&gt;&amp;&quot;&#39;"),
        (texts.room_category, "[ Camera Matrimoniale - Single Use ]", "Camera Matrimoniale"), (texts.room_category, "[ altro ]", None),
        (texts.rtf_escaped, "a{è", "a\\{\\u232?"), (charsets.declared, '<meta charset="ISO-8859-1">', "iso-8859-1"),
        (texts.unescaped, "&#8364; &uuml; &#xe8; &amp;lt; &nosuch; a&b &#0; &", "€ ü è &lt; &nosuch; a&b &#0; &"), (texts.rtf_escaped, "\uff21\U0001f600", "\\u-223?\\u-10179?\\u-8704?"),
        (texts.comment, "&amp;lt;b&amp;gt;ciao&amp;lt;/b&amp;gt;<br>due\n tre", "ciao due tre"),
    ],
)
def test_texts(spark, function, given, expected):
    assert one(spark, function(F.lit(given))) == expected


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (values.column_letters, 0, "A"), (values.column_letters, 25, "Z"), (values.column_letters, 26, "AA"), (values.column_letters, 702, "AAA"),
        (values.decimals, 1234.5, "1.234,50"), (values.decimals, 0.125, "0,13"), (values.human_bytes, 1536, "1,5 KB"), (values.human_bytes, None, "—"),
        (values.clock_text, 3723, "1:02:03"), (values.clock_text, 62.9, "1:02"), (values.reading_time, 13000, "1 h 5 min"), (values.reading_time, 0, "1 min"),
        (values.six_decimals, 12.5, "12.5"), (values.serial_text, 45658, "01/01/2025"), (values.serial_text, 0, "0"), (values.whole, 1174, "1.174"),
    ],
)
def test_numbers(spark, function, given, expected):
    assert one(spark, function(F.lit(given).cast("double" if isinstance(given, float) else "long"))) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("349 674", (None, "349 674", True, None)), ("0341", (None, None, False, "0341")), ("06 12345678", ("06 12345678", None, False, None)),
        ("0341 +39 329 592 5969", (None, "+39 329 592 5969", False, "0341")), ("", (None, None, False, None)), ("0039 06 1234567", ("0039 06 1234567", None, False, None)),
    ],
)
def test_phone(spark, given, expected):
    assert tuple(one(spark, texts.phone(F.lit(given)))) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [(">> ANNA: ciao", ("ANNA", "ciao")), ("<v Mario>ciao a tutti", ("Mario", "ciao a tutti")), ("- ciao", ("", "ciao")), ("Poi disse: no", ("", "Poi disse: no"))],
)
def test_speaker(spark, given, expected):
    assert tuple(one(spark, texts.speaker(F.lit(given)))) == expected


def test_datetime_serial(spark):
    for clock, share in (("12:00:30", 43230 / 86400), ("12:00", 0.0), ("", 0.0), (None, 0.0)):
        assert one(spark, values.datetime_serial(F.lit("15/01/2024"), F.lit(clock).cast("string"))) == pytest.approx(45306 + share, abs=1e-9)


def test_letters_of_all_columns(spark):
    from tessera.sinks.spreadsheet import letters

    ids = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 12356629]
    assert [r.x for r in spark.createDataFrame([(k,) for k in ids], "id long").select(values.column_letters(F.col("id")).alias("x")).collect()] == [letters(k) for k in ids]


def test_time_ago(spark):
    now = F.lit("2026-01-10 12:00:00").cast("timestamp")
    for moment, shown in (("2026-01-10 11:59:30", "adesso"), ("2026-01-10 11:48:00", "12 min fa"), ("2026-01-10 09:00:00", "3 ore fa"), ("2026-01-07 12:00:00", "3 giorni fa"), ("2025-12-04 12:00:00", "4 dic 2025")):
        assert one(spark, values.time_ago(F.lit(moment).cast("timestamp"), now)) == shown
