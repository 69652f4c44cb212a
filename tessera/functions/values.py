"""Ids, dates, amounts and how they are shown (Italian conventions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day 0 of spreadsheet serial dates.
EPOCH = "DATE'1899-12-30'"
#: Serials outside this range are plain numbers.
SERIALS = (1, 2958465)
#: Two-digit years from this one on are 19xx.
PIVOT = 70
BYTE_UNITS = ("B", "KB", "MB", "GB")
MONTHS = ("gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic")
DATE = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s*$"


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def digits_id(c: Column) -> Column:
    """The digits of a text as a number: ``4.256`` is 4256; null if there is none."""
    return digits(c).try_cast("long")


def parse_date(c: Column) -> Column:
    """d/m/yy or d/m/yyyy as a date; null if there is no such day."""
    part = [F.regexp_extract(c, DATE, k) for k in (1, 2, 3)]
    short = part[2].try_cast("int")
    year = F.when(F.length(part[2]) == 4, part[2]).otherwise((short + F.when(short >= PIVOT, 1900).otherwise(2000)).cast("string"))
    iso = F.concat_ws("-", year, F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0"))
    return F.when(part[0] != "", iso.try_cast("date"))


def serial(day: Column) -> Column:
    """A date's spreadsheet serial."""
    return F.datediff(day, F.expr(EPOCH)).cast("long")


def date_serial(c: Column) -> Column:
    return serial(parse_date(c))


def datetime_serial(day: Column, clock: Column) -> Column:
    """Serial of a d/m/y text with the share of the day of an h:mm:ss text; without such a time, the day alone."""
    hour, minute, second = (F.regexp_extract(clock, r"^\s*(\d{1,2}):(\d{2}):(\d{2})\s*$", k).try_cast("int") for k in (1, 2, 3))
    return date_serial(day) + F.coalesce((hour * 3600 + minute * 60 + second) / F.lit(86400.0), F.lit(0.0))


def serial_text(c: Column) -> Column:
    """A serial as dd/mm/yyyy; numbers outside the range of serials as they are."""
    day = F.date_add(F.expr(EPOCH), F.floor(c).cast("int"))
    return F.when(c.between(*SERIALS), F.date_format(day, "dd/MM/yyyy")).otherwise(c.cast("string"))


def amount(c: Column) -> Column:
    """``1.490,20`` as 1490.20; null if blank or not a number."""
    plain = F.replace(F.regexp_replace(c, r"(?U)[\s.\x{A0}]+", ""), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("double"))


def decimals(c: Column, places: int = 2) -> Column:
    """Dots between thousands, comma before the decimals; halves are rounded up."""
    return F.translate(F.format_number(F.round(c, places), places), ",.", ".,")


def whole(c: Column) -> Column:
    return F.coalesce(decimals(c, 0), F.lit("—"))


def human_bytes(c: Column) -> Column:
    """1536 as ``1,5 KB``: the largest unit up to GB, one decimal below ten of it."""
    out = F.lit("—")
    for k, unit in enumerate(BYTE_UNITS):
        value = c / F.lit(float(1024**k))
        shown = decimals(value, 0) if k == 0 else F.when(value >= 10, decimals(value, 0)).otherwise(decimals(value, 1))
        bound = (c >= 1024**k) if k else c.isNotNull()
        out = F.when(bound, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def time_ago(moment: Column, now: Column) -> Column:
    """A moment as seen from another: ``adesso``, minutes, hours or days ago, else the day."""
    gone = F.unix_timestamp(now) - F.unix_timestamp(moment)

    def count(size, label):
        return F.concat(F.floor(gone / size).cast("string"), F.lit(label))

    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(moment))
    day = F.concat_ws(" ", F.dayofmonth(moment).cast("string"), month, F.year(moment).cast("string"))
    return (
        F.when(moment.isNull(), "—").when(gone < 60, "adesso").when(gone < 3600, count(60, " min fa"))
        .when(gone < 86400, count(3600, " ore fa")).when(gone < 7 * 86400, count(86400, " giorni fa")).otherwise(day)
    )


def six_decimals(c: Column) -> Column:
    """At most six decimals, no zeros at the end."""
    return F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")


def column_letters(c: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA."""

    def letter(x):
        return F.chr(x + 65)

    # Before the names of k letters stand 26 + 26**2 + ... + 26**(k - 1) shorter ones.
    out, before = F.lit(None).cast("string"), [sum(26**j for j in range(1, k)) for k in range(1, 8)]
    for k in range(7, 0, -1):
        rest = c - before[k - 1]
        name = F.concat(*[letter(F.floor(rest / 26**j) % 26) for j in reversed(range(k))])
        out = F.when(rest < 26**k, name).otherwise(out)
    return out


def column_index(letters: Column) -> Column:
    """A is 0, AA is 26."""
    parts = F.filter(F.split(F.upper(letters), ""), lambda x: x != "")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def clock_seconds(c: Column) -> Column:
    """``1:02:03,5`` as 3723.5."""
    parts = F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def clock_text(seconds: Column) -> Column:
    """3723 as ``1:02:03``, 62 as ``1:02``."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def reading_time(words: Column) -> Column:
    """Words at 200 a minute: ``7 min``, ``1 h 5 min``."""
    minutes = F.greatest(F.lit(1), F.round(words / 200.0).cast("long"))
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min"))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def counted(n: Column, one: str, many: str) -> Column:
    """``1 ospite``, ``2 ospiti``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))
