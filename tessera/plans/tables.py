"""Mapping, scalar functions, roll-ups, corrections and control tables.

The tables hold no bookings, so each query puts an operator on a table of the right shape; docstrings say which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import texts, values
from tessera.operators import blocks, control, corrections, mapping, rollup
from tessera.operators.mapping import MappedColumn
from tessera.plans.registry import query, table

def line_order() -> Column:
    """What orders the rows of an order."""
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query("""SELECT c_name AS cliente, CAST(c_custkey AS VARCHAR) AS codice, 'IT' AS paese, '' AS vuota, coalesce(c_mktsegment, '') AS settore FROM customer""")
def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with columns renamed, dropped, fixed and empty."""
    return mapping.map_columns(
        table(spark, sf_dir, "customer"),
        [MappedColumn("cliente", "c_name"), MappedColumn("codice", "c_custkey"), MappedColumn("paese", value="IT"), MappedColumn("vuota"), MappedColumn("settore", "c_mktsegment")],
    )


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS nome, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS settore
FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 0)""")
def skip_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers some of which have no name, no segment, or neither; the last go."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("nome"), F.when(key % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("settore"))
    return mapping.skip_blank_rows(mapping.map_columns(rows, []))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS chiave, strftime(o_orderdate, '%d/%m/%Y') AS giorno,
replace(printf('%.2f', round(o_totalprice, 2)), '.', ',') AS prezzo FROM orders""")
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cell texts: date, currency, text."""
    rows = mapping.map_columns(
        table(spark, sf_dir, "orders"), [MappedColumn("chiave", "o_orderkey"), MappedColumn("giorno", "o_orderdate", kind="date"), MappedColumn("prezzo", "o_totalprice", kind="currency")]
    )
    return mapping.typed_cells(rows, {"giorno": "date", "prezzo": "currency"})


@query("""SELECT '' AS key, '' AS client, 'La colonna «s_missing» non c''è' AS reason, 'Assente' AS field, '' AS proposed, 'correggi' AS severity""")
def missing_source_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of suppliers that names a column they lack."""
    return mapping.missing_sources(table(spark, sf_dir, "supplier"), [MappedColumn("Nome", "s_name"), MappedColumn("Assente", "s_missing")])


@query("""SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS BIGINT) AS serial,
strftime(o_orderdate, '%d/%m/%Y') AS shown,
CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS BIGINT) AS short_serial FROM orders""")
def serial_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as d/m/yyyy and d/m/yy texts, as serials, and back."""
    day = F.to_date("o_orderdate")
    long = F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day))
    short = F.concat_ws("/", F.dayofmonth(day), F.month(day), F.lpad((F.year(day) % 100).cast("string"), 2, "0"))
    serial = values.date_serial(long)
    return table(spark, sf_dir, "orders").select("o_orderkey", serial.alias("serial"), values.serial_text(serial).alias("shown"), values.date_serial(short).alias("short_serial"))


@query("""SELECT p_partkey, p_partkey % 18000 AS n,
CASE WHEN p_partkey % 18000 < 26 THEN chr(CAST(p_partkey % 18000 + 65 AS INT))
WHEN p_partkey % 18000 < 702 THEN chr(CAST((p_partkey % 18000 - 26) // 26 + 65 AS INT)) || chr(CAST((p_partkey % 18000 - 26) % 26 + 65 AS INT))
ELSE chr(CAST((p_partkey % 18000 - 702) // 676 + 65 AS INT)) || chr(CAST(((p_partkey % 18000 - 702) // 26) % 26 + 65 AS INT)) || chr(CAST((p_partkey % 18000 - 702) % 26 + 65 AS INT)) END AS letters,
p_partkey % 18000 AS back FROM part""")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as spreadsheet columns, and back."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 18000).alias("n")).withColumn("letters", values.column_letters(F.col("n")))
    return rows.withColumn("back", values.column_index(F.col("letters")))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * l_extendedprice) AS BIGINT) AS n, l_suppkey FROM lineitem),
v AS (SELECT *, CASE WHEN n >= 1073741824 THEN n / 1073741824.0 WHEN n >= 1048576 THEN n / 1048576.0 WHEN n >= 1024 THEN n / 1024.0 ELSE n END AS x,
CASE WHEN n >= 1073741824 THEN 'GB' WHEN n >= 1048576 THEN 'MB' WHEN n >= 1024 THEN 'KB' ELSE 'B' END AS u FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, n,
CASE WHEN u = 'B' OR x >= 10 THEN replace(format('{:,}', CAST(round(x) AS BIGINT)), ',', '.') ELSE replace(printf('%.1f', round(x, 1)), '.', ',') END || ' ' || u AS shown FROM v""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of line prices as sizes in bytes."""
    n = F.round(F.col("l_extendedprice") * F.col("l_extendedprice")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n")).withColumn("shown", values.human_bytes(F.col("n")))


@query("""WITH s AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS n FROM events)
SELECT event_id, n, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%d:%02d', n // 60, n % 60) END AS clock,
CAST(n AS DOUBLE) AS back FROM s WHERE n >= 0""")
def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as seconds on a clock, and back."""
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 100).cast("long").alias("n")).where("n >= 0")
    return rows.withColumn("clock", values.clock_text(F.col("n"))).withColumn("back", values.clock_seconds(F.col("clock")))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS amount,
replace(replace(replace(format('{:,.2f}', round(o_totalprice, 2)), ',', '#'), '.', ','), '#', '.') AS shown FROM orders""")
def amount_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals shown with dots and comma, and read again."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", values.decimals(F.col("o_totalprice")).alias("shown"))
    return rows.withColumn("amount", values.amount(F.col("shown")))


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn, l_linenumber, l_quantity FROM lineitem)
SELECT l_orderkey, count(*) AS n_rows, CAST(min(CASE WHEN rn = 1 THEN l_linenumber END) AS INT) AS first_line, sum(l_quantity) AS quantity FROM r GROUP BY l_orderkey""")
def group_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by order, with the first line of each."""
    out = rollup.first_appearance(table(spark, sf_dir, "lineitem"), ["l_orderkey"], line_order(), {"quantity": F.sum("l_quantity")})
    return out.select("l_orderkey", "n_rows", F.col("first_seen.l_linenumber").alias("first_line"), "quantity")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem),
d AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem WHERE l_discount > 0.04)
SELECT h.l_orderkey, h.l_partkey AS part, h.l_returnflag AS flag, CAST(h.l_shipdate AS DATE) AS shipped, d.l_extendedprice AS declared,
(SELECT count(*) FROM lineitem x WHERE x.l_orderkey = h.l_orderkey) AS n_rows
FROM r h LEFT JOIN d ON d.l_orderkey = h.l_orderkey AND d.rn = 1 WHERE h.rn = 1""")
def head_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from their lines: attributes of the first line, the first declared amount, the number of lines."""
    rows = table(spark, sf_dir, "lineitem")
    amount = F.when(F.col("l_discount") > 0.04, F.col("l_extendedprice"))
    out = rows.groupBy("l_orderkey").agg(
        rollup.head(F.struct("l_partkey", "l_returnflag", "l_shipdate"), line_order()).alias("head"), rollup.first_declared(amount, line_order()).alias("declared"), F.count("*").alias("n_rows")
    )
    return out.select("l_orderkey", F.col("head.l_partkey").alias("part"), F.col("head.l_returnflag").alias("flag"), F.to_date("head.l_shipdate").alias("shipped"), "declared", "n_rows")


@query(f"""WITH r AS (SELECT *, CASE WHEN l_discount > 0.04 THEN l_extendedprice END AS amt, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem),
f AS (SELECT l_orderkey, min(CASE WHEN amt IS NOT NULL THEN rn END) AS pos, count(*) AS n, max(CASE WHEN rn = 1 THEN amt END) AS own FROM r GROUP BY l_orderkey)
SELECT f.l_orderkey, coalesce(own, r.amt) AS amount, own IS NOT NULL AS from_head, pos IS NULL AND n > 1 AS missing
FROM f LEFT JOIN r ON r.l_orderkey = f.l_orderkey AND r.rn = f.pos""")
def first_declared_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's amount: on its first line, else the first declared, else missing."""
    amount = F.when(F.col("l_discount") > 0.04, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rollup.amount_with_fallback(amount, line_order()).alias("a")).select("l_orderkey", "a.*")


@query(f"""WITH r AS (SELECT l_orderkey, CAST(l_suppkey % 5 AS VARCHAR) AS room, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem WHERE l_suppkey % 7 <> 0),
s AS (SELECT l_orderkey, room, min(rn) AS rn FROM r GROUP BY ALL)
SELECT l_orderkey, string_agg(room, ', ' ORDER BY rn) AS rooms, count(*) AS n_rooms FROM s GROUP BY l_orderkey""")
def room_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of an order (suppliers stand for rooms) by first appearance."""
    rows = table(spark, sf_dir, "lineitem").withColumn("room", F.when(F.col("l_suppkey") % 7 == 0, "").otherwise((F.col("l_suppkey") % 5).cast("string")))
    return rollup.distinct_in_order(rows, ["l_orderkey"], "room", line_order(), "rooms")


@query(f"""WITH r AS (SELECT *, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE CAST(l_suppkey % 5 AS VARCHAR) END AS room, CASE WHEN l_discount > 0.04 THEN l_extendedprice END AS amt,
row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem),
u AS (SELECT l_orderkey, count(DISTINCT CASE WHEN room <> '' THEN room END) AS n, coalesce(max(room), '') AS only_room, min(CASE WHEN amt IS NOT NULL THEN rn END) AS at, count(*) AS guests, max(CASE WHEN rn = 1 THEN l_partkey END) AS part FROM r GROUP BY l_orderkey),
p AS (SELECT l_orderkey, room, count(*) AS guests, min(CASE WHEN amt IS NOT NULL THEN rn END) AS at FROM r WHERE room <> '' GROUP BY ALL)
SELECT u.l_orderkey, part AS l_partkey, only_room AS unit, u.guests, r.amt AS amount FROM u LEFT JOIN r ON r.l_orderkey = u.l_orderkey AND r.rn = u.at WHERE n < 2
UNION ALL SELECT u.l_orderkey, part, p.room, p.guests, r.amt FROM u JOIN p ON p.l_orderkey = u.l_orderkey LEFT JOIN r ON r.l_orderkey = p.l_orderkey AND r.rn = p.at WHERE n >= 2""")
def room_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on several rooms as a row per room, with each room's own amount and guests."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.withColumn("room", F.when(F.col("l_suppkey") % 7 == 0, "").otherwise((F.col("l_suppkey") % 5).cast("string")))
    rows = rows.withColumn("amount", F.when(F.col("l_discount") > 0.04, F.col("l_extendedprice")))
    return rollup.split_by_unit(rows, ["l_orderkey"], "room", line_order(), ["l_partkey"], ["amount"])


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS arrival FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders)
WHERE d IS NULL OR d BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'""")
def period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two years; those without a date pass."""
    day = F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate"))
    rows = table(spark, sf_dir, "orders")
    return rows.where(rollup.in_period(day, F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select("o_orderkey", F.to_date("o_orderdate").alias("arrival"))


@query("""WITH g AS (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN 'Prenotazione ANNULLATA' ELSE o_orderpriority END AS board FROM orders)
SELECT o_orderkey, o_custkey FROM g WHERE o_custkey NOT IN (SELECT o_custkey FROM g WHERE regexp_matches(board, '(?i)\\bannullat|\\bcancellat|\\bstornat'))""")
def cancelled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers none of whose orders is cancelled."""
    rows = table(spark, sf_dir, "orders").withColumn("board", F.when(F.col("o_orderkey") % 97 == 0, "Prenotazione ANNULLATA").otherwise(F.col("o_orderpriority")))
    return rollup.without_groups(rows, ["o_custkey"], texts.is_cancelled(F.col("board"), F.lit(""))).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Opzione' ELSE 'Confermata con Pagamento' END AS status FROM orders""")
def status_from_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders are options."""
    option = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yy")).otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", texts.status(option).alias("status"))


@query("""WITH b AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Mezza Pensione' WHEN 1 THEN 'Only Room' WHEN 2 THEN 'Pernott. Prima Colazione' WHEN 3 THEN '' ELSE p_type END AS board FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'Room Only' WHEN 2 THEN 'Bed & Breakfast' ELSE board END AS rate,
CASE p_partkey % 5 WHEN 0 THEN 'Cena' WHEN 3 THEN '' ELSE 'Pernotto' END AS service, p_partkey % 5 <> 4 AS known FROM b""")
def plan_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board plans (from part keys, some unknown) as rate and first service."""
    key = F.col("p_partkey") % 5
    board = F.when(key == 0, "Mezza Pensione").when(key == 1, "Only Room").when(key == 2, "Pernott. Prima Colazione").when(key == 3, "").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.plan(board, 0).alias("rate"), texts.plan(board, 1).alias("service"), texts.plan_known(board).alias("known"))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'booking.com b.v.' WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name END AS payer, CASE WHEN c_custkey % 2 = 0 THEN 'Expedia' ELSE c_name END AS booker FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Booking.com' WHEN c_custkey % 3 = 1 THEN trim(booker) ELSE trim(payer) END AS agency FROM a""")
def agency_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies of customers: payer, else booker, known portals by name."""
    key = F.col("c_custkey")
    payer = F.when(key % 3 == 0, "booking.com b.v.").when(key % 3 == 1, " ").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", texts.agency(payer, F.when(key % 2 == 0, "Expedia").otherwise(F.col("c_name"))).alias("agency"))


@query("""SELECT o_orderkey, concat_ws(' · ', CASE WHEN o_orderkey % 2 = 0 THEN 'Tassa sogg: 3,50' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'Convenzione: ' || o_orderpriority END,
CASE WHEN o_orderkey % 3 = 0 THEN 'nota' END) AS note FROM orders""")
def extra_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of orders with tax and agreement before them."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", texts.extra_labels(F.when(key % 2 == 0, "3,50").otherwise(""), F.col("o_orderpriority"), F.lit("1-URGENT"), F.when(key % 3 == 0, "nota").otherwise("")).alias("note")
    )


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag <> 'N') THEN coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) END), 0) END AS adults, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey""")
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field summed only where some row declares it (quantity of lines not flagged N)."""
    field = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rollup.summed_if_declared(field).alias("adults"), F.count("*").alias("n_rows"))


@query("""WITH g AS (SELECT l_orderkey, sum(l_linenumber) AS pax, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'Ospiti indicati: ' || pax || ', righe trovate: ' || n AS reason, 'Adulti · Bambini' AS field, CAST(n AS VARCHAR) AS proposed, 'correggi' AS severity FROM g WHERE pax > 0 AND pax <> n""")
def pax_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anomaly where the declared number isn't the number of rows."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("pax"), F.count("*").alias("n"))
    reason = F.concat(F.lit("Ospiti indicati: "), F.col("pax").cast("string"), F.lit(", righe trovate: "), F.col("n").cast("string"))
    return rollup.anomalies(groups, ["l_orderkey"], [rollup.anomaly((F.col("pax") > 0) & (F.col("pax") != F.col("n")), reason, "Adulti · Bambini", F.col("n").cast("string"))])


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies derived from lines: late ones to correct, discounted ones to know."""
    rows = table(spark, sf_dir, "lineitem")
    found = [rollup.anomaly(F.col("l_returnflag") == "R", "reso", "Stato"), rollup.anomaly(F.col("l_discount") > 0.08, "sconto", "Prezzo Retta", severity="informativa")]
    ids = F.struct(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return rollup.anomalies(rows.withColumn("id", ids).withColumn("job_id", F.col("l_orderkey")), ["job_id", "id"], found)


_ANOMALIES = """a AS (SELECT l_orderkey AS job_id, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice) AS id, 'reso' AS reason, 'Stato' AS field, 'correggi' AS severity FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice), 'sconto', 'Prezzo Retta', 'informativa' FROM lineitem WHERE l_discount > 0.08)"""


@query(f"""WITH {_ANOMALIES} SELECT job_id, count(*) FILTER (severity = 'correggi') AS to_correct, count(*) FILTER (severity = 'informativa') AS informative,
CASE WHEN count(*) FILTER (severity = 'correggi') > 0 THEN 'da_rivedere' ELSE 'pronto' END AS state FROM a GROUP BY job_id""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies by severity, and each job's state."""
    return control.job_states(_anomalies(spark, sf_dir))


@query(f"""WITH {_ANOMALIES} SELECT field, count(*) AS n, min(id).a AS first_job FROM a GROUP BY field""")
def anomalies_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies by field, with the first one's job."""
    out = control.anomalies_by_field(_anomalies(spark, sf_dir))
    return out.select("field", "n", F.col("first_id.l_orderkey").alias("first_job"))


@query(f"""WITH {_ANOMALIES}, s AS (SELECT *, id.a AS a, id.b AS b, id.c AS c, id.d AS d, id.e AS e FROM a) SELECT job_id, reason, field, severity FROM s ORDER BY severity, a, b, c, d, e LIMIT 40 OFFSET 80""")
def anomaly_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of anomalies."""
    return control.anomaly_page(_anomalies(spark, sf_dir), 2).select("job_id", "reason", "field", "severity")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 15 = 0 THEN 1234.5 ELSE o_totalprice END AS o_totalprice FROM orders""")
def corrections_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of status and price laid over orders; blank ones change nothing."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    made = F.array_compact(
        F.array(
            F.when(key % 10 == 0, F.struct(F.lit("o_orderstatus").alias("field"), F.lit("Z ").alias("value"))),
            F.when(key % 15 == 0, F.struct(F.lit("o_totalprice").alias("field"), F.lit("1.234,50").alias("value"))),
            F.when(key % 7 == 0, F.struct(F.lit("o_totalprice").alias("field"), F.lit(" ").alias("value"))),
        )
    )
    fixes = rows.select(key.alias("key"), F.inline(made)).where((F.trim("value") != "") | (key % 15 != 0))
    return corrections.overlay(rows, fixes, "o_orderkey", {"o_orderstatus": "text", "o_totalprice": "currency"})


@query("""WITH c AS (SELECT o_orderkey AS job, o_orderstatus AS field, o_orderpriority AS value, false AS skipped, 0 AS at FROM orders),
n AS (SELECT o_orderkey AS job, o_orderstatus AS field, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'nuovo' END AS value, o_orderkey % 6 = 0 AS skipped, 1 AS at FROM orders WHERE o_orderkey % 2 = 0),
u AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.job = c.job AND n.field = c.field) UNION ALL SELECT * FROM n)
SELECT job, field, value, skipped FROM u WHERE value <> '' OR skipped""")
def upsert_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored corrections and new ones: the latest per key; blank ones delete unless skipped."""
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    current = rows.select(key.alias("job"), F.col("o_orderstatus").alias("field"), F.col("o_orderpriority").alias("value"), F.lit(False).alias("skipped"), F.lit(0).alias("at"))
    changes = rows.where(key % 2 == 0).select(
        key.alias("job"), F.col("o_orderstatus").alias("field"), F.when(key % 3 == 0, "").otherwise("nuovo").alias("value"), (key % 6 == 0).alias("skipped"), F.lit(1).alias("at")
    )
    return corrections.upsert(current, changes, ["job", "field"]).select("job", "field", "value", "skipped")


@query("""SELECT c_custkey, landline, mobile, cut, dropped FROM (SELECT c_custkey,
CASE c_custkey % 5 WHEN 0 THEN '06 12345678' WHEN 3 THEN '02/' || '1234567' END AS l0,
CASE c_custkey % 5 WHEN 0 THEN '06 12345678' WHEN 3 THEN '1234567' END AS landline,
CASE c_custkey % 5 WHEN 1 THEN '349 674' WHEN 2 THEN '+39 329 592 5969' END AS mobile,
c_custkey % 5 IN (1, 3) AS cut, CASE c_custkey % 5 WHEN 2 THEN '0341' WHEN 3 THEN '02' WHEN 4 THEN '06' END AS dropped FROM customer)""")
def phone_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone fields of five shapes: landline, cut mobile, two numbers, two parts, a stump."""
    key = F.col("c_custkey") % 5
    raw = F.when(key == 0, "06 12345678").when(key == 1, "349 674").when(key == 2, "0341 +39 329 592 5969").when(key == 3, "02/1234567").otherwise("06")
    return table(spark, sf_dir, "customer").select("c_custkey", texts.phone(raw).alias("p")).select("c_custkey", "p.*")


@query("""SELECT o_orderkey, c_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_anomalies FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 100 orders with their customer and how many lines they have."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    return control.job_history(jobs, users, lines, 100).select(F.col("job_id").alias("o_orderkey"), "c_name", "n_anomalies")


@query("""SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS last_run FROM orders GROUP BY o_orderpriority""")
def jobs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority, and the last of each."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_run"))


@query("""SELECT count(*) AS n, coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0)::BIGINT AS bytes FROM lineitem""")
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines, and their prices in cents as bytes."""
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")), F.lit(0)).alias("bytes"))


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')""")
def orphan_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (files) all of whose orders (jobs) are closed (deleted)."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderstatus")
    return control.orphan_inputs(jobs.where("o_orderstatus = 'F'"), jobs.where("o_orderstatus <> 'F'")).select(F.col("file").alias("o_custkey"))


@query("""WITH e AS (SELECT event_id AS id, user_id % 50 AS k, CAST(floor(epoch(ts)) AS BIGINT) AS at, event_type IN ('error', 'view') AS failed FROM events),
c AS (SELECT a.id, a.k, a.at, a.failed, max(struct_pack(t := b.at, i := b.id)) FILTER (NOT b.failed) AS cleared FROM e a JOIN e b ON a.k = b.k AND (b.at < a.at OR b.at = a.at AND b.id <= a.id) GROUP BY ALL)
SELECT c.id, c.k AS key, count(*) FILTER (b.failed) AS recent, count(*) FILTER (b.failed) >= 3 AS refused
FROM c LEFT JOIN e b ON b.k = c.k AND b.at > c.at - 86400 AND (b.at < c.at OR b.at = c.at AND b.id <= c.id)
AND (c.cleared IS NULL OR b.at > c.cleared.t OR b.at = c.cleared.t AND b.id > c.cleared.i) GROUP BY ALL""")
def throttle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts (errors and views) of a user in a day, since the last success."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("key"), F.unix_timestamp("ts").alias("at"), F.col("event_type").isin("error", "view").alias("failed")
    )
    return control.throttle(rows, 86400, 3).select("id", "key", "recent", "refused")


@query(f"""WITH {_ANOMALIES} SELECT job_id, reason, a.field, CASE WHEN job_id % 4 = 0 AND a.field = 'Stato' THEN 'visto' END AS decision FROM a""")
def decisions_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies with decisions of every fourth job's status."""
    found = _anomalies(spark, sf_dir).withColumn("key", F.col("job_id").cast("string"))
    made = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("Stato").alias("field"), F.lit("visto").alias("value"))
    return control.decided(found, made).select("job_id", "reason", "field", "decision")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""")
def delete_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left when closed orders are deleted."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "job_id")
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    return control.delete_jobs({"lines": lines}, gone)["lines"].groupBy(F.col("job_id").alias("l_orderkey")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten events."""
    return control.log_tail(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type")


@query("""WITH j AS (SELECT o_orderkey, o_custkey, o_orderdate, 'Lista-' || o_orderpriority || '.csv' AS file FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 20 = 7)
SELECT o_orderkey, c_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_anomalies FROM j JOIN customer ON c_custkey = o_custkey WHERE contains(lower(file), 'lista-1') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def history_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty open orders of a group of customers whose file has a name like this."""
    orders = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "da_rivedere").otherwise("pronto")
    jobs = orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("customer"), (F.col("o_custkey") % 20).alias("user_id"), F.col("o_orderdate").alias("created"), state.alias("state"), F.concat(F.lit("Lista-"), "o_orderpriority", F.lit(".csv")).alias("file"))
    users = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).alias("user_id")).distinct()
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    found = control.job_history(jobs, users, lines, 50, only_user=7, search="lista-1", to_review=True)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), "c_name")
    return found.join(names, "customer").select(F.col("job_id").alias("o_orderkey"), "c_name", "n_anomalies")


@query("""SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAYS""")
def expired_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events older than a week on a day."""
    return control.expired(table(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00").select("event_id")


@query("""SELECT l_orderkey, CAST(arg_min(l_quantity, struct_pack(n := -n, a := a, q := l_quantity)) AS DOUBLE) AS usual FROM (SELECT l_orderkey, l_quantity, count(*) AS n, min(l_partkey) AS a FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity an order has most often; of equals that of the smallest part."""
    out = blocks.most_frequent(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_partkey", "usual")
    return out.withColumn("usual", F.col("usual").cast("double"))


@query(r"""WITH w AS (SELECT l_orderkey, sum(len(regexp_extract_all(l_returnflag || ' letto agg. bambino ' || l_linestatus, '(?i)letto agg\.\s*bambino'))) AS beds FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(beds AS BIGINT) AS beds FROM w""")
def child_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of children's beds in an order's lines."""
    supplements = F.concat("l_returnflag", F.lit(" letto agg. bambino "), "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.regexp_count(supplements, F.lit(texts.CHILD_BED))).cast("long").alias("beds"))
