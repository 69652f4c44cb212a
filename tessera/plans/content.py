"""Transcripts from conversations, and blocks from documents and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import texts, values
from tessera.operators import blocks, transcripts
from tessera.plans.registry import query, table
from tessera.sinks import documents as document_sink
from tessera.sinks import scratch
from tessera.sinks import spreadsheet as spreadsheet_sink
from tessera.sources import datasource, html, spreadsheet


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues: every third turn repeats the one before at its head; users are named."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("cue_no"), (F.col("turn") * 2.5).alias("seconds"), F.col("text"), F.when(F.col("role") == "user", "UTENTE").when(F.col("role") == "assistant", "").otherwise("SISTEMA").alias("speaker")
    )


@query(r"""WITH RECURSIVE c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
o AS (SELECT a.conv_id, a.k, CASE WHEN a.k % 3 = 0 THEN b.text || ' ' || a.text WHEN a.k % 5 = 0 THEN b.text ELSE a.text END AS text FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.k = a.k - 1),
f AS (SELECT conv_id, k, text AS said, text AS before FROM o WHERE k = 1
UNION ALL SELECT o.conv_id, o.k, CASE WHEN f.before <> '' AND o.text = f.before THEN '' WHEN f.before <> '' AND starts_with(o.text, f.before || ' ') THEN substr(o.text, len(f.before) + 2) ELSE o.text END,
CASE WHEN f.before <> '' AND o.text = f.before THEN f.before WHEN f.before <> '' AND starts_with(o.text, f.before || ' ') THEN CASE WHEN trim(substr(o.text, len(f.before) + 2)) = '' THEN f.before ELSE substr(o.text, len(f.before) + 2) END
WHEN trim(o.text) = '' THEN f.before ELSE o.text END FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1)
SELECT conv_id, said AS text FROM f WHERE trim(said) <> ''""")
def rolling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rolling captions (every third turn begins with the one before, every fifth repeats it)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "text", F.row_number().over(w).alias("k"), F.lag("text").over(w).alias("before"))
    rolled = F.when(F.col("k") % 3 == 0, F.concat("before", F.lit(" "), "text")).when(F.col("k") % 5 == 0, F.col("before")).otherwise(F.col("text"))
    return transcripts.rolling_dedup(rows.select("conv_id", "k", rolled.alias("text")), ["conv_id"], ["k"]).select("conv_id", "text")


@query("""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'UTENTE' WHEN 'assistant' THEN NULL ELSE 'SISTEMA' END AS s FROM conversations),
w AS (SELECT conv_id, turn, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') AS who FROM c),
f AS (SELECT *, CASE WHEN who <> coalesce(lag(who) OVER (PARTITION BY conv_id ORDER BY turn), '') THEN 1 ELSE 0 END AS fresh FROM w)
SELECT conv_id AS doc_id, turn AS cue_no, who, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM f""")
def speaker_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one speaker; turns without a name are the last speaker's."""
    return transcripts.speaker_islands(_cues(spark, sf_dir)).select("doc_id", "cue_no", "who", "island")


@query(r"""WITH RECURSIVE w AS (SELECT conv_id, list_filter(string_split(regexp_replace(string_agg(text, ' ' ORDER BY turn, text), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, unnest(ws) AS word, unnest(range(len(ws))) + 1 AS k FROM w),
f AS (SELECT conv_id, k, 1 AS inside, 0 AS par, word FROM n WHERE k = 1
UNION ALL SELECT n.conv_id, n.k, CASE WHEN f.inside >= 120 OR f.inside >= 55 AND regexp_matches(f.word, '[.!?…]["»”'')\]]?$') THEN 1 ELSE f.inside + 1 END,
CASE WHEN f.inside >= 120 OR f.inside >= 55 AND regexp_matches(f.word, '[.!?…]["»”'')\]]?$') THEN f.par + 1 ELSE f.par END, n.word FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1)
SELECT conv_id AS doc_id, CAST(par AS INT) AS paragraph, string_agg(word, ' ' ORDER BY k) AS text, CAST(count(*) AS INT) AS n_words FROM f GROUP BY conv_id, par""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as unnamed cues, in paragraphs of 55 to 120 words."""
    cues = _cues(spark, sf_dir).withColumn("speaker", F.lit(""))
    return transcripts.paragraphs(cues, dedup=False).select("doc_id", "paragraph", "text", "n_words")


@query(r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
SELECT doc_id, CASE WHEN greatest(1, round(n / 200.0)) < 60 THEN CAST(CAST(greatest(1, round(n / 200.0)) AS BIGINT) AS VARCHAR) || ' min'
ELSE (CAST(round(n / 200.0) AS BIGINT) // 60) || ' h ' || (CAST(round(n / 200.0) AS BIGINT) % 60) || ' min' END AS shown FROM n""")
def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading times of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", values.reading_time(F.size(texts.words(F.col("text")))).alias("shown"))


@query(r"""WITH m AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '>> ANNA B.: ' WHEN 1 THEN '<v.loud Carlo Rossi>' ELSE '- ' END || text AS c FROM conversations),
l AS (SELECT *, CASE WHEN turn % 3 = 1 THEN 'Carlo Rossi' ELSE trim(regexp_extract(c, 'VOICE', 1)) END AS voice, CASE WHEN starts_with(c, '>> ') THEN ltrim(substr(c, 4)) WHEN starts_with(c, '- ') THEN ltrim(substr(c, 3)) ELSE trim(c) END AS line FROM m),
n AS (SELECT *, CASE WHEN contains(line, ':') AND regexp_matches(substr(line, instr(line, ':') + 1), '^\s') THEN split_part(line, ':', 1) ELSE '' END AS name FROM l),
o AS (SELECT *, len(name) BETWEEN 1 AND 29 AND regexp_full_match(name, '\p{Lu}SIGNS*') AND len(trim(name)) >= 2 AND len(string_split_regex(trim(name), '\s+')) <= 4 AS named FROM n)
SELECT conv_id, turn, CASE WHEN voice <> '' THEN voice WHEN named THEN trim(name) ELSE '' END AS speaker,
CASE WHEN voice <> '' THEN trim(regexp_replace(c, '<v[^>]*>', '', 'g')) WHEN named THEN trim(regexp_replace(substr(line, len(name) + 2), '^\s+', '')) ELSE line END AS said FROM o""".replace("VOICE", texts.VOICE).replace("SIGNS", texts.NAME_SIGNS.replace("'", "''")))
def speaker_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before turns, in two notations or none."""
    rows = table(spark, sf_dir, "conversations")
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(">> ANNA B.: "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<v.loud Carlo Rossi>"), "text")).otherwise(F.concat(F.lit("- "), "text"))
    return rows.select("conv_id", "turn", texts.speaker(marked).alias("s")).select("conv_id", "turn", "s.*")


def _decoded(c: str) -> str:
    """SQL of one round of decoding, for the entities that the tables hold."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&#8364;", "€"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{value}')"
    return c


@query(r"""WITH m AS (SELECT conv_id, turn, '[Musica] <00:00:03.120><c>' || text || '</c> ♪ (applausi) fine' AS c FROM conversations),
t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(c, 'WORD_TIME', '', 'g'), 'TAG', '', 'g') AS c FROM m),
p AS (SELECT conv_id, turn, DECODED AS c FROM t)
SELECT conv_id, turn, trim(regexp_replace(translate(regexp_replace(c, 'SCENE', ' ', 'g'), '♪♫', '  '), '\s+', ' ', 'g')) AS clean FROM p""".replace("WORD_TIME", texts.WORD_TIME).replace("TAG", texts.TAG).replace("SCENE", texts.SCENE).replace("DECODED", _decoded("c")))
def noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with word stamps, tags and scene notes put in, and taken out."""
    noisy = F.concat(F.lit("[Musica] <00:00:03.120><c>"), "text", F.lit("</c> ♪ (applausi) fine"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.without_noise(noisy).alias("clean"))


@query(r"""WITH m AS (SELECT doc_id, array_to_string(list_transform(string_split('<b>Prezzo</b> &amp;amp;<br/>nota &amp;#8364;' || chr(10) || text, chr(10)), lambda x: rtrim(x, ' ')), ' ') AS c FROM documents),
u AS (SELECT doc_id, DECODED AS c FROM m)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(c, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS clean FROM u""".replace("DECODED", _decoded(_decoded("c"))))
def comment_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as portal comments, escaped twice and tagged, cleaned."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.comment(F.concat(F.lit("<b>Prezzo</b> &amp;amp;<br/>nota &amp;#8364;\n"), "text")).alias("clean"))


@query(f"""SELECT doc_id, regexp_matches(text, '{texts.OTA_MARKS.replace("(?iu)", "(?i)")}') AS portal FROM documents""")
def note_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like a portal's note."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.is_portal_note(F.col("text")).alias("portal"))


_BLOCKS = r"""m AS (SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(1), ''), '(?m)^([ \t]*(?:[-*•]|\d+[.)])[ \t]+.*)$', chr(1) || '\1' || chr(1), 'g'), '\n[ \t\r]*\n', chr(1), 'g') AS t FROM documents),
q AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') AS parts FROM m),
b AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: struct_pack(kind := CASE WHEN regexp_matches(ltrim(regexp_replace(p, '^\n+', ''), ' '), '^([-*•·]|\d+[.)])\s+') THEN 'list' ELSE 'paragraph' END,
level := CASE WHEN regexp_matches(ltrim(regexp_replace(p, '^\n+', ''), ' '), '^([-*•·]|\d+[.)])\s+') THEN len(regexp_extract(regexp_replace(p, '^\n+', ''), '^([ \t]*)', 1)) // 2 ELSE 0 END, ordered := regexp_matches(ltrim(p, ' '), '^\d'),
text := trim(regexp_replace(CASE WHEN regexp_matches(ltrim(regexp_replace(p, '^\n+', ''), ' '), '^([-*•·]|\d+[.)])\s+') THEN regexp_replace(ltrim(p, ' '), '^([-*•·]|\d+[.)])\s+', '') ELSE p END, '\s+', ' ', 'g')))), lambda b: b.text <> '') AS bs FROM q),
x AS (SELECT doc_id, unnest(bs) AS b, unnest(range(len(bs))) AS block_no FROM b)"""


@query(f"""WITH {_BLOCKS} SELECT doc_id, CAST(block_no AS INT) AS block_no, b.kind AS kind, b.text AS text FROM x""")
def txt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents read as plain text."""
    return blocks.exploded(table(spark, sf_dir, "documents"), blocks.flat_blocks(F.col("text"))).select("doc_id", "block_no", "kind", "text")


@query(rf"""WITH {_BLOCKS} SELECT b.kind AS kind, count(*) AS n, CAST(sum(len(regexp_extract_all(b.text, '\S+'))) AS BIGINT) AS n_words FROM x GROUP BY b.kind""")
def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents by kind, and their words."""
    return blocks.type_counts(blocks.exploded(table(spark, sf_dir, "documents"), blocks.flat_blocks(F.col("text"))))


_KINDS = """k AS (SELECT doc_id, CAST(block_no AS INT) AS block_no, text, CASE WHEN len(text) % 5 = 0 THEN 'title' WHEN len(text) % 5 < 3 THEN 'list' ELSE 'code' END AS kind,
CAST(len(text) % 3 AS INT) AS level, len(text) % 2 = 0 AS ordered, CAST(len(text) % 2 AS VARCHAR) AS extra
FROM (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS block_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks whose kind, level and language follow from their length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    n = F.length("text")
    kind = F.when(n % 5 == 0, "title").when(n % 5 < 3, "list").otherwise("code")
    return rows.select("doc_id", "block_no", "text", kind.alias("kind"), (n % 3).alias("level"), (n % 2 == 0).alias("ordered"), (n % 2).cast("string").alias("extra"))


@query(f"""WITH {_KINDS}, f AS (SELECT *, CASE WHEN kind = 'code' AND lag(kind) OVER w = 'code' AND extra = lag(extra) OVER w THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY block_no) AS island FROM f)
SELECT doc_id, min(block_no) AS block_no, min(kind) AS kind, string_agg(text, chr(10) ORDER BY block_no) AS text, count(*) AS n_merged FROM i GROUP BY doc_id, island""")
def merge_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lines in a row as one block."""
    return blocks.merged_code(_kinds(spark, sf_dir)).select("doc_id", "block_no", "kind", "text", "n_merged")


@query(f"""WITH {_KINDS}, r AS (SELECT a.doc_id, a.block_no, a.kind, a.level, a.ordered, coalesce(max(b.block_no), -1) AS reset FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.block_no < a.block_no AND (b.kind <> 'list' OR b.ordered AND b.level < a.level)
WHERE a.kind = 'list' AND a.ordered GROUP BY ALL)
SELECT doc_id, block_no, CAST(row_number() OVER (PARTITION BY doc_id, level, reset ORDER BY block_no) AS INT) AS number FROM r""")
def list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of ordered items."""
    return blocks.list_numbers(_kinds(spark, sf_dir)).where("number IS NOT NULL").select("doc_id", "block_no", "number")


@query(f"""WITH {_KINDS} SELECT doc_id, block_no, CAST(sum(CASE WHEN kind = 'title' AND level <= 1 AND block_no > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS BIGINT) AS chapter FROM k""")
def chapter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of documents."""
    return blocks.chapters(_kinds(spark, sf_dir)).select("doc_id", "block_no", "chapter")


@query(f"""WITH {_KINDS}, n AS (SELECT a.*, (SELECT count(*) FROM k b WHERE b.doc_id = a.doc_id) AS total FROM k a)
SELECT doc_id, count(*) AS shown, bool_or(total > 40) AS partial FROM n WHERE block_no < 40 GROUP BY doc_id""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks the preview of a document shows, and whether there are more."""
    return blocks.preview(_kinds(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("shown"), F.bool_or("partial").alias("partial"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM w), f AS (SELECT *, len(word) % 2 = 0 AS bold FROM u),
i AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, bold ORDER BY k) AS g FROM f)
SELECT doc_id, count(*) AS n_runs, CAST(max(n) AS BIGINT) AS longest FROM (SELECT doc_id, bold, g, sum(len(word)) AS n FROM i GROUP BY ALL) GROUP BY doc_id""")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as runs, bold where their length is even: how many runs are left, and the longest."""
    run = lambda w: F.struct(w.alias("text"), (F.length(w) % 2 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("code"), F.lit(None).cast("string").alias("link"))
    runs = blocks.merged_runs(F.transform(texts.words(F.col("text")), run))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(runs, lambda r: F.length(r["text"]).cast("long")).alias("n")).where(F.size("n") > 0)
    return rows.select("doc_id", F.size("n").cast("long").alias("n_runs"), F.array_max("n").alias("longest"))


@query(rf"""WITH {_BLOCKS}, y AS (SELECT doc_id, block_no, b.kind AS kind, b.level AS level, b.kind = 'list' AND b.ordered AS ordered, b.text AS text FROM x),
r AS (SELECT a.doc_id, a.block_no, a.level, max(c.block_no) AS reset FROM y a LEFT JOIN y c ON c.doc_id = a.doc_id AND c.block_no < a.block_no AND (c.kind <> 'list' OR c.ordered AND c.level < a.level) WHERE a.ordered GROUP BY ALL),
n AS (SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id, level, reset ORDER BY block_no) AS number FROM r),
s AS (SELECT *, regexp_replace(text, '([\\`*\[\]])', '\\\1', 'g') AS t FROM y),
u AS (SELECT *, array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] = '_' AND NOT (regexp_matches(t[i - 1:i - 1], '[a-zA-Z0-9_]') AND regexp_matches(t[i + 1:i + 1], '[a-zA-Z0-9_]')) THEN '\_' ELSE t[i] END), '') AS v FROM s WHERE contains(t, '_')
UNION ALL SELECT *, t AS v FROM s WHERE NOT contains(t, '_')),
e AS (SELECT u.*, number, regexp_replace(v, '^(\s*)([#>+-]|\d+\.)(\s)', '\1\\\2\3') AS plain, lag(kind) OVER (PARTITION BY u.doc_id ORDER BY u.block_no) AS before FROM u LEFT JOIN n ON n.doc_id = u.doc_id AND n.block_no = u.block_no)
SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN kind = 'list' AND before = 'list' THEN chr(10) ELSE chr(10) || chr(10) END
|| CASE WHEN kind = 'list' THEN repeat('  ', level) || CASE WHEN ordered THEN number || '. ' ELSE '- ' END ELSE '' END || plain, '' ORDER BY block_no) AS text FROM e GROUP BY doc_id""")
def md_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown."""
    read = blocks.exploded(table(spark, sf_dir, "documents"), blocks.flat_blocks(F.col("text")))
    return blocks.markdown(blocks.list_numbers(read))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages."""
    return html.read_html(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"))


@query(f"""WITH {_KINDS} SELECT doc_id, CASE kind WHEN 'title' THEN 'titoli non riportati' WHEN 'list' THEN 'elenchi non riportati' ELSE 'codice non riportato' END AS reason, 'CSV' AS field, 'informativa' AS severity, count(*) AS n FROM k GROUP BY ALL""")
def loss_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents lose as delimited tables."""
    return blocks.losses(_kinds(spark, sf_dir), "csv")


@query(f"""WITH {_KINDS}, t AS (SELECT *, CASE WHEN kind = 'list' THEN CASE WHEN ordered THEN 'ol' ELSE 'ul' END END AS tag FROM k)
SELECT doc_id, block_no, CASE WHEN tag IS NOT NULL AND tag IS DISTINCT FROM lag(tag) OVER w THEN tag END AS opens, CASE WHEN tag IS NOT NULL AND tag IS DISTINCT FROM lead(tag) OVER w THEN tag END AS closes
FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)""")
def list_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lists open and close."""
    return blocks.tagged_lists(_kinds(spark, sf_dir)).select("doc_id", "block_no", "opens", "closes")


@query("""SELECT event_id, CAST(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS DOUBLE) + CASE WHEN event_id % 3 = 0 THEN 0 ELSE (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0 END AS serial FROM events""")
def datetime_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments as serials, from texts; every third one's time lacks the seconds."""
    clock = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", values.datetime_serial(F.date_format("ts", "d/M/yyyy"), clock).alias("serial"))


@query(r"""SELECT doc_id, sha256(replace(replace(replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM documents""")
def escaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents escaped for HTML, by digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(texts.escaped(F.col("text")), 256).alias("escaped"))


@query(r"""WITH c AS (SELECT c_custkey % 50 AS doc_id, c_custkey, [CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END] AS r FROM customer),
h AS (SELECT DISTINCT doc_id, -1 AS c_custkey, ['Codice', 'Nome', 'Mercato'] AS r FROM c), a AS (SELECT * FROM c UNION ALL SELECT * FROM h),
w AS (SELECT doc_id, max(len(r[1])) AS a, max(len(r[2])) AS b, max(len(r[3])) AS c FROM a GROUP BY doc_id),
l AS (SELECT a.doc_id, c_custkey, rtrim(rpad(r[1], CAST(w.a AS INT), ' ') || '  ' || rpad(r[2], CAST(w.b AS INT), ' ') || '  ' || rpad(r[3], CAST(w.c AS INT), ' ')) AS line, repeat('─', w.a) || '  ' || repeat('─', w.b) || '  ' || repeat('─', w.c) AS rule FROM a JOIN w USING (doc_id))
SELECT doc_id, 'CLIENTI' || chr(10) || '═══════' || chr(10) || chr(10) || string_agg(CASE WHEN c_custkey < 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY c_custkey) AS text FROM l GROUP BY doc_id""")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as plain text documents of a title and a table with aligned columns."""
    row = F.array(F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"])
    docs = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 50).alias("doc_id")).agg(listed.alias("rows"))
    head = F.array(*map(F.lit, ("Codice", "Nome", "Mercato")))
    none = F.lit(None).cast("array<array<string>>")
    block = lambda no, kind, text, rows: F.struct(F.lit(no).alias("block_no"), F.lit(kind).alias("kind"), F.lit(1).alias("level"), F.lit(False).alias("ordered"), F.lit(text).alias("text"), F.lit(None).cast("int").alias("number"), rows.alias("rows"))
    parts = docs.select("doc_id", F.inline(F.array(block(0, "title", "Clienti", none), block(1, "table", "", F.concat(F.array(head), F.col("rows"))))))
    return blocks.plain_text(parts)


@query(f"""WITH {_KINDS}, t AS (SELECT *, CASE WHEN kind = 'list' THEN CASE WHEN ordered THEN 'ol' ELSE 'ul' END END AS tag, replace(replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS e,
CASE kind WHEN 'title' THEN 'h' || greatest(1, level) WHEN 'list' THEN 'li' ELSE 'pre' END AS own FROM k WHERE block_no < 40),
p AS (SELECT *, CASE WHEN tag IS NOT NULL AND tag IS DISTINCT FROM lag(tag) OVER w THEN '<' || tag || '>' ELSE '' END AS opens, CASE WHEN tag IS NOT NULL AND tag IS DISTINCT FROM lead(tag) OVER w THEN '</' || tag || '>' ELSE '' END AS closes FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))
SELECT doc_id, sha256(string_agg(opens || '<' || own || '>' || e || '</' || own || '>' || closes, '' ORDER BY block_no)) AS html FROM p GROUP BY doc_id""")
def preview_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' previews as HTML, by digest."""
    return document_sink.html_preview(_kinds(spark, sf_dir)).select("doc_id", F.sha2("html", 256).alias("html"))


def _filed(lines: DataFrame, name: str) -> str:
    """Rows (book, line, order) as text files in the shared folder, one for each book."""
    path = f"{scratch.shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.repartition("book").sortWithinPartitions("book", *[c for c in lines.columns if c not in ("book", "line")]).select("book", "line").write.partitionBy("book").text(path)
    return path


def _book() -> Column:
    return F.regexp_extract("path", r"book=(\d+)", 1).cast("long")


@query(r"""WITH c AS (SELECT conv_id % 8 AS book, conv_id, turn, trim(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) AS words FROM conversations)
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY conv_id, turn, words) - 1 AS INT) AS cue_no, CAST(turn % 60 AS DOUBLE) + 0.5 AS seconds, trim('battuta ' || words) AS text, CASE WHEN turn % 2 = 0 THEN 'ANNA' ELSE '' END AS speaker FROM c""")
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as caption files and read back by their data source."""
    datasource.register(spark)
    words = F.trim(F.regexp_replace("text", "[^a-zA-Z]+", " "))
    begin = F.format_string("00:00:%02d,500", F.col("turn") % 60)
    cue = F.concat(F.lit("7\n"), begin, F.lit(" --> 00:01:00,000\n"), F.when(F.col("turn") % 2 == 0, ">> ANNA: ").otherwise(""), F.lit("battuta "), words, F.lit("\n"))
    lines = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 8).alias("book"), "conv_id", "turn", words.alias("words"), cue.alias("line"))
    cues = datasource.told(spark.read.format("captions").load(_filed(lines, "captions")))
    return cues.select(_book().alias("book"), "cue_no", "seconds", "text", "speaker")


@query(r"""WITH l AS (SELECT doc_id % 8 AS book, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
a AS (SELECT DISTINCT book, doc_id, -1 AS k, 'title' AS kind, 'Documento ' || doc_id AS text, 2 AS n_runs FROM l UNION ALL SELECT book, doc_id, k, 'list', trim('riga ' || trim(regexp_replace(line, '[^a-zA-Z]+', ' ', 'g'))), CASE WHEN trim(regexp_replace(line, '[^a-zA-Z]+', ' ', 'g')) = '' THEN 1 ELSE 2 END FROM l)
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY doc_id, k) - 1 AS INT) AS block_no, kind, text, n_runs FROM a""")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Markdown files and read back by their data source."""
    datasource.register(spark)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select((F.col("doc_id") % 8).alias("book"), "doc_id", "text")
    items = docs.select("book", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    items = items.withColumn("line", F.concat(F.lit("- *riga* "), F.trim(F.regexp_replace("line", "[^a-zA-Z]+", " "))))
    heads = docs.select("book", "doc_id", F.lit(-1).alias("k"), F.concat(F.lit("# Documento **"), F.col("doc_id").cast("string"), F.lit("**")).alias("line"))
    found = spark.read.format("markdown").load(_filed(items.unionByName(heads), "markdown"))
    return found.select(_book().alias("book"), "block_no", "kind", "text", F.size("runs").alias("n_runs"))


@query(f"""WITH {_KINDS} SELECT doc_id, CAST(sum(CASE WHEN kind = 'title' AND level <= 1 AND block_no > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS BIGINT) AS chapter, block_no, level, text FROM k QUALIFY kind = 'title' AND level <= 1""")
def table_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of two levels with their chapters."""
    return blocks.contents(blocks.chapters(_kinds(spark, sf_dir)), to_level=1)


@query(rf"""WITH {_KINDS} SELECT doc_id, kind, count(*) AS n FROM k WHERE trim(text) <> '' GROUP BY ALL""")
def not_blank_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents that hold text, by kind."""
    return blocks.not_blank(_kinds(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line_no, l_linenumber // 3 AS page, 700 - 13 * l_linenumber - 20 * (l_linenumber // 5) AS y FROM lineitem),
f AS (SELECT *, CASE WHEN page <> lag(page) OVER w OR lag(y) OVER w - y > 18.0 THEN 1 ELSE 0 END AS fresh FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS paragraph FROM f""")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as printed lines: a paragraph ends with the page and before a wide gap."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("line_no"), F.floor(n / 3).alias("page"), (700 - 13 * n - 20 * F.floor(n / 5)).alias("y"), F.lit(10.0).alias("body_size"))
    return blocks.paragraph_breaks(lines).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "paragraph")


@query(r"""SELECT c_custkey % 4 AS part, CAST(c_custkey AS VARCHAR) AS code, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS market, strftime(DATE '2020-01-01' + CAST(c_custkey % 5000 AS INT), '%d/%m/%Y') AS since,
CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.6f', c_acctbal), '0') END AS balance FROM customer""")
def sheet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as four spreadsheets and read back."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("part"), "c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("market"), F.expr("date_add(DATE'2020-01-01', cast(c_custkey % 5000 AS int))").alias("since"), "c_acctbal")
    path = f"{scratch.shared_folder(spark)}/sheets-{uuid.uuid4().hex}"
    written = spreadsheet_sink.write_sheets(rows.repartitionById(4, F.col("part").cast("int")), path, {"since": "date", "c_acctbal": "currency"}, first_column=1)
    files = spreadsheet_sink.listed(path, scratch.written(written, "sheets-written"))  # not those of lost attempts
    found = spreadsheet.read_sheets(spark, files).where(F.get("cells", F.lit(1)) != "part")
    names = ("part", "code", "name", "market", "since", "balance")
    return found.select(*[F.get("cells", F.lit(k + 1)).alias(n) for k, n in enumerate(names)]).withColumn("part", F.col("part").cast("long"))
