"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, divergence, fmindex, interactions, kneser_ney, langid, licenses, merges, negatives, packing, simhash, warc, wavelet
from tessera.llm.common import documents, small_batches, written


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP6_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bi AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT item_id, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM bi)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, ns)),
h AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.gram = bg.gram),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as wavelet matrices and read back."""
    return wavelet.round_trip(documents(spark, sf_dir).select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on all documents."""
    found = divergence.quality(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM w)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM n WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM w) WHERE word IN (COMMON) GROUP BY ALL),
s AS (SELECT w.doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
[len(regexp_replace(t, '[^a-z]', '', 'g')), len(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')), len(regexp_replace(t, '[^A-Z]', '', 'g')), len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')),
len(regexp_replace(t, '[^0-9]', '', 'g')), len(regexp_replace(t, '[^\x00-\x7F]|[a-zA-Z0-9#*$%&|<>\x20\x09-\x0D]', '', 'g')), len(regexp_replace(t, '[\x00-\x7F]', '', 'g'))] AS c FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
gd AS (SELECT * FROM s WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
l0 AS (SELECT lang, sum(n_words) AS words, [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6]), sum(c[7])] AS c FROM gd GROUP BY lang HAVING sum(n_words) >= 5000),
lp AS (SELECT sum(n_words) AS words, [sum(c[1]), sum(c[2]), sum(c[3]), sum(c[4]), sum(c[5]), sum(c[6]), sum(c[7])] AS c FROM gd),
lr AS (SELECT x.lang, l0.words IS NOT NULL AS own, coalesce(l0.words, lp.words) AS words, coalesce(l0.c, lp.c) AS c FROM (SELECT DISTINCT lang FROM s) x CROSS JOIN lp LEFT JOIN l0 ON l0.lang IS NOT DISTINCT FROM x.lang),
w0 AS (SELECT gd.lang, word, sum(n) AS n FROM m JOIN gd ON gd.doc_id = m.doc_id GROUP BY gd.lang, word),
wr AS (SELECT lr.lang, word, n / words AS q FROM lr JOIN w0 ON lr.own AND lr.lang IS NOT DISTINCT FROM w0.lang
UNION ALL SELECT lr.lang, word, n / words AS q FROM lr JOIN (SELECT word, sum(n) AS n FROM w0 GROUP BY word) w ON NOT lr.own),
qa AS (SELECT lang, sum(q) AS q FROM wr GROUP BY lang),
x AS (SELECT s.doc_id, n / n_words AS p, q FROM s JOIN m ON m.doc_id = s.doc_id JOIN wr ON wr.lang IS NOT DISTINCT FROM s.lang AND wr.word = m.word),
xa AS (SELECT doc_id, sum(p) AS p, sum(q) AS q, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2 AS j FROM x GROUP BY doc_id),
wd AS (SELECT s.doc_id, greatest(0, 1 - coalesce(xa.p, 0)) AS p0, greatest(0, 1 - coalesce(qa.q, 0)) AS q0, coalesce(xa.j, 0) + greatest(0, coalesce(qa.q, 0) - coalesce(xa.q, 0)) / 2 AS j
FROM s LEFT JOIN xa ON xa.doc_id = s.doc_id LEFT JOIN qa ON qa.lang IS NOT DISTINCT FROM s.lang),
cd AS (SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS j
FROM (SELECT doc_id, unnest(s.c) / greatest(1, len(t)) AS p, unnest(lr.c) / list_sum(lr.c) AS q FROM s JOIN lr ON lr.lang IS NOT DISTINCT FROM s.lang) GROUP BY doc_id),
v AS (SELECT s.*, sqrt(greatest(0, cd.j)) AS char_distance,
sqrt(greatest(0, wd.j + (CASE WHEN p0 > 0 THEN p0 * log2(p0 / ((p0 + q0) / 2)) ELSE 0 END + CASE WHEN q0 > 0 THEN q0 * log2(q0 / ((p0 + q0) / 2)) ELSE 0 END) / 2)) AS word_distance,
n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s JOIN cd ON cd.doc_id = s.doc_id JOIN wd ON wd.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, CAST(c[4] AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (len(t) >= 200 AND char_distance > 0.3) AND NOT (n_words >= 50 AND word_distance > 0.45) AS kept FROM v
""".replace("COMMON", ", ".join(f"'{w}'" for w in divergence.COMMON))

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 50], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d)),
f AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f ON f.gram = g.gram WHERE first_id < doc_id),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS t, count(*) AS n FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.p = k.p WHERE r.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of all documents."""
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    found = kneser_ney.classify(documents(spark, sf_dir).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_bytes", "perplexity", "limit", "kept")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that earlier documents hold."""
    return fmindex.digests(documents(spark, sf_dir).select("doc_id", "text"))


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return interactions.audit(documents(spark, sf_dir).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      map(['A', 'B', 'C', 'D', 'E'], [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(first_id < w.doc_id, false)]) AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o AS filter_order, step, o[step] AS own, string_split(o[1:step - 1], '') AS before, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: y <> o[step]) AS others FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, good, toxic, fails[own] AS now, len(list_filter(before, lambda y: coalesce(fails[y], false))) > 0 AS gone, len(list_filter(others, lambda y: fails[y])) = 0 AS alone FROM f, s),
c AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, count(*) FILTER (NOT now AND NOT gone) AS kept, count(*) FILTER (now AND NOT gone) AS removed, count(*) FILTER (now AND gone) AS redundant,
      count(*) FILTER (now AND alone) AS unique_fails, count(*) FILTER (now AND NOT gone AND good) AS good_lost, count(*) FILTER (now AND NOT gone AND toxic) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all vectors, with the contract's anchors and labels."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op13_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and the texts that come back from them."""
    with small_batches(spark):  # ids are written before they are decoded, so that a task runs one of the two at a time
        ids = written(merges.encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "piece-ids")
        coded = merges.decode(ids).select(
            "doc_id",
            F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )
        return written(coded, "piece-digests")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_wavelet": op2_wavelet,
    "op3_divergence": op3_divergence,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_substrings": op7_substrings,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_licenses": op9_licenses,
    "op10_simhash": op10_simhash,
    "op11_interactions": op11_interactions,
    "op12_negatives": op12_negatives,
    "op13_merges": op13_merges,
}
ORACLES = {"op1_warc": OP1_SQL, "op3_divergence": OP3_SQL, "op6_decontamination": OP6_SQL, "op7_substrings": OP7_SQL, "op11_interactions": OP11_SQL, "op12_negatives": OP12_SQL}
