"""Benchmark decontamination with DataFrame functions only.

Texts are probed by hashes: a window of n words holds, at one place that is a multiple of s = (n + 1) // 2, a run of
n - s + 1 words, so a text is looked up at every s-th word only, in the set of the benchmark's runs. Texts are cut into
words once for that; each probe is a place and a hash. Where a run is met, the whole windows round it are compared with
the benchmark's windows, word by word, so every hit is verified. Both sets are broadcast while they have at most
``broadcast_bytes``; beyond that the same joins shuffle. What is shuffled is a row per document, and the hits.

Edge cases: null and blank texts have no words, so never a hit; repeated rows get a row each (documents meet their
hits by doc_id and a 64-bit hash of the text); a null item_id takes part in hits but not in lists of items. An empty
benchmark leaves all documents clean; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NON_WORD, ascii_lower, free_names, split_words, written

WINDOW = 13
BROADCAST_BYTES = 64 << 20


def normal_words(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD)


def _windows(words: Column, length: Column | int) -> Column:
    """Array of (pos, gram) of each run of ``length`` words."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(words, i + 1, length), " ").alias("gram")))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram, len and items (distinct item_ids) of every window of the items; shorter items are one window."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(window)))
    grams = items.select("item_id", "len", F.explode(_windows(F.col("words"), F.col("len"))).alias("w"))
    return grams.groupBy(F.col("w.gram").alias("gram")).agg(F.min("len").alias("len"), F.collect_set("item_id").alias("items"))


def _run_hash(words: Column, i: Column, n: int) -> Column:
    """A hash of the run of a window of n words that begins at word i."""
    return F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n - (n + 1) // 2 + 1)])


def _starts(words: Column, n: int, step: int) -> Column:
    size = n - (n + 1) // 2 + 1
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size, F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_runs(benchmark: DataFrame, lengths: list[int], window: int = WINDOW) -> DataFrame:
    """run: the distinct hashes of the runs of all windows."""
    words = benchmark.select(normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    own = F.least(F.size("words"), F.lit(window))
    of = lambda n: F.transform(_starts(F.col("words"), n, 1), lambda i: _run_hash(F.col("words"), i, n))
    runs = F.concat(*[F.when(own == n, of(n)).otherwise(F.array().cast("array<bigint>")) for n in lengths])
    return words.select(F.explode(runs).alias("run")).distinct()


def probed(docs: DataFrame, runs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row (doc_id, text_hash, n_words, len 0) per document, and one (at, len) for each place where a run is met."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normal_words(F.col("text")).alias("words"))
    probe = lambda run, n, at: F.struct(run.cast("long").alias("run"), F.lit(n).alias("len"), at.cast("int").alias("at"))
    of = lambda n: F.transform(_starts(F.col("words"), n, (n + 1) // 2), lambda i: probe(_run_hash(F.col("words"), i, n), n, i))
    # A document's own row has a key of its own too, so that no key of a shuffled join is hot by such rows.
    own = probe(F.xxhash64(F.col("text_hash"), F.lit(-1)), 0, F.lit(0))
    rows = words.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.inline(F.concat(F.array(own), *map(of, lengths))))
    known = runs.select(F.col("run").alias("known"))
    return rows.join(known, F.col("run") == F.col("known"), "left").where("len = 0 or known is not null").drop("run", "known")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: doc_id, text_hash, n_words, n_hit, spans (pos, len; sorted), items (sorted as strings)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    grams = written(benchmark_grams(benchmark, window), "benchmark-windows")
    held = grams.groupBy("len").agg(F.sum(F.octet_length("gram") + 16 * F.size("items") + 64).alias("bytes")).collect()  # a row for each length up to the window
    lengths = sorted(r["len"] for r in held)
    hint = F.broadcast if sum(r["bytes"] for r in held) <= broadcast_bytes else (lambda df: df)
    if lengths:
        rows = written(probed(docs, hint(benchmark_runs(benchmark, lengths, window)), lengths), "probed-texts")
    else:
        none = F.lit(0)
        rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"), none.alias("len"), none.alias("at"))
    # Few places: the documents stay where they are; else both sides are shuffled.
    few = F.broadcast if rows.where("len > 0").count() * 64 <= broadcast_bytes else (lambda df: df)
    met = rows.where("len > 0").groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(F.collect_set(F.struct("len", "at")).alias("met"))
    texts = docs.join(few(met), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.xxhash64("text") == F.col("m_hash"))).groupBy("m_id", "m_hash").agg(F.first("met").alias("met"), F.first("text").alias("text"))
    texts = texts.withColumn("words", normal_words(F.col("text")))

    def windows(m):
        n = m["len"]
        first, last = F.greatest(F.lit(0), m["at"] - F.floor((n + 1) / 2).cast("int") + 1), F.least(m["at"], F.size("words") - n)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("words", i + 1, n), " ").alias("gram")))

    places = texts.select("m_id", "m_hash", F.inline(F.array_distinct(F.flatten(F.transform("met", windows)))))
    hits = places.join(hint(grams), "gram").groupBy(F.col("m_id").alias("h_id"), F.col("m_hash").alias("h_hash"))
    found = hits.agg(F.collect_set(F.struct("pos", "len")).alias("spans"), F.collect_set("items").alias("items")).select(
        "h_id",
        "h_hash",
        F.array_sort("spans").alias("spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string"))).alias("items"),
    )
    found = found.withColumn("n_hit", merged(F.col("spans")))
    return rows.where("len = 0").join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def merged(spans: Column) -> Column:
    """Words that sorted spans (pos, len) cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        end = s["pos"] + s["len"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, all columns."""
    found = contamination(docs, benchmark, window).where(is_contaminated(F.col("n_hit"), F.col("n_words")))
    of_id, of_hash = free_names(docs, "dirty_id", "dirty_hash")
    dirty = found.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash)).distinct()
    on = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_hash))
    return docs.join(dirty, on, "left_anti")
