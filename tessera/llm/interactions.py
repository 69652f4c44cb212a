"""How filters overlap: what each one removes, alone and after others, in every order of five.

Words are exploded and aggregated by (document, word), then by document, for totals and distinct words; the other filters'
flags are joined to that, and all documents of a part become 32 conditional counts, one for each set of failed filters.
Every figure of every order follows from those counts, so the orders never touch the documents again.

Filters (words are runs of other characters than ASCII white space, case-sensitive): A fails texts of under 200 words;
B those whose distinct words are under half of all; C those with over 3 % ASCII capitals; D those with one of
``#$%&*|``; E those equal to the text of a smaller doc_id, wherever it is.

Edge cases: a null text is empty; a null lang is the part ''. A null doc_id has no smaller one and is none; it carries
no labels. Rows that are repeated count once each, and are judged alike. Labels that contradict each other: one that says 1
is enough; null labels say nothing. An empty table gives no rows; a part has all its 600 rows, zeros included. Texts are
equal if their SHA-256 is, and rows of one doc_id hold one text if its 64-bit hash is the same. Other columns of the
documents are left out before anything is joined.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, split_words, written

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
_SETS = 1 << len(FILTERS)
SYMBOLS = r"[#$%&*|]"


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, n_distinct) of each document's text, ``key`` being its hash. Texts without words have no row.

    Texts move once, by document; what is exploded stays in its task.
    """
    texts = docs.groupBy("doc_id", "key").agg(F.min("text").alias("text"))
    words = texts.select("doc_id", "key", F.explode(split_words(F.col("text"), SPACES)).alias("word"))
    counts = words.groupBy("doc_id", "key", "word").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id", "key").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, A, B, C, D, E): for each row of the documents, which filters it fails."""
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("digest"))
    text = F.col("text")
    flags = rows.select(
        "doc_id", "lang", "key", "digest",
        (100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text)).alias("C"),
        text.rlike(SYMBOLS).alias("D"),
    )
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copied = written(copied.where("first_id < last_id").drop("last_id"), "copied-texts")  # a written table, so that a large group's join can be split
    totals = word_totals(rows).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "n_words", "n_distinct")
    flags = flags.join(copied, "digest", "left")
    flags = flags.join(totals, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    n_words, n_distinct = (F.coalesce(c, F.lit(0)) for c in ("n_words", "n_distinct"))
    return flags.select(
        "doc_id", "lang",
        (n_words < 200).alias("A"), (100 * n_distinct < 50 * n_words).alias("B"), "C", "D",
        F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).alias("E"),
    )


def set_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, all_sets, good_sets, toxic_sets): for each part, the documents by their set of failed filters.

    Sets are numbers, A being 1, B 2, up to E 16; each array has its counts by that number.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    number = sum((F.col(x).cast("int") * (1 << k) for k, x in enumerate(FILTERS)), F.lit(0))
    rows = failed.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), number.alias("set")).join(marks, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    counts = rows.groupBy("part", "good", "toxic").agg(*[F.count_if(F.col("set") == s).alias(f"n{s}") for s in range(_SETS)])
    # at most four rows a part are left
    merged = F.array(*[F.col(f"n{s}") for s in range(_SETS)])
    zeros = F.array_repeat(F.lit(0).cast("long"), _SETS)

    def added(which: Column) -> Column:
        return F.aggregate(F.collect_list(F.when(which, merged)), zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    return counts.groupBy("part").agg(added(F.lit(True)).alias("all_sets"), added(F.col("good")).alias("good_sets"), added(F.col("toxic")).alias("toxic_sets"))


def _bits(letters: Column) -> Column:
    return sum((F.when(letters.contains(x), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))


def _total(counts: str, holds, weight=lambda s: F.lit(1)) -> Column:
    """Sum over the sets that ``holds``."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(_SETS - 1)),
        F.lit(0).cast("long"),
        lambda total, s: total + F.when(holds(s), F.col(counts)[s] * weight(s)).otherwise(0),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, redundant, lost, and the filter's Shapley sum."""
    sets = set_counts(failures(docs), labels)
    steps = sets.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumns({
        "own": _bits(F.substring("filter_order", F.col("step"), F.lit(1))),
        "before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)),
    })
    own, before = F.col("own"), F.col("before")

    def of(s: Column, these: Column) -> Column:
        return s.bitwiseAND(these) != 0

    def first(s: Column) -> Column:
        return of(s, own) & ~of(s, before)

    return steps.select(
        "part", "filter_order", "step",
        _total("all_sets", lambda s: ~of(s, own) & ~of(s, before)).alias("kept"),
        _total("all_sets", first).alias("removed"),
        _total("all_sets", lambda s: of(s, own) & of(s, before)).alias("redundant"),
        _total("all_sets", lambda s: s == own).alias("unique_fails"),
        _total("good_sets", first).alias("good_lost"),
        _total("toxic_sets", first).alias("toxic_lost"),
        # in one of so many orders as the set has filters, this one comes first among them
        _total("all_sets", lambda s: of(s, own), lambda s: (F.lit(len(ORDERS)) / F.greatest(F.bit_count(s), F.lit(1))).cast("long")).alias("shapley"),
    )
