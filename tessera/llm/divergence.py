"""Quality rules by distribution divergence, with DataFrame functions only.

Each text gives two histograms: characters by class, and words by a list of common words (all others are one bin).
Their references are the same histograms summed over the documents of a language that pass the base rule; a language
whose reference would have under ``least_reference`` words has that of all languages together. A text is rejected if the
Jensen-Shannon distance (base 2, 0 to 1) to its language's reference is over a threshold, where the text has enough
characters or words to tell. Everything about a text is computed in its own row; what is shuffled is one row for each
language and bin.

Windows of three words are compared by a 64-bit hash within one text.

Edge cases: a null or blank text has no words and fails the base rule; a null lang is a language of its own, as is
any value of lang; repeated rows get a row each and count each in the references. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, ascii_lower, split_words, written

#: Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in is that for it was on with as at by from this be are or an not have had but which you they "
    "le la les de des du et un une que est en dans pour pas qui sur au avec ce il elle plus par se son sont "
    "der die das und ist nicht ein eine zu den von mit dem auf für im sich des auch als es an werden aus er hat "
    "el los las y que una por con para su al lo como más pero sus le ha me si sin sobre este ya o fue"
).split()
COMMON = sorted(set(COMMON_WORDS))
SYMBOLS = "#*$%&|<>"
SYMBOL_CLASS = r"[#*$%&|<>]+"
#: Character classes, taken out one after the other; what is left at the end is the last class.
CLASSES = (("lower", "[a-z]+"), ("space", SPACES), ("upper", "[A-Z]+"), ("symbol", SYMBOL_CLASS), ("digit", "[0-9]+"), ("mark", r"[\x00-\x7F]+"))


def repeated_window_words(df: DataFrame, words: str, out: str, window: int = 3) -> DataFrame:
    """Adds the number of words that lie in windows found twice or more in the array ``words``."""
    n = F.size(words) - (window - 1)
    at = [F.col(words)[i] for i in range(window)]
    hashed = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(len(at))])))
    df = df.withColumn("_hash", F.coalesce(hashed, F.array().cast("array<bigint>")))
    pairs = F.array_sort(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_pairs", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), pairs))
    same = F.filter("_pairs", lambda p, k: (F.get(F.col("_pairs"), k - 1)["h"] == p["h"]) | (F.get(F.col("_pairs"), k + 1)["h"] == p["h"]))
    df = df.withColumn("_at", F.sort_array(F.transform(same, lambda p: p["i"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, i):
        return F.struct((i + window).alias("end"), (acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"))

    covered = F.aggregate("_at", zero, step, lambda acc: acc["n"])
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_hash", "_pairs", "_at")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, ``chars`` (by class) and ``common``, ``counts`` (common words found and how often)."""
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", split_words(F.col("text"), SPACES))
    df = repeated_window_words(df, "words", "n_repeat_words")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    rest, left = "text", []
    for name, pattern in CLASSES:
        df = df.withColumn(f"_{name}", F.regexp_replace(rest, pattern, ""))
        left.append(F.char_length(rest) - F.char_length(f"_{name}"))
        rest = f"_{name}"
    chars = F.array(*left, F.char_length(rest))
    found = F.sort_array(F.filter(F.transform("words", ascii_lower), lambda w: w.isin(COMMON)))
    df = df.withColumn("_found", found).withColumn("common", F.array_distinct("_found"))
    df = df.withColumn("_first", F.transform("common", lambda w: F.array_position(F.col("_found"), w)))
    counts = F.transform("_first", lambda p, k: F.coalesce(F.get(F.col("_first"), k + 1), F.size("_found") + F.lit(1).cast("long")) - p)
    return df.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        left[[n for n, _ in CLASSES].index("symbol")].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.size("words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.size("words"))).alias("base_failed"),
        chars.cast("array<long>").alias("chars"),
        "common",
        counts.cast("array<long>").alias("counts"),
    )


def references(stats: DataFrame) -> DataFrame:
    """A row per language: ``reference_words`` (how many), ``ref_chars`` and ``ref_words``, shares of each class and of each word of COMMON."""
    k = len(CLASSES) + 1
    classes = stats.groupBy("lang").agg(*[F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(k)], F.sum("n_words").alias("words"))
    total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(k)])
    classes = classes.select("lang", "words", F.array(*[F.coalesce(F.try_divide(F.col(f"c{i}"), total), F.lit(0.0)) for i in range(k)]).alias("ref_chars"))
    words = (
        stats.select("lang", F.explode(F.arrays_zip("common", "counts")).alias("x"))
        .groupBy("lang", F.col("x.common").alias("word"))
        .agg(F.sum("x.counts").alias("n"))
        .groupBy(F.col("lang").alias("w_lang"))
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("ref_counts"))
    )
    both = classes.join(words, F.col("lang").eqNullSafe(F.col("w_lang")), "left")
    share = [F.coalesce(F.try_divide(F.col("ref_counts")[w], F.col("words")), F.lit(0.0)) for w in COMMON]
    return both.select(F.col("lang").alias("r_lang"), F.col("words").alias("reference_words"), "ref_chars", F.array(*share).alias("ref_words"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of like length."""

    def part(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)))


def with_rest(shares: Column) -> Column:
    """Shares, and what they leave to one."""
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x))))


def distances(docs: DataFrame, broadcast_languages: int = 1000, least_reference: int = 5000) -> DataFrame:
    """``text_statistics`` with char_distance, word_distance and n_chars."""
    stats = written(text_statistics(docs), "text-statistics")
    sound = stats.where(~F.col("base_failed"))
    refs = written(references(sound).where(F.col("reference_words") >= least_reference), "language-references")
    every = references(sound.withColumn("lang", F.lit(None).cast("string"))).first()  # one row
    pooled = {c: F.array(*[F.lit(x) for x in every[c]]) if every else F.lit(None).cast("array<double>") for c in ("ref_chars", "ref_words")}
    if refs.count() <= broadcast_languages:
        refs = F.broadcast(refs)
    df = stats.join(refs, F.col("lang").eqNullSafe(F.col("r_lang")), "left")
    df = df.withColumns({c: F.coalesce(c, other) for c, other in pooled.items()}).drop("reference_words")
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda acc, x: acc + x)
    df = df.withColumn("n_chars", n_chars)
    # Only words that the text holds differ from word to word; array_position finds their share.
    df = df.withColumn("_p", F.transform("counts", lambda n: F.try_divide(n, F.col("n_words"))))
    lookup = F.array(*[F.lit(w) for w in COMMON])
    df = df.withColumn("_q", F.transform("common", lambda w: F.get(F.col("ref_words"), (F.array_position(lookup, w) - 1).cast("int"))))
    # Bins: the words found, all other words, and the common words not found (in which the text has no share).
    all_common = F.aggregate("ref_words", F.lit(0.0), lambda acc, x: acc + x)
    found_common = F.aggregate("_q", F.lit(0.0), lambda acc, x: acc + x)
    p = F.concat(with_rest(F.col("_p")), F.array(F.lit(0.0)))
    q = F.concat(F.col("_q"), F.array(F.greatest(F.lit(0.0), 1 - all_common), F.greatest(F.lit(0.0), all_common - found_common)))
    shares = F.transform("chars", lambda n: F.coalesce(F.try_divide(n, F.col("n_chars")), F.lit(0.0)))
    return df.withColumn("char_distance", js_distance(shares, F.col("ref_chars"))).withColumn("word_distance", js_distance(p, q)).drop("_p", "_q", "ref_chars", "ref_words", "r_lang")


def quality(docs: DataFrame, char_limit: float = 0.3, word_limit: float = 0.45, min_chars: int = 200, min_words: int = 50, least_reference: int = 5000) -> DataFrame:
    """``distances`` with kept."""
    far = ((F.col("n_chars") >= min_chars) & (F.col("char_distance") > char_limit)) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit))
    return distances(docs, least_reference=least_reference).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
