"""License scans by a positional index of rare words, with DataFrame functions only.

The words of the licence templates get document frequencies over all distinct texts. Each template is indexed by its
``top_words`` words of highest IDF, however frequent these are. A template whose mandatory key phrases stand in a text
is a candidate there: each occurrence of an indexed word meets the postings (template, position) of its word, and
occurrences whose distance to a template's start is the same support one placing of it. A candidate counts if at least
``least_share`` of its indexed positions support a placing, whatever other templates the text holds. Places of fixed
base phrases are found beside that.

What is shuffled is a row for each distinct text with template words for the frequencies, the placings of candidates
with their supports (added up in the task first), and a row per document.

Edge cases: a null or blank text has no words, no places and empty labels; repeated rows get a row each (rows
are numbered). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NON_WORD, ascii_lower, split_words, written

#: Phrase and label of the places that are always reported.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, template and mandatory key phrases.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license version 3",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)

Template = tuple[str, str, Sequence[str]]


def document_frequencies(docs: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """In how many distinct texts each of the given words occurs; one row a word reaches the driver."""
    found = F.array_distinct(F.filter(split_words(ascii_lower(F.col("text")), NON_WORD), lambda w: w.isin(list(words))))
    texts = docs.select(F.xxhash64("text").alias("text_hash"), found.alias("found")).where(F.size("found") > 0)
    texts = texts.groupBy("text_hash").agg(F.first("found").alias("found"))
    rows = texts.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(words, 0) | {r["word"]: r["n"] for r in rows}


def _phrase_starts(words: str, phrase: str) -> Column:
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - len(parts)))

    def here(i):
        same = F.get(F.col(words), i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same &= F.get(F.col(words), i + k) == part
        return F.coalesce(same, F.lit(False))

    return F.filter(starts, here)


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, top_words: int = 8, least_share: float = 0.5
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays) and score."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    df = document_frequencies(docs, vocabulary)
    top = [sorted(set(text.split()), key=lambda w: (df[w], w))[:top_words] for _, text, _ in templates]
    indexed = sorted({w for words in top for w in words})
    number = {w: k for k, w in enumerate(indexed, 1)}
    postings = [(number[w], t, k) for t, (_, text, _) in enumerate(templates) for k, w in enumerate(text.split()) if w in top[t]]
    sizes = [sum(p[1] == t for p in postings) for t in range(len(templates))]

    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), split_words(ascii_lower(F.col("text")), NON_WORD).alias("words"))
    words = words.withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    none = F.array().cast("array<int>")
    lookup = F.array(*[F.lit(w) for w in indexed])
    places = F.filter(
        F.transform("words", lambda w, i: F.struct(F.array_position(lookup, w).cast("int").alias("word"), i.alias("pos"))),
        lambda p: p["word"] > 0,
    )
    holds = [
        F.when(F.lit(True) if not phrases else _all([F.contains("line", F.lit(f" {p} ")) for p in phrases]), F.lit(t))
        for t, (_, _, phrases) in enumerate(templates)
    ]
    starts = [F.when(F.contains("line", F.lit(f" {p} ")), _phrase_starts("words", p)).otherwise(none) for p, _ in BASE]
    words = words.withColumn("phrases", F.array_compact(F.array(*holds)))
    table = words.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        *[s.alias(f"base{k}") for k, s in enumerate(starts)],
        F.when(F.size("phrases") > 0, places).otherwise(F.array().cast("array<struct<word:int,pos:int>>")).alias("places"),
        "phrases",
    )
    table = written(table, "license-words")

    spark = docs.sparkSession
    index = F.broadcast(spark.createDataFrame(postings, "word int, template int, at int"))  # as many rows as the templates have words
    support = (
        table.where(F.size("places") > 0)
        .select("row", "phrases", F.inline("places"))
        .join(index, "word")
        .where(F.array_contains("phrases", F.col("template")))
        .groupBy("row", "template", (F.col("pos") - F.col("at")).alias("offset"))
        .agg(F.count("*").alias("n"))
        .groupBy(F.col("row").alias("s_row"), "template")
        .agg(F.max("n").alias("n"))
    )
    share = F.least(F.lit(1.0), F.col("n") / F.element_at(F.array(*[F.lit(max(1, s)) for s in sizes]), F.col("template") + 1))
    placed = support.withColumn("share", share).where(F.col("share") >= least_share).groupBy("s_row").agg(F.collect_list(F.struct("template", "share")).alias("placed"))
    both = table.join(placed, F.col("row") == F.col("s_row"), "left")

    good = F.coalesce("placed", F.array().cast("array<struct<template:int,share:double>>"))
    all_starts = F.concat(*[F.col(f"base{k}") for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    names = F.array(*[F.lit(name) for name, _, _ in templates])
    out = both.withColumn("good", good).withColumn("starts", all_starts).withColumn("base_labels", F.array_sort(base))
    return out.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        "base_labels",
        F.array_sort(F.array_union("base_labels", F.transform("good", lambda p: F.element_at(names, p["template"] + 1)))).alias("labels"),
        F.coalesce(F.array_max(F.transform("good", lambda p: p["share"])), F.when(F.size("starts") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out
