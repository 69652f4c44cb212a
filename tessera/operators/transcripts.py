"""Captions to paragraphs. A cue is (doc_id, cue_no, seconds, text, speaker).

What depends on the row before only is a window; the true recurrences (rolling captions, paragraphs decided word by
word) are folds over sorted cues that hold one document's open paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds

MIN_WORDS, MAX_WORDS = 55, 120
_SENTENCE_END = re.compile(r"[.!?…][\"»”')\]]?$")
PARAGRAPHS = "paragraph int, seconds double, speaker string, text string, n_words int, shown string"


def without_repetition(before: str, now: str) -> str:
    """A rolling caption without what the one before has said already."""
    if before and now == before:
        return ""
    return now[len(before) + 1 :] if before and now.startswith(before + " ") else now


class _Rolling:
    """A document's captions without repetitions: only what was said last is kept."""

    def __init__(self) -> None:
        self.before = ""

    def add(self, text: str | None, *rest) -> Iterator[tuple]:
        said = without_repetition(self.before, text or "")
        if said.strip():
            self.before = said
            yield (said, *rest)

    def end(self) -> Iterator[tuple]:
        return iter(())


def rolling_dedup(cues: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("cue_no",)) -> DataFrame:
    """(keys, text, order): cues without what the one before has said already; those that say nothing else are left out."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (cues.schema[c] for c in order if c != "text"))
    rest = [c for c in order if c != "text"]
    return folds.folded(cues, keys, order, ["text", *rest], _Rolling, f"text string, {kinds}" if kinds else "text string")


def speaker_islands(cues: DataFrame, doc: str = "doc_id", order: str = "cue_no", speaker: str = "speaker") -> DataFrame:
    """Adds ``who`` (a blank speaker is the last one named) and ``island`` (a new one when another speaks)."""
    w = Window.partitionBy(doc).orderBy(order)
    named = F.when(F.trim(F.coalesce(F.col(speaker), F.lit(""))) != "", F.col(speaker))
    who = F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit(""))
    fresh = F.when(F.col("who") != F.coalesce(F.lag("who").over(w), F.lit("")), 1).otherwise(0)
    return cues.withColumn("who", who).withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w)).drop("_fresh")


class _Paragraphs:
    """The paragraph that is open: its words, when it began, and who speaks."""

    def __init__(self, group: str, dedup: bool, times: str = "no"):
        self.group, self.dedup, self.times = group, dedup, times
        self.words: list[str] = []
        self.start: float | None = None
        self.who = self.before = ""
        self.number = 0

    def end(self) -> Iterator[tuple]:
        if not self.words:
            return
        shown = " ".join(self.words)
        if self.who:
            shown = f"{self.who}: {shown}"
        if self.times != "no" and self.start is not None:
            shown = f"[{clock(self.start)}] {shown}"
        yield self.number, self.start, self.who, " ".join(self.words), len(self.words), shown
        self.number += 1
        self.words, self.start = [], None

    def add(self, seconds: float | None, text: str | None, speaker: str | None) -> Iterator[tuple]:
        said = without_repetition(self.before, text or "") if self.dedup else text or ""
        if not said.strip():
            return
        self.before = said
        if speaker and speaker != self.who:
            yield from self.end()
            self.who = speaker
        self.start = seconds if self.start is None else self.start
        for word in said.split():
            self.words.append(word)
            if self.group == "sentences" and (len(self.words) >= MAX_WORDS or len(self.words) >= MIN_WORDS and _SENTENCE_END.search(word)):
                yield from self.end()
                self.start = seconds
        if self.group == "cue" or self.times == "cue":
            yield from self.end()


def clock(seconds: float) -> str:
    """``m:ss``, from an hour on ``h:mm:ss``."""
    minutes, rest = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}:{minutes:02d}:{rest:02d}" if hours else f"{minutes}:{rest:02d}"


def paragraphs(cues: DataFrame, group: str = "sentences", dedup: bool = True, times: str = "no") -> DataFrame:
    """The paragraphs of each document: number, seconds, speaker, text, n_words, and ``shown``, with time mark and name before the text.

    group: ``sentences`` closes at the end of a sentence from MIN_WORDS on, or at MAX_WORDS; ``cue`` after each cue;
    ``speaker`` only when another one speaks. times: ``no`` marks; one before each ``paragraph``; or before each ``cue``, which
    then is a paragraph.
    """
    if group not in ("sentences", "cue", "speaker") or times not in ("no", "paragraph", "cue"):
        raise ValueError(f"group {group!r}, times {times!r}")
    cues = cues.select("doc_id", "cue_no", F.col("seconds").cast("double").alias("seconds"), "text", "speaker")
    return folds.folded(cues, ["doc_id"], ["cue_no", "text"], ["seconds", "text", "speaker"], lambda: _Paragraphs(group, dedup, times), PARAGRAPHS)
