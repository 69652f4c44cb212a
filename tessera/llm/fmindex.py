"""Exact substring deduplication: word windows that also start in an earlier document, found with FM-indexes.

Equal windows are brought together by content. Each window's anchor is the 8-word gram of least hash in it; windows
next to each other with the same anchor form a context. Anchors that stand in one document only are dropped, after a
count that is combined before it is shuffled. Of the contexts left, equal ones are one, with its smallest document;
they are dealt into shards by anchor, so that equal windows share a shard. An anchor with more than ``crowded``
different contexts fills no shard: its single windows are dealt by a 128-bit hash of their words instead, and the
smallest document of each hash is found before equal windows meet in one task.

Each shard gets an FM-index: the Burrows-Wheeler transform of its contexts, by suffix sorting to the window's depth, in
a wavelet matrix. Contexts are streamed against it: backward search keeps, at each word, the longest match that
starts there (up to the window), by extending to the left and giving up words on the right. Where the match reaches
the window, its interval of suffixes gives the smallest document that holds it. That goes back to every place where
the context stands. Words are compared as 64-bit hashes in anchors and contexts, and as they are in the index.

Edge cases: a null text has no words; rows without doc_id neither lose words nor make others lose them; rows that
share a doc_id are one document, to whose windows only smaller doc_ids count. Windows within one document never
count. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, written
from tessera.llm.wavelet import WaveletMatrix

WINDOW, ANCHOR = 50, 8
_BYTES, _WORDS = 1 << 20, 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD, _ODD_WORDS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_VALUES = np.random.default_rng(50).integers(0, 1 << 64, 256, np.uint64)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if (base, n) not in _powers:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(n, b, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers[base, n] = out[0], out[1]
    return _powers[base, n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray, base: int, n: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power_tables(base, n)[0][: len(values)])])


def hash_words(data: bytes) -> np.ndarray:
    """A hash of each word, at most about _BYTES at a time."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + _BYTES)
        if end < len(data):
            block = np.frombuffer(data[at:end], np.uint8)
            spaces = np.flatnonzero(_SPACE[block])
            end = at + int(spaces[-1]) + 1 if len(spaces) else _next_space(data, end)
        block = np.frombuffer(data[at:end], np.uint8)
        edges = np.diff(np.concatenate([[True], _SPACE[block], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        n = max(len(block), _BYTES)
        sums = _sums(_VALUES[block], _ODD, n)
        out.append(_mixed((sums[ends] - sums[starts]) * _power_tables(_ODD, n)[1][starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _next_space(data: bytes, at: int) -> int:
    while at < len(data) and not _SPACE[data[at]]:
        at += 1
    return at


def contexts_of(words: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows, anchor and hash of each context among at most _WORDS + window words; doc: ascending."""
    n = len(words)
    windows = n - window + 1
    if windows < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    size = max(n, _WORDS + window)
    sums, inverse = _sums(words, _ODD_WORDS, size), _power_tables(_ODD_WORDS, size)[1]
    grams = _mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64((1 << 20) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:windows], least[span - width : span - width + windows])
    at = (least & low).astype(np.int64)
    whole = np.flatnonzero(doc[:windows] == doc[window - 1 :])
    if not len(whole):
        return contexts_of(words[:0], doc[:0], window, gram)
    fresh = np.concatenate([[True], (np.diff(whole) != 1) | (np.diff(at[whole]) != 0)])
    first = np.flatnonzero(fresh)
    start, count = whole[first], np.diff(np.concatenate([first, [len(whole)]]))
    end = start + count + window - 1
    hashed = _mixed((sums[end] - sums[start]) * inverse[start] + count.astype(np.uint64))
    return start, count, grams[at[start]], hashed


_OCCURRENCE = "doc_id long, text_hash int, anchor long, context long, start int, windows int"


def occurrences(docs: DataFrame, window: int = WINDOW, gram: int = ANCHOR) -> DataFrame:
    """Every context of every document: where it starts and how many windows it has."""

    def rows(ids, hashes, doc, base, words) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), _WORDS):
            here = slice(at, at + _WORDS + window - 1)
            start, count, anchor, context = contexts_of(words[here], doc[here], window, gram)
            if len(start):
                of = doc[here][start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of]), pa.array(hashes[of]), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
                     pa.array((start + at - base[of]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=[x.split()[0] for x in _OCCURRENCE.split(", ")],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes = batch.column(1).to_numpy(zero_copy_only=False)
            held, size, first = [], 0, 0
            for k, text in enumerate([*batch.column(2), None]):
                last = k == batch.num_rows
                if not last:
                    data = text.as_py().encode()
                    held.append(data)
                    size += len(data)
                if held and (last or size >= _BYTES):
                    found = [hash_words(held[0])] if len(held) == 1 else _split_hashes(held)
                    counts = np.array([len(x) for x in found])
                    doc = np.repeat(np.arange(len(found)), counts)
                    yield from rows(ids[first:], hashes[first:], doc, np.concatenate([[0], np.cumsum(counts)[:-1]]), np.concatenate(found))
                    held, size, first = [], 0, k + 1

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OCCURRENCE)


def _split_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """hash_words of several texts in one go."""
    joined = b"\n".join(texts)
    words = hash_words(joined)
    block = np.frombuffer(joined, np.uint8)
    starts = np.flatnonzero(~_SPACE[block] & np.concatenate([[True], _SPACE[block[:-1]]]))
    cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])[:-1])
    return np.split(words, cuts)


class FMIndex:
    """Counts of patterns up to ``window`` symbols in a text over 1, 2, ... with 0 as separator and at the end."""

    def __init__(self, text: np.ndarray, window: int):
        n = self.n = len(text)
        self.window = window
        symbols = int(text.max(initial=0)) + 1
        rank, width = text.astype(np.int64), 1
        depth = window - 1
        half = 1 << (depth.bit_length() - 1)  # two stretches of this width make the depth
        at_half = rank if half == 1 else None
        order = np.argsort(rank, kind="stable")
        while width < window:
            key = rank * (n + 1) + np.concatenate([rank[width:], np.zeros(min(width, n), np.int64)])[:n]
            order = np.argsort(key)
            fresh = np.concatenate([[0], np.diff(key[order]) != 0])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            width *= 2
            if width == half:
                at_half = rank
        self.suffixes = order
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        self.matrix = WaveletMatrix.build(text[order - 1].astype(np.uint32), max(1, (symbols - 1).bit_length()))
        self.counts = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in self.matrix.planes]
        self.low = self._down(np.zeros(symbols, np.int64), np.arange(symbols))
        # Suffixes that agree in all but the window's last symbol.
        padded = np.concatenate([at_half, np.zeros(depth, np.int64)])
        a, b = order[1:], order[:-1]
        same = (padded[a] == padded[b]) & (padded[a + depth - half] == padded[b + depth - half])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        group = np.cumsum(np.concatenate([[0], ~same]))
        self.group_start, self.group_end = starts[group], np.concatenate([starts[1:], [n]])[group]

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where positions go on the last level, on the way of their symbols."""
        m = self.matrix
        for level in range(m.levels):
            word = at >> 6
            ones = self.counts[level][word] + np.bitwise_count(m.planes[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (m.levels - 1 - level)) & 1, m.zeros[level] + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before them."""
        both = self._down(np.concatenate([low, high]), np.concatenate([symbol, symbol])) - np.tile(self.low[symbol] - self.before[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def windows(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, and interval of suffixes, of every window of the streams that occurs in the text.

        Streams are ``symbols[starts[k]:ends[k]]``; a symbol that the text lacks is given as -1. All streams move in
        step: a match symbols[at + 1:end] grows to the left, gives up its last symbol at full length, and starts anew
        one symbol shorter where it can't grow.
        """
        at, end = ends - 1, ends.copy()
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        stop, out = starts.copy(), []
        while True:
            live = at >= stop
            if not live.all():
                at, end, low, high, stop = at[live], end[live], low[live], high[live], stop[live]
            if not len(at):
                break
            full = end - at - 1 == self.window
            low, high, end = np.where(full, self.group_start[np.minimum(low, self.n - 1)], low), np.where(full, self.group_end[np.minimum(low, self.n - 1)], high), end - full
            symbol = symbols[at]
            new_low, new_high = self.extend(low, high, np.maximum(symbol, 0))
            good = (symbol > 0) & (new_low < new_high)
            short = ~good & (end - at == 1)
            low, high = np.where(good, new_low, 0), np.where(good, new_high, self.n)
            end = np.where(good, end, np.where(short, at, end - 1))
            at = np.where(good | short, at - 1, end - 1)
            done = good & (end - at - 1 == self.window)
            if done.any():
                out.append((at[done] + 1, low[done], high[done]))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out))


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of each stretch values[low:high], none of them empty."""
    size = high - low
    level = np.floor(np.log2(size)).astype(np.int64)
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        rows = np.flatnonzero(level == k)
        out[rows] = np.minimum(table[low[rows]], table[high[rows] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def first_documents(contexts: list[list[bytes]], documents: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each context, the smallest document among the contexts that hold it."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(c) for c in contexts])
    text = np.fromiter((n for c in contexts for n in (*(numbers.setdefault(w, len(numbers) + 1) for w in c), 0)), np.int64, int(lengths.sum()) + len(lengths))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    index = FMIndex(text, window)
    ids, rank = np.unique(documents, return_inverse=True)
    owner = np.repeat(rank, lengths + 1)[index.suffixes]
    at, low, high = index.windows(text, starts, ends)
    least = np.full(len(text), -1, np.int64)
    least[at] = ids[least_in(owner, low, high)]
    return [least[s : e - window + 1] for s, e in zip(starts, ends)]


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = ANCHOR, shard_words: int = 400_000, crowded: int = 2000) -> DataFrame:
    """doc_id, text_hash and spans (begin, end; in words, may overlap) of the words that earlier documents hold."""
    found = written(occurrences(docs, window, gram), "contexts")
    shared = written(found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "shared-anchors")
    found = written(found.join(shared, "anchor", "left_semi"), "shared-contexts")
    distinct = found.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("at"), F.min("windows").alias("windows"))
    crowds = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("anchor", F.lit(True).alias("single"))
    distinct = written(distinct.join(crowds, "anchor", "left").select("anchor", "context", "at", "windows", F.coalesce("single", F.lit(False)).alias("single")), "distinct-contexts")
    total = distinct.where(~F.col("single")).agg(F.sum(F.col("windows") + window - 1)).first()[0]
    shards = max(1, -(-(total or 0) // shard_words))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("text_hash"), F.col("text").cast("string").alias("text"))

    def hashed(words: list[bytes], windows: int) -> list[tuple[int, bytes]]:
        import xxhash

        return [(k, xxhash.xxh3_128_digest(b" ".join(words[k : k + window]))) for k in range(windows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
        names = ["anchor", "context", "single", "skip", "first", "words"]
        for batch in batches:
            rows = []
            for doc_id, text, want in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().encode().split()
                for w in want:
                    own = words[w["start"] : w["start"] + w["windows"] + window - 1]
                    cut = hashed(own, w["windows"]) if w["single"] else [(0, b" ".join(own))]
                    rows += [(w["anchor"], w["context"], w["single"], skip, doc_id, part) for skip, part in cut]
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    wanted = distinct.groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.text_hash").alias("w_hash"))
    wanted = wanted.agg(F.collect_list(F.struct("anchor", "context", "single", F.col("at.start").alias("start"), "windows")).alias("wanted"))
    rows = texts.join(wanted, (F.col("doc_id") == F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).select("doc_id", "text", "wanted")
    # words of whole contexts, and of crowded anchors' contexts the hashes of their windows: out of one pass over the texts
    words = rows.mapInArrow(run, "anchor long, context long, single boolean, skip int, first long, words binary")
    crowded_too = bool(distinct.where("single").head(1))
    words = written(words, "context-words") if crowded_too else words

    def search(table: pa.Table) -> pa.Table:
        contexts = [x.split(b" ") for x in table.column("words").to_pylist()]
        least = first_documents(contexts, table.column("first").to_numpy(), window)
        return pa.table([table.column("anchor"), table.column("context"), table.column("skip"), pa.array([x.tolist() for x in least], pa.list_(pa.int64()))], names=["anchor", "context", "skip", "least"])

    sharded = words.where("NOT single").drop("single").withColumn("shard", F.pmod("anchor", F.lit(shards)))
    least = written(sharded.groupBy("shard").applyInArrow(search, "anchor long, context long, skip int, least array<long>"), "first-documents")
    if crowded_too:
        # Equal single windows are brought together by their hash: combined in the tasks, joined back as written tables.
        single = words.where("single")
        firsts = written(single.groupBy(F.col("words").alias("content")).agg(F.min("first").alias("least")), "distinct-windows")
        single = single.join(firsts, F.col("words") == F.col("content")).select("anchor", "context", "skip", F.array("least").alias("least"))
        least = least.union(single)

    places = found.join(least, ["anchor", "context"]).where(F.exists("least", lambda d: d < F.col("doc_id")))
    # A stretch of windows that an earlier document holds is one span.
    held = F.transform("least", lambda d: d < F.col("doc_id"))
    places = places.select("doc_id", "text_hash", (F.col("start") + F.col("skip")).alias("begin"), held.alias("held"))
    edges = F.filter(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.get("held", i) & ~F.coalesce(F.get("held", i - 1), F.lit(False)))
    lasts = F.filter(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.get("held", i) & ~F.coalesce(F.get("held", i + 1), F.lit(False)))
    spans = F.zip_with(edges, lasts, lambda a, b: F.struct((F.col("begin") + a).alias("begin"), (F.col("begin") + b + window).alias("end")))
    return places.select("doc_id", "text_hash", spans.alias("spans")).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_words(n: int, spans: list[dict]) -> np.ndarray:
    """Marks of the words that no span covers."""
    edges = np.zeros(n + 1, np.int64)
    for s in spans:
        edges[s["begin"]] += 1
        edges[s["end"]] -= 1
    return np.cumsum(edges[:-1]) == 0


def _with_spans(docs: DataFrame, window: int, **options) -> tuple[DataFrame, str]:
    """The documents with their spans, and the name of that column, which no other column has."""
    of_id, of_hash, name = free_names(docs, "cut_id", "cut_hash", "cut_spans")
    spans = removed_spans(docs, window, **options).select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("spans").alias(name))
    return docs.join(spans, (F.col("doc_id") == F.col(of_id)) & (F.hash("text") == F.col(of_hash)), "left").drop(of_id, of_hash), name


def digests(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                kept = words
                if spans.is_valid:
                    kept = [w for w, k in zip(words, kept_words(len(words), spans.as_py()).tolist()) if k]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut, spans = _with_spans(rows, window, **options)
    return cut.select("doc_id", "text", spans).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """``docs`` without the words that earlier documents hold: the stretches left, one a line; documents of which nothing is left go.

    All columns are kept; n_chars, if there, follows the text.
    """
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of = batch.schema.get_field_index("text"), batch.schema.get_field_index(spans_name)
            texts: list[str | None] = []
            stay = []
            for text, spans in zip(batch.column(at), batch.column(of)):
                value = text.as_py()
                if spans.is_valid:
                    places = [m.span() for m in word.finditer(value)]
                    kept = np.concatenate([[False], kept_words(len(places), spans.as_py()), [False]]).astype(np.int8)
                    edges = np.diff(kept)
                    value = "\n".join(value[places[a][0] : places[b - 1][1]] for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
                texts.append(value)
                stay.append(not spans.is_valid or bool(value))
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns) if k != of]
            yield pa.RecordBatch.from_arrays(columns, names=[x for x in batch.schema.names if x != spans_name]).filter(pa.array(stay))

    cut, spans_name = _with_spans(docs, window, **options)
    out = cut.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
