"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of the words of trusted text.

The vocabulary is open: each pair of words that follow each other in a trusted document is counted, with its start and
end. The counts are a table that grows with the corpus. Pairs are dealt into shards by their first word, as many shards
as the text needs (``shard_bytes`` of trusted text each, or four times that of all text), so a shard has all that a first
word's back-off needs. First words that make up ``hot_share`` of the words or more would fill a shard; their pairs go by
both words, and their sums (two numbers for each) are broadcast. A word's continuation count, the number of different
words before it, is kept for the words that make up ``word_share`` of the trusted text or more (at most 1 / word_share,
broadcast). All other words share what mass is left by their spelling: Kneser-Ney over characters folded to ``SYMBOLS``
symbols, order 4, of at most SYMBOLS**4 entries, and therefore broadcast.

Scoring is a join by shard: each task counts the pairs of each of its documents, sorts those of a block of documents by
shard and pair, and packs them (sorted keys as steps, byte by byte, compressed), as rows of plain columns would take
several times the input on disk. A shard meets its packed pairs with its counts, adds up a number for each document, and
the numbers of all shards come together by block, where the documents' other columns wait. Words are 32 bits of hash.
Documents are asked for in ``parts`` one after another, as a part's packed pairs go when it is written.

A trusted document's words and pairs that no other trusted text has count as unmet for it, as they would for others.
A document is rejected if its perplexity is over ``margin`` times its limit. As short texts vary more, limits follow
length: the logarithm of the perplexity is fitted to 1 / sqrt(bytes) over all trusted documents, with a level for each
language, and its spread to 1 / bytes; the limit lies as many spreads over the fit as the ``quantile`` of the trusted
documents of the language. So each document has a limit, whatever its length. A language with fewer than
``least_documents`` trusted ones takes level and quantile of all trusted documents.

Edge cases: a null or blank text has no words and no perplexity and is rejected; a null lang is a language of its own; without
trusted text, nothing is rejected but such texts. Repeated rows get a row each. An empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, brief_shuffles, free_names, small_batches, written

ORDER = 4


def _folding() -> np.ndarray:
    """Symbol of each byte of UTF-8."""
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[0:33] = 26  # white space and controls
    table[ord("\n")] = 27
    table[ord("A") : ord("Z") + 1] = 28
    table[ord("0") : ord("9") + 1] = 29
    for k, mark in enumerate(".,'\"-!?:;()"):
        table[ord(mark)] = 30 + k
    rest = [x for x in range(33, 128) if table[x] == 0 and x != ord("a")]
    table[rest] = 41
    table[0x80:0xC0] = 42 + (np.arange(64) & 7)
    table[0xC0:256] = 50
    return table


FOLDING = _folding()
SYMBOLS = int(FOLDING.max()) + 1
_START = np.full(ORDER - 1, FOLDING[ord("\n")], np.int32)
_BLOCK = 1 << 20


def codes(text: str) -> Iterator[np.ndarray]:
    """The n-gram of each byte of a text, in blocks; the first three stand after line ends."""
    data = text.encode()
    for at in range(0, len(data), _BLOCK):
        here = FOLDING[np.frombuffer(data[at : at + _BLOCK], np.uint8)].astype(np.int32)
        before = _START if not at else FOLDING[np.frombuffer(data[at - ORDER + 1 : at], np.uint8)].astype(np.int32)
        line = np.concatenate([before, here])
        n = len(here)
        code = line[:n].copy()
        for k in range(1, ORDER):
            code = code * SYMBOLS + line[k : k + n]
        yield code


def count_grams(texts: DataFrame) -> DataFrame:
    """gram and n over all of ``texts.text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int32)
        for batch in batches:
            blocks, held = [], 0
            for x in batch.column(0):
                for code in codes(x.as_py() or ""):
                    blocks.append(code)
                    held += len(code)
                    if held > _BLOCK:
                        _add(total, blocks)
                        blocks, held = [], 0
            if blocks:
                _add(total, blocks)
        grams = np.flatnonzero(total)
        for at in range(0, len(grams), 1 << 16):
            g = grams[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(total[g].astype(np.int64))], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _add(total: np.ndarray, blocks: list[np.ndarray]) -> None:
    grams, n = np.unique(np.concatenate(blocks), return_counts=True)
    total[grams] += n.astype(np.int32)


def discounts(counts: DataFrame) -> list[float]:
    """Discounts of n-grams counted once, twice and more often (modified Kneser-Ney, from the counts of counts)."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"t{k}") for k in (1, 2, 3, 4)]).first()
    return discounts_of([row[f"t{k}"] for k in (1, 2, 3, 4)])


def train(trusted: DataFrame) -> np.ndarray | None:
    """The spelling model: negative log2 probability of every n-gram's last symbol after the others; None without trusted text."""
    by_order = {ORDER: written(count_grams(trusted), "grams-4")}
    if not by_order[ORDER].head(1):
        return None
    for n in range(ORDER - 1, 0, -1):  # an n-gram's continuation count: the different symbols before it
        below = by_order[n + 1].groupBy((F.col("gram") % SYMBOLS**n).alias("gram")).agg(F.count("*").alias("n"))
        by_order[n] = written(below, f"grams-{n}")
    lower, table = None, np.full(1, 1.0 / SYMBOLS)
    for n in range(1, ORDER + 1):
        counts = by_order[n].withColumn("context", F.floor(F.col("gram") / SYMBOLS).cast("long"))
        d = discounts(counts)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        contexts = counts.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("mass")).withColumn("weight", F.col("mass") / F.col("total"))
        seen = counts.join(contexts, "context").withColumn("own", (F.col("n") - cut) / F.col("total"))
        if lower is None:
            seen = seen.withColumn("p", F.col("own") + F.col("weight") / SYMBOLS)
        else:
            seen = seen.withColumn("suffix", F.col("gram") % SYMBOLS ** (n - 1)).join(lower, "suffix").withColumn("p", F.col("own") + F.col("weight") * F.col("lower_p"))
        seen = written(seen.select("gram", "context", "weight", "p"), f"probabilities-{n}")
        lower = seen.select(F.col("gram").alias("suffix"), F.col("p").alias("lower_p"))
        # What wasn't seen gets the context's weight of the lower order's probability.
        found = seen.select("gram", "p").toArrow()
        weights = seen.groupBy("context").agg(F.first("weight").alias("weight")).toArrow()
        weight = np.ones(SYMBOLS ** (n - 1))
        weight[weights["context"].to_numpy()] = weights["weight"].to_numpy()
        suffixes = table if n > 1 else np.full(SYMBOLS, table[0])
        table = (weight.reshape(-1, 1) * suffixes.reshape(-1, SYMBOLS)[np.arange(len(weight)) % max(1, len(suffixes) // SYMBOLS)]).ravel()
        table[found["gram"].to_numpy()] = found["p"].to_numpy()
    return -np.log2(table).astype(np.float32)


#: Words that stand for the start and the end of a document, and the bits of an end and of any other word before it is spelled.
_BEGIN, _END = 0, 1
_END_BITS, _WORD_BITS = 6.0, float(-np.log2(1 - 2.0**-6))
_GAP = " " * (ORDER - 1)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOW = np.uint64(0xFFFFFFFF)
_ENTRIES = 1 << 18


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists for about a megabyte each."""
    data, at = (text or "").encode(), 0
    while at < len(data):
        cut = _BLANK.search(data, at + _BLOCK)
        end = cut.start() if cut else len(data)
        if words := data[at:end].split():
            yield words
        at = end


def word_hashes(words: list[bytes]) -> np.ndarray:
    """32 bits for each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))


def spelling_bits(words: list[bytes], spelling: np.ndarray) -> np.ndarray:
    """Bits of each word, and last of the end, under the spelling model alone; each word counts with the space after it."""
    line = FOLDING[np.frombuffer(_GAP.encode() + _GAP.encode().join(words) + b" ", np.uint8)].astype(np.int32)
    n = len(line) - ORDER + 1
    code = line[:n].copy()
    for k in range(1, ORDER):
        code = code * SYMBOLS + line[k : k + n]
    sums = np.concatenate([[0.0], np.cumsum(spelling[code], dtype=np.float64)])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + len(_GAP))])
    return np.append(sums[starts + sizes + 1] - sums[starts] + _WORD_BITS, _END_BITS)


def read_words(text: str | None, spelling: np.ndarray | None = None, known: _Sorted | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a text's words between those of start and end; spelling bits of all but the start; bytes of words. Empty without words.

    With ``known``, whose last column has spelling bits, only words that aren't there are spelled.
    """
    tokens, bits, size = [np.array([_BEGIN], np.uint32)], [], 0
    for words in word_blocks(text):
        tokens.append(word_hashes(words))
        size += sum(map(len, words))
        if known is not None:
            row, is_known = known.find(tokens[-1])
            of = known.columns[-1][row].astype(np.float64) if len(known.hashes) else np.zeros(len(words))
            new = np.flatnonzero(~is_known)
            if len(new):
                of[new] = spelling_bits([words[k] for k in new.tolist()], spelling)[:-1]
            bits.append(of)
        elif spelling is not None:
            bits.append(spelling_bits(words, spelling)[:-1])
    if len(tokens) == 1:
        return np.zeros(0, np.uint32), np.zeros(0), 0
    return np.concatenate([*tokens, np.array([_END], np.uint32)]), np.concatenate([*bits, [_END_BITS]]), size


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """A word and the next one, in 64 bits."""
    return tokens[:-1].astype(np.uint64) << np.uint64(32) | tokens[1:]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte of all, compressed."""
    import zstandard

    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def opened(data: bytes, n: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if n else b"", np.uint8).reshape(-1, max(1, n))[:, :n]
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def count_words(texts: DataFrame, least_share: float = 0.0, spelling: Broadcast | None = None) -> DataFrame:
    """word (its hash), n and, with a spelling model, its bits, over ``texts.text``; words under ``least_share`` of each stretch of a task may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in held])
            if spelling:
                words, at, n = np.unique(tokens, return_index=True, return_counts=True)
                bits = np.concatenate([b for _, b in held])[at]
            else:
                words, n = np.unique(tokens, return_counts=True)
                bits = np.zeros(len(words), np.float32)
            often = n >= least_share * size
            return pa.RecordBatch.from_arrays([pa.array(words[often].astype(np.int64)), pa.array(n[often]), pa.array(bits[often])], names=["word", "n", "bits"])

        for batch in batches:
            for x in batch.column(0):
                tokens, bits, _ = read_words(x.as_py(), spelling and spelling.value)
                if len(tokens):
                    held.append((tokens, np.concatenate([[0.0], bits]).astype(np.float32) if spelling else bits))
                    size += len(tokens)
                if size > 4 * _ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "word long, n long, bits float").groupBy("word").agg(F.sum("n").alias("n"), F.max("bits").alias("bits"))


class _Sorted:
    """Numbers looked up by 32-bit hashes."""

    def __init__(self, hashes: np.ndarray, *columns: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.columns = hashes[order].astype(np.uint32), [c[order] for c in columns]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the hashes, and whether they are there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def _shard_of(keys: np.ndarray, hot: _Sorted, shards: int) -> np.ndarray:
    """Pairs go by their first word; those of hot first words by both."""
    first = (keys >> np.uint64(32)).astype(np.uint32)
    mixed = first.astype(np.uint64) + np.where(hot.find(first)[1], keys & _LOW, np.uint64(0))
    mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def _by_shard(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of rows by shard, else as they are; and where each shard begins and ends in it."""
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()
    return order, [(int(shard[order[a]]), a, b) for a, b in zip(cuts, [*cuts[1:], len(shard)])]


def count_pairs(texts: DataFrame, spelling: Broadcast, words: Broadcast, hot: Broadcast, shards: int) -> DataFrame:
    """shard, n, keys, counts and spelled: each task's pairs of words of ``texts.text``, packed by shard."""
    names = ["shard", "n", "keys", "counts", "spelled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, at, n = np.unique(np.concatenate([k for k, _ in held]), return_index=True, return_counts=True)
            bits = np.concatenate([b for _, b in held])[at].astype(np.float16)
            return _packed_pairs(keys, n, bits, _shard_of(keys, hot.value, shards), words.value)

        for batch in batches:
            for x in batch.column(0):
                tokens, bits, _ = read_words(x.as_py(), spelling.value)
                if len(tokens):
                    held.append((pair_keys(tokens), bits))
                    size += len(bits)
                if size > _ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def _packed_pairs(keys, n, bits, shard, known) -> pa.RecordBatch:
        rows = []
        order, places = _by_shard(shard)
        keys, n, bits = keys[order], n[order], bits[order]
        cold = ~known.find((keys & _LOW).astype(np.uint32))[1]
        for s, a, b in places:
            rows.append((s, b - a, squeezed(_steps(keys[a:b])), squeezed(n[a:b]), squeezed(bits[a:b][cold[a:b]].view(np.uint16))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=names)

    return texts.select("text").mapInArrow(run, "shard int, n long, keys binary, counts binary, spelled binary")


def _unpacked(n: int, keys: bytes, counts: bytes, spelled: bytes, words: _Sorted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and spelling bits (of words that aren't in ``words``)."""
    keys = np.cumsum(opened(keys, n), dtype=np.uint64)
    cold = ~words.find((keys & _LOW).astype(np.uint32))[1]
    bits = np.zeros(n, np.float16)
    bits[cold] = opened(spelled, int(cold.sum())).astype(np.uint16).view(np.float16)
    return keys, opened(counts, n).astype(np.int64), bits


def merge_pairs(packed: DataFrame, words: Broadcast, hot: Broadcast) -> DataFrame:
    """The pairs of each shard counted once (kind 0), with what is to be added up over shards.

    Kind 1 has how many pairs were met once, twice, three and four times; kind 2 how many pairs end in a word; kind 3 a hot
    first word's pairs: their sum, and how many were met once, twice and more often.
    """
    names = ["kind", "id", "a", "b", "c", "d", "shard", "n", "keys", "counts", "spelled"]

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(*(c.as_py() for c in r), words.value) for r in zip(*(table[c] for c in ("n", "keys", "counts", "spelled")))]
        keys, n, bits = (np.concatenate([p[k] for p in parts]) for k in range(3))
        del parts
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n, bits = keys[at], np.add.reduceat(n[order], at), bits[order[at]]
        second = (keys & _LOW).astype(np.uint32)
        found, known = words.value.find(second)
        ends, end_n = np.unique(found[known], return_counts=True)
        first = (keys >> np.uint64(32)).astype(np.uint32)
        is_hot = hot.value.find(first)[1]
        hot_first, of = np.unique(first[is_hot], return_inverse=True)
        sums = [np.bincount(of, weights=w, minlength=len(hot_first)).astype(np.int64) for w in (n[is_hot], n[is_hot] == 1, n[is_hot] == 2, n[is_hot] > 2)]
        none = np.zeros(len(ends), np.int64)
        kinds = np.repeat([0, 1, 2, 3], [1, 1, len(ends), len(hot_first)])
        ids = np.concatenate([[0], [0], words.value.hashes[ends].astype(np.int64), hot_first.astype(np.int64)])
        columns = [np.concatenate([[0], [int((n == k + 1).sum())], end_n if not k else none, sums[k]]) for k in range(4)]
        blobs = [squeezed(_steps(keys)), squeezed(n), squeezed(bits[~known].view(np.uint16))]
        rest = len(kinds) - 1
        return pa.table(
            [pa.array(kinds, pa.int32()), pa.array(ids, pa.int64()), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(np.full(len(kinds), table["shard"][0].as_py(), np.int32)),
             pa.array([len(keys)] + [None] * rest, pa.int64()), *(pa.array([b] + [None] * rest, pa.binary()) for b in blobs)],
            names=names,
        )

    schema = "kind int, id long, a long, b long, c long, d long, shard int, n long, keys binary, counts binary, spelled binary"
    return packed.groupBy("shard").applyInArrow(run, schema)


def discounts_of(t: list[int]) -> list[float]:
    """Discounts from how many n-grams were met once, twice, three and four times."""
    if not all(t[:2]):
        return [0.5, 0.75, 0.75]
    y = t[0] / (t[0] + 2 * t[1])
    out = [k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.75 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out)]


class _Shard:
    """What a shard's pairs and first words add to a document's bits; hot: total and mass of first words whose pairs are in all shards."""

    def __init__(self, row: dict | None, words: _Sorted, hot: _Sorted, d: list[float], rest: float):
        row = row or {"n": 0, "keys": b"", "counts": b"", "spelled": b""}
        self.keys, self.n, spelled = _unpacked(row["n"], row["keys"], row["counts"], row["spelled"], words)
        cut = np.array([0.0, *d])[np.minimum(self.n, 3)]
        first = (self.keys >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero(np.diff(first.astype(np.int64), prepend=-1))
        total, mass = (np.add.reduceat(x, at) if len(at) else np.zeros(0) for x in (self.n.astype(np.float64), cut))
        row_of, is_hot = hot.find(first[at])
        total[is_hot], mass[is_hot] = (c[row_of[is_hot]] for c in hot.columns)
        size = np.diff(np.append(at, len(first)))
        found, known = words.find((self.keys & _LOW).astype(np.uint32))
        lower = np.where(known, words.columns[1][found], spelled.astype(np.float64) - np.log2(rest))
        back = np.repeat(mass / total, size)
        self.bits = np.log2(back) - lower - np.log2((self.n - cut) / np.repeat(total, size) + back * 2.0**-lower)
        cold = ~is_hot
        self.contexts = _Sorted(
            np.concatenate([first[at][cold], hot.hashes]),
            np.concatenate([total[cold], np.full(len(hot.hashes), np.inf)]),
            np.log2(np.concatenate([total[cold] / mass[cold], hot.columns[0] / hot.columns[1]])),
        )

    def sums(self, keys: np.ndarray, docs: np.ndarray, times: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Bits to add for each document; own: documents that the model was counted over."""
        out = np.zeros(len(keys))
        of_own = own[docs]
        first = (keys >> np.uint64(32)).astype(np.uint32)
        at, met = self.contexts.find(first)
        if of_own.any():
            mine = np.flatnonzero(of_own)
            _, group = np.unique(first[mine].astype(np.uint64) << np.uint64(32) | docs[mine].astype(np.uint64), return_inverse=True)
            met[mine] &= np.bincount(group, weights=times[mine])[group] < self.contexts.columns[0][at[mine]]
        out[met] += self.contexts.columns[1][at[met]]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            met &= (self.keys[at] == keys) & ((times < self.n[at]) | ~of_own)
            out[met] += self.bits[at[met]]
        return np.bincount(docs, weights=out * times, minlength=len(own))


def requests(docs: DataFrame, others: list[str], spelling: Broadcast, words: Broadcast, hot_names: Broadcast, hot: Broadcast, rest: float, shards: int) -> DataFrame:
    """What the shards are asked: the pairs of each block of a task's documents, packed by shard; and a row (n -1) that holds the block's documents."""
    names = ["shard", "block", "n", "keys", "docs", "times", "own"]
    own_at = others.index("is_trusted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            block = part << 32 | number
            keys, times = (np.concatenate(c) for c in zip(*held))
            doc = np.repeat(np.arange(len(held)), [len(k) for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            by_shard, places = _by_shard(_shard_of(keys, hot_names.value, shards))
            order = order[by_shard]
            keys, doc, times = keys[by_shard], doc[order], times[order]
            whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*others, *_OWN])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as writer:
                writer.write_batch(whole)
            own = struct.pack("<I", len(rows)) + np.packbits([bool(r[own_at]) for r in rows]).tobytes()
            out = [(block % shards, block, -1, sink.getvalue().to_pybytes(), None, None, own)]
            for s, a, b in places:
                out.append((s, block, b - a, squeezed(_steps(keys[a:b])), squeezed(doc[a:b]), squeezed(times[a:b]), own))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=names)

        for batch in batches:
            kinds = [*(batch.schema.field(c).type for c in others), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            for *values, text in zip(*(c.to_pylist() for c in batch.columns[: len(others)]), batch.column(len(others))):
                text = text.as_py()
                tokens, bits, spelled = read_words(text, spelling.value, words.value)
                total, keys = 0.0, pair_keys(tokens)
                if len(tokens):
                    found, met = words.value.find(tokens[1:])
                    if values[own_at]:  # what no other trusted text has counts as unmet
                        _, of, n = np.unique(tokens[1:], return_inverse=True, return_counts=True)
                        met &= n[of] < words.value.columns[0][found]
                        _, of, n = np.unique(tokens[:-1], return_inverse=True, return_counts=True)
                        row, is_hot = hot.value.find(tokens[:-1])
                        keys = keys[~is_hot | (n[of] < hot.value.columns[0][row])]
                    total = float(np.where(met, words.value.columns[1][found], bits - np.log2(rest)).sum())
                rows.append((*values, len((text or "").encode()), spelled + max(0, len(tokens) - 2), total, len(tokens) > 0))
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size > _ENTRIES or len(rows) >= 1 << 15:
                    yield flush()
                    number, size, rows, held = number + 1, 0, [], []
        if rows:
            yield flush()

    return docs.select(*others, "text").mapInArrow(run, "shard int, block long, n long, keys binary, docs binary, times binary, own binary")


_OWN = ["n_bytes", "spelled_bytes", "own_bits", "has_words"]


def answers(asked: DataFrame, pairs: DataFrame, words: Broadcast, hot: Broadcast, d: list[float], rest: float) -> DataFrame:
    """block with sums (of each of its documents) of a shard, or with rows (its documents)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = right.select(["n", "keys", "counts", "spelled"]).to_pylist()
        shard = _Shard(model[0] if model else None, words.value, hot.value, d, rest)
        sums: list[bytes | None] = []
        for r in (r for b in left.to_batches(max_chunksize=16) for r in b.to_pylist()):
            if r["n"] < 0:
                sums.append(None)
                continue
            n = r["n"]
            (docs,), bits = struct.unpack("<I", r["own"][:4]), np.frombuffer(r["own"], np.uint8, offset=4)
            own = np.unpackbits(bits, count=docs).astype(bool)
            keys = np.cumsum(opened(r["keys"], n), dtype=np.uint64)
            found = shard.sums(keys, opened(r["docs"], n).astype(np.int64), opened(r["times"], n).astype(np.int64), own)
            sums.append(squeezed(found.astype("<f4").view(np.uint32)))
        rows = pc.if_else(pc.less(left["n"], 0), left["keys"], pa.scalar(None, pa.binary()))
        return pa.table([left["block"], pa.array(sums, pa.binary()), rows], names=["block", "sums", "rows"])

    return asked.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInArrow(run, "block long, sums binary, rows binary")


def score(docs: DataFrame, trusted: DataFrame, hot_share: float = 1e-4, word_share: float = 5e-7, shard_bytes: int = 4 << 20, parts: int = 3) -> DataFrame:
    """All columns but text, with n_bytes, perplexity (null where there is none) and has_words, under the model of ``trusted.text``.

    The perplexity is by byte of words and the spaces after them. Rows whose column ``is_trusted`` is true are part of the
    model, so words and pairs that no other trusted text has count as unmet for them.
    """
    spark = docs.sparkSession
    docs = docs if "is_trusted" in docs.columns else docs.withColumn("is_trusted", F.lit(False))
    spaced = F.regexp_replace("text", SPACES, _GAP)
    spelling = train(trusted.select(F.concat(F.lit(_GAP), spaced, F.lit(_GAP)).alias("text")))
    others = [c for c in docs.columns if c != "text"]
    if spelling is None:
        return docs.select(*others, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), _has_words().alias("has_words"))
    size = F.sum(F.octet_length("text"))
    shards = max(1, -(-(trusted.agg(size).first()[0] or 0) // shard_bytes), -(-(docs.agg(size).first()[0] or 0) // (4 * shard_bytes)))
    held_spelling = spark.sparkContext.broadcast(spelling)
    counted = written(count_words(trusted, spelling=held_spelling), "trusted-words")
    total = counted.agg(F.sum("n")).first()[0]
    often = written(count_words(docs, hot_share), "document-words")
    asked_total = often.agg(F.sum("n")).first()[0] or 0
    # At most 1 / word_share words and some 2 / hot_share first words, at any size of corpus.
    kept = counted.where((F.col("n") >= word_share * total) | F.col("word").isin(_BEGIN, _END)).toArrow()
    first = counted.where(F.col("n") >= hot_share * total).select("word").union(often.where(F.col("n") >= hot_share * asked_total).select("word")).distinct().toArrow()
    share = spark.sparkContext.broadcast
    names = share(_Sorted(kept["word"].to_numpy()))
    hot_names = share(_Sorted(first["word"].to_numpy()))

    packed = count_pairs(trusted, held_spelling, names, hot_names, shards)
    merged = written(merge_pairs(packed, names, hot_names), "word-pairs")
    few = merged.where("kind in (1, 3)").groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()
    d = discounts_of(next([r.a, r.b, r.c, r.d] for r in few if r.kind == 1))
    hot = _Sorted(*(np.array(c, np.float64) for c in zip(*[(r.id, r.a, d[0] * r.b + d[1] * r.c + d[2] * r.d) for r in few if r.kind == 3] or [()] * 3)) if any(r.kind == 3 for r in few) else (np.zeros(0),) * 3)
    ends = merged.where("kind = 2").groupBy("id").agg(F.sum("a").alias("n")).toArrow()
    n = ends["n"].to_numpy()
    d1 = discounts_of([int((n == k).sum()) for k in (1, 2, 3, 4)])
    own = (n - np.array([0.0, *d1])[np.minimum(n, 3)]) / merged.where("kind = 0").agg(F.sum("n")).first()[0]
    rest = float(1 - own.sum())
    known = _Sorted(kept["word"].to_numpy(), kept["n"].to_numpy(), kept["bits"].to_numpy())
    at, _ = known.find(ends["id"].to_numpy().astype(np.uint32))
    spelled = known.columns[1][at]
    words = _Sorted(ends["id"].to_numpy(), known.columns[0][at], -np.log2(own + rest * 2.0 ** -spelled.astype(np.float64)), spelled)
    words, hot = share(words), share(hot)

    def together(table: pa.Table) -> pa.Table:
        rows, held = None, []
        for sums, own in zip(table["sums"], table["rows"]):
            if own.is_valid:
                rows = pa.ipc.open_stream(own.as_buffer()).read_all()
            else:
                held.append(sums.as_py())
        total = sum((opened(x, rows.num_rows).astype(np.uint32).view(np.float32).astype(np.float64) for x in held), np.zeros(rows.num_rows))
        bits = (rows["own_bits"].to_numpy() + total) / np.maximum(rows["spelled_bytes"].to_numpy(), 1)
        perplexity = pa.array(2.0**bits, mask=~rows["has_words"].to_numpy())
        return rows.select([*others, "n_bytes"]).append_column("perplexity", perplexity).append_column("has_words", rows["has_words"])

    schema = docs.select(*others).schema.add("n_bytes", "long").add("perplexity", "double").add("has_words", "boolean")
    dealt = F.pmod(F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(parts))
    scored = []
    for part in range(parts):
        asked = requests(docs.where(dealt == part), others, held_spelling, words, hot_names, hot, rest, shards)
        found = answers(asked, merged.where("kind = 0"), words, hot, d, rest)
        scored.append(written(found.groupBy("block").applyInArrow(together, schema), "scored"))
    return reduce(DataFrame.union, scored)


def _has_words() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def _fitted(scored: DataFrame) -> DataFrame:
    """Rows that have a perplexity, with bits (its logarithm), short (1 / sqrt(bytes)) and lang."""
    return scored.where("perplexity is not null").select("lang", F.log2("perplexity").alias("bits"), (1 / F.sqrt("n_bytes")).alias("short"))


def limits(trusted: DataFrame, quantile: float, least_documents: int) -> tuple[DataFrame, tuple, Column]:
    """(limit_lang, level, steps) of languages, level and steps of all trusted documents (nulls without any), and the limit over columns level, steps and n_bytes."""
    rows = _fitted(trusted)
    slope, n = rows.agg(F.regr_slope("bits", "short"), F.count("*")).first()
    level = F.avg(F.col("bits") - F.lit(slope or 0.0) * F.col("short")).alias("level")
    levels = rows.groupBy(F.col("lang").alias("limit_lang")).agg(level, F.count("*").alias("n")).where(F.col("n") >= least_documents).drop("n")
    levels = written(levels, "perplexity-levels")
    overall = rows.agg(level).first()[0]
    rest = F.col("bits") - F.lit(slope or 0.0) * F.col("short") - F.coalesce("level", F.lit(overall).cast("double"))
    rows = rows.join(levels, F.col("lang").eqNullSafe(F.col("limit_lang")), "left").withColumn("rest", rest)
    square, short = F.pow("rest", F.lit(2)), F.pow("short", F.lit(2))
    steep, base, mean, mean_short = rows.agg(F.regr_slope(square, short), F.regr_intercept(square, short), F.avg(square), F.avg(short)).first()
    if not n:
        return levels.withColumn("steps", F.lit(0.0)), (None, None), F.lit(None).cast("double")
    if steep is None or steep < 0:
        steep, base = 0.0, mean
    elif base < 0:
        steep, base = mean / mean_short, 0.0
    spread = lambda short: F.sqrt(F.greatest(F.lit(1e-12), F.lit(base) + F.lit(steep) * short))
    steps = lambda rest: F.percentile_approx(rest / spread(short), quantile, 10000).alias("steps")
    by_lang = rows.where("level is not null").groupBy("limit_lang", "level").agg(steps(F.col("rest")))
    every = rows.agg(steps(F.col("bits") - F.lit(slope or 0.0) * F.col("short") - F.lit(overall))).first()[0]
    at = F.col("level") + F.lit(slope or 0.0) / F.sqrt("n_bytes") + F.col("steps") * spread(1 / F.col("n_bytes"))
    return by_lang, (overall, every), F.pow(F.lit(2.0), at)


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.25, least_documents: int = 20, broadcast_ids: int = 5_000_000
) -> DataFrame:
    """doc_id, lang, text_hash, n_bytes, perplexity, limit and kept of every document.

    Trusted are the documents that ``labels`` gives quality 1. Their ids are broadcast up to ``broadcast_ids``.
    """
    ids = labels.where("quality = 1").select(F.col("doc_id").alias("trusted_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    rows = rows.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), F.col("trusted_id").isNotNull().alias("is_trusted"), "text")
    with small_batches(docs.sparkSession), brief_shuffles(docs.sparkSession):
        scored = written(score(rows, rows.where("is_trusted")), "perplexities")
    trusted = scored.where("is_trusted")
    by_lang, (level, steps), limit = limits(trusted, quantile, least_documents)
    by_lang = written(by_lang, "perplexity-limits")
    hint = F.broadcast if by_lang.count() <= 100_000 else (lambda df: df)
    df = scored.join(hint(by_lang), F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
    df = df.withColumns({"steps": F.when(F.col("level").isNull(), F.lit(steps).cast("double")).otherwise(F.col("steps")), "level": F.coalesce("level", F.lit(level).cast("double"))})
    limit = F.when(F.col("has_words"), margin * limit)
    kept = F.when(~F.col("has_words"), F.lit(False)).otherwise(F.coalesce(F.col("perplexity") <= limit, F.lit(True)))
    return df.select("doc_id", "lang", "text_hash", "n_bytes", "perplexity", limit.alias("limit"), kept.alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, all columns."""
    of_id, of_hash = free_names(docs, "bad_id", "bad_hash")
    bad = classify(docs, labels, **options).where(~F.col("kept")).select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(of_hash)), "left_anti")
