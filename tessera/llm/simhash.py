"""Near duplicates by SimHash with pigeonring candidate filtering.

A fingerprint is cut into 8 segments of 8 bits in a ring. If two fingerprints differ in at most 3 bits, then from
some segment on, the first l segments together differ in at most floor(3 l / 8) bits, for every l: segments 1 and 2
are equal, 3 to 5 differ in one bit at most, 6 and 7 bring that to two at most. So one of 8 * 3 keys, a start and the
one segment of 3 to 5 to leave out, agrees in 32 bits. Fingerprints meet by key; within a key the chain of 7 segments
is tested before the whole distance. Nothing is capped: keys with more than ``bucket_limit`` fingerprints are dealt
anew by all 560 ways to leave out 3 of 16 half-bytes, where a key has 2**12 fingerprints at most.

Copies meet first: all work is on distinct fingerprints, and within a key only a spanning forest of links leaves the
task. Components come from large-star and small-star steps on those links.

Edge cases: a null or blank text has fingerprint 0, linked like any other; repeated rows each get their row; a null
doc_id is never a component_id unless the whole component lacks ids. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, small_batches, written

BITS, SEGMENTS, DISTANCE = 64, 8, 3
_WIDTH = BITS // SEGMENTS
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(segments, width: int = _WIDTH) -> int:
    return sum(((1 << width) - 1) << (width * s) for s in segments)


def ring_masks() -> list[tuple[int, int]]:
    """(start, mask) of the 24 keys: two equal segments, and two of the next three."""
    out = []
    for start in range(SEGMENTS):
        ring = [(start + k) % SEGMENTS for k in range(SEGMENTS)]
        out += [(start, _mask(s for s in ring[:5] if s != left)) for left in ring[2:5]]
    return out


def fine_masks() -> list[int]:
    """Masks that leave out 3 of 16 half-bytes."""
    return [_mask(set(range(16)) - set(left), 4) for left in combinations(range(16), DISTANCE)]


def simhash(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of XXH64 (seed 42) over word shingles, repeats included; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return _signed(int.from_bytes(digest(joined, 42), "big"))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    ends = ends[shingle - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        block = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([simhash(x.as_py(), shingle) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _spanning(fps: np.ndarray, chain: int | None) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the fingerprints at DISTANCE or less; chain: mask of the first 7 segments."""
    left, found = fps, ([], [])
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        here = queue.pop()
        differ = left ^ here
        near = np.ones(len(left), bool) if chain is None else np.bitwise_count(differ & np.uint64(chain)) <= DISTANCE * (SEGMENTS - 1) // SEGMENTS
        near[near] = np.bitwise_count(differ[near]) <= DISTANCE
        if near.any():
            new = left[near]
            found[0].extend([_signed(int(here))] * len(new))
            found[1].extend(new.astype(np.int64).tolist())
            queue.extend(new)
            left = left[~near]
    return found


def _bucket_links(members: DataFrame) -> DataFrame:
    """Links within rows of (start, fps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for start, fps in zip(batch.column(0).to_pylist(), batch.column(1)):
                chain = None if start is None else _mask((start + k) % SEGMENTS for k in range(SEGMENTS - 1))
                values = fps.values.to_numpy(zero_copy_only=False).view(np.uint64)
                x, y = _spanning(np.sort(values), chain)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _dealt(fps: DataFrame, masks: list[tuple[int | None, int]]) -> DataFrame:
    """A row (fp, start, key_no, key) for each mask."""
    keys = [F.struct(F.lit(s).cast("int").alias("start"), F.lit(k).alias("key_no"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (s, m) in enumerate(masks)]
    return fps.select("fp", F.inline(F.array(*keys)))


def links(fps: DataFrame, bucket_limit: int = 4096) -> DataFrame:
    """Links (a, b) that connect just the distinct fingerprints ``fps.fp`` at DISTANCE or less."""
    dealt = _dealt(fps, ring_masks())
    shared = dealt.groupBy("key_no", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(dealt.join(shared, ["key_no", "key"]).select("fp", "start", "key_no", "key", "n"), "simhash-keys")
    small = members.where(F.col("n") <= bucket_limit).groupBy("key_no", "key").agg(F.min("start").alias("start"), F.collect_list("fp").alias("fps"))
    found = _bucket_links(small.select("start", "fps"))
    crowded = members.where(F.col("n") > bucket_limit)
    if crowded.head(1):
        anew = _dealt(crowded.select("fp").distinct(), [(None, m) for m in fine_masks()])
        anew = anew.groupBy("key_no", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found = found.union(_bucket_links(anew.select(F.lit(None).cast("int").alias("start"), "fps")))
    return found.distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the component's smallest node."""

    def state(e: DataFrame):
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    def star(e: DataFrame, keep: Column) -> DataFrame:
        """Every neighbour v of u that ``keep`` names is linked to the smallest of u and its neighbours."""
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return e.join(least, "u").where(keep & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        if (seen := state(now)) == before:
            break
        before = seen
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, F.col("v") > F.col("u")).union(_least_self(both)).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(down, F.lit(True)).union(_least_self(down)).distinct()
        now = written(small, "links")
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _least_self(e: DataFrame) -> DataFrame:
    """Each u linked to its smallest neighbour, where that is smaller."""
    return e.groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    by_doc = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(fps.select("fp"), bucket_limit))
    rooted = fps.join(found, fps.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return by_doc.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near duplicates by similarity: shingles of five words, a Jaccard similarity of 0.8 or more.
#: The fewest and most bits of a sketch; up to how many nodes all pairs of a set that may link are candidates, and up to how many they are looked at at once.
LEAST_BITS, MOST_BITS, FEW, AT_ONCE = 512, 1 << 16, 8, 512
#: Keys that more nodes share come last in the order of shingles. Where that would be over a million keys, the bound is higher.
_OFTEN = 256
_BROADCAST_ROWS = 100_000


def shingle_hashes(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """The words joined by spaces, A-Z in lower case, and the distinct hashes of their shingles (of all words, if they are fewer)."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = [0, *(ends[:-size] + 1).tolist()]
    found = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))
    return joined, np.unique(found)


def sketch(hashes: np.ndarray) -> bytes:
    """Of each class of hashes, about as many as there are hashes, whether their number is odd.

    Two sets' sketches of one size differ in no more bits than the sets in elements; ``_folded`` makes them one size.
    """
    bits = min(max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()), MOST_BITS) if len(hashes) else LEAST_BITS
    counts = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(raw: bytes, width: int) -> np.ndarray:
    """The sketch that has ``width`` bytes: classes are joined by twos."""
    bits = np.frombuffer(raw, np.uint64)
    while 8 * len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def prefix_length(size: int, similarity: float) -> int:
    """How many elements, the first in any order of all elements, sets of this size must be met by."""
    return size - int(np.ceil(similarity * size - 1e-9)) + 1 if size else 0


class _Sets:
    """Sizes and sketches of nodes; which pairs of them can be similar."""

    def __init__(self, sizes: np.ndarray, raw: list[bytes], similarity: float) -> None:
        self.sizes, self.similarity, self.tables = sizes, similarity, {}
        self.widths = np.fromiter(map(len, raw), np.int64, len(raw))
        for width in np.unique(self.widths).tolist():  # sizes that may link have widths that differ by 2 at most
            own = np.flatnonzero((self.widths == width) | (self.widths == 2 * width))
            at = np.zeros(len(raw), np.int64)
            at[own] = np.arange(len(own))
            self.tables[width] = at, np.stack([_folded(raw[k], width) for k in own])

    def may_link(self, i: np.ndarray, j: np.ndarray, share: float = 1.0) -> np.ndarray:
        """Which of the pairs (i, j) sizes and sketches don't rule out; share: of the elements that may differ."""
        one, two = self.sizes[i], self.sizes[j]
        most = share * (1 - self.similarity) / (1 + self.similarity) * (one + two) + 1e-6
        good = np.minimum(one, two) >= self.similarity * np.maximum(one, two) - 1e-6
        left = np.flatnonzero(good)
        widths = np.minimum(self.widths[i[left]], self.widths[j[left]])
        for width in np.unique(widths).tolist():
            at, bits = self.tables[width]
            own, step = left[widths == width], max(1, (1 << 22) // width)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                good[some] = np.bitwise_count(bits[at[i[some]]] ^ bits[at[j[some]]]).sum(axis=1) <= most[some]
        return good


def _forest(names: np.ndarray, sets: _Sets) -> set[tuple[int, int]]:
    """Links of spanning forests over the pairs that may link, and over those that differ less."""
    out: set[tuple[int, int]] = set()
    those = np.arange(len(names))
    if len(names) <= AT_ONCE:  # most have none to link to
        i, j = np.triu_indices(len(names), 1)
        good = sets.may_link(i, j)
        those = np.union1d(i[good], j[good])
    for share in (1.0, 0.5, 0.25):
        left, queue = those, []
        while len(left):
            if not queue:
                queue, left = [left[0]], left[1:]
            here = queue.pop()
            near = sets.may_link(np.full(len(left), here), left, share)
            out.update((int(names[here]), int(x)) for x in names[left[near]])
            queue.extend(left[near])
            left = left[~near]
    return {(min(x), max(x)) for x in out}


def _members(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Where each row of structs starts, and ends the last; nodes, sizes, sketches and whatever else the structs have, by row and node."""
    of, ends = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    names = of.field("node").to_numpy()
    order = np.lexsort((names, np.repeat(np.arange(len(column)), np.diff(ends))))
    more = [of.field(f.name).to_numpy()[order] for f in of.type if f.name not in ("node", "size", "sketch")]
    return ends, names[order], of.field("size").to_numpy()[order], of.field("sketch").take(pa.array(order)).to_pylist(), *more


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bucket_limit: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) of all documents, and verified links (a, b) that connect just the nodes of that Jaccard similarity.

    A node is a sequence of words, so copies are one. No link is missed: in any one order of all shingles, two such sets share
    one of their first ``prefix_length``. The order goes by hash, with shingles that many nodes have last. Nodes that share a
    key of these meet; of a key with more than ``bucket_limit`` nodes, two blocks of nodes at a time. What sizes and sketches
    don't rule out is compared by shingles: all pairs of a set of FEW nodes; of larger ones first spanning forests, then all pairs that
    the links found leave unconnected.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, bits, pools = [], [], [], []
            for x in batch.column(2):
                joined, hashes = shingle_hashes(x.as_py(), shingle)
                nodes.append(_signed(xxhash.xxh3_64_intdigest(joined)))
                sizes.append(len(hashes))
                bits.append(sketch(hashes))
                first = prefix_length(len(hashes), similarity)
                pools.append(hashes[: first + first // 2 + 4].view(np.int64))
            columns = [*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(pools, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "sketch", "pool"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    by_doc = written(rows.mapInArrow(prints, "doc_id long, text_hash long, node long, size long, sketch binary, pool array<long>"), "shingles-first")
    one = by_doc.groupBy("node").agg(F.first(F.struct("size", "sketch", "pool")).alias("of"), F.min(F.struct("doc_id", "text_hash")).alias("at"))
    nodes = written(one.select("node", "of.*", "at"), "distinct-texts")

    def shingled(wanted: DataFrame) -> DataFrame:
        """(node, size, pool) with all of the shingles of the nodes ``wanted``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_hashes(x.as_py(), shingle)[1].view(np.int64) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "pool"])

        there = nodes.select("node", "at").join(wanted, "node")
        if wanted.count() <= _BROADCAST_ROWS:  # texts then don't move
            there = F.broadcast(there)
        texts = rows.join(there, F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("text_hash") == F.col("at.text_hash"))).groupBy("node").agg(F.first("text").alias("text"))
        return texts.mapInArrow(run, "node long, size long, pool array<long>")

    n_keys = nodes.agg(F.sum(F.size("pool"))).first()[0] or 0
    counts = nodes.select(F.explode("pool").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") > max(min(_OFTEN, bucket_limit), n_keys >> 20)).select("key").collect()
    frequent = np.sort(np.array([r.key for r in often], np.int64))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, of = [], []
            for node, size, pool in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = pool.values.to_numpy()
                late = frequent[np.searchsorted(frequent, own).clip(max=len(frequent) - 1)] == own if len(frequent) else np.zeros(len(own), bool)
                first = prefix_length(size, similarity)
                if len(own) < size and len(own) - np.count_nonzero(late) < first:
                    keys.append(pa.nulls(1, pa.int64()))
                else:
                    keys.append(pa.array(np.concatenate([own[~late], own[late]])[:first]))
                of.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), pa.concat_arrays(keys)], names=["node", "key"])

    dealt = written(nodes.select("node", "size", "pool").mapInArrow(prefixes, "node long, key long"), "shingle-keys")
    # The first shingles of these were too few: all of them are looked at.
    more = written(shingled(dealt.where("key IS NULL").select("node")).mapInArrow(prefixes, "node long, key long"), "shingle-keys-more")
    dealt = dealt.where("key IS NOT NULL").union(more)
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(dealt.join(shared, "key"), "similarity-keys")
    listed = F.sort_array(F.collect_list("node")).alias("nodes")
    sets = members.where(F.col("n") <= bucket_limit).groupBy("key").agg(listed).select("nodes")
    blocks = F.ceil(2 * F.col("n") / bucket_limit)
    two = members.where(F.col("n") > bucket_limit).withColumn("one", F.pmod(F.xxhash64("node"), blocks))
    two = two.select("key", "node", "one", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("two")).where("one <> two")
    crowded = two.groupBy("key", F.least("one", "two").alias("low"), F.greatest("one", "two").alias("high")).agg(listed).select("nodes")
    sets = sets.union(crowded).where(F.size("nodes") > 1).distinct()  # nodes of one group share many keys
    sets = sets.select(F.xxhash64("nodes").alias("key"), F.size("nodes").alias("n"), F.explode("nodes").alias("node"))
    sets = written(sets.join(nodes.select("node", "size", "sketch"), "node"), "similarity-sets")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, names, sizes, raw = _members(batch.column(0))
            few = [a + np.array(np.triu_indices(b - a, 1)) for a, b in zip(ends, ends[1:]) if b - a <= FEW]
            i, j = np.concatenate(few, axis=1) if few else np.zeros((2, 0), np.int64)
            good = _Sets(sizes, raw, similarity).may_link(i, j)
            found = set(zip(names[i[good]].tolist(), names[j[good]].tolist()))
            for a, b in zip(ends, ends[1:]):
                if b - a > FEW:
                    found |= _forest(names[a:b], _Sets(sizes[a:b], raw[a:b], similarity))
            yield _pairs(list(found))

    def unconnected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            ends, names, sizes, raw, roots = _members(batch.column(0))
            for a, b in zip(ends, ends[1:]):
                sets, own, step = _Sets(sizes[a:b], raw[a:b], similarity), roots[a:b], max(1, AT_ONCE**2 // (b - a))
                for k in range(0, b - a, step):
                    i, j = np.nonzero(own[k : k + step, None] != own[None, :])
                    i, j = i[i + k < j] + k, j[i + k < j]
                    good = sets.may_link(i, j)
                    found += zip(names[a + i[good]].tolist(), names[a + j[good]].tolist())
                    if len(found) > 1 << 16:
                        yield _pairs(found)
                        found = []
            yield _pairs(found)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, other = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(one, other, assume_unique=True))
                good.append(both >= similarity * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    def checked(found: DataFrame, name: str) -> DataFrame:
        wanted = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        whole = written(shingled(wanted).select("node", "pool"), f"{name}-shingles")
        pairs = found.join(whole.select(F.col("node").alias("b"), F.col("pool").alias("two")), "b").join(whole.select(F.col("node").alias("a"), F.col("pool").alias("one")), "a")
        return written(pairs.select("a", "b", "one", "two").mapInArrow(verified, "a long, b long"), f"{name}-links")

    collected = F.collect_list(F.struct("node", "size", "sketch")).alias("members")
    near = written(sets.groupBy("key").agg(collected).select("members").mapInArrow(forests, "a long, b long").distinct(), "similar-near")
    links = checked(near, "similar-near")
    rooted = sets.where(F.col("n") > FEW).join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    collected = F.collect_list(F.struct("node", "size", "sketch", "root")).alias("members")
    rest = rooted.groupBy("key").agg(collected, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rest = written(rest.select("members").mapInArrow(unconnected, "a long, b long").distinct().join(near, ["a", "b"], "left_anti"), "similar-rest")
    return by_doc.select("doc_id", "text_hash", "node"), links.union(checked(rest, "similar-rest"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bucket_limit: int = 4096) -> DataFrame:
    """The document of smallest doc_id of each group that ``similar`` links connect; rows equal in doc_id and text count once.

    Texts without words are one group.
    """
    with small_batches(docs.sparkSession):
        by_doc, links = similar(docs, shingle, similarity, bucket_limit)
    rooted = by_doc.join(components(links), "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("at"))
    of_id, of_hash = free_names(docs, "kept_id", "kept_hash")
    kept = first.select(F.col("at.doc_id").alias(of_id), F.col("at.text_hash").alias(of_hash))
    on = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(of_hash))
    return docs.join(kept, on, "left_semi").dropDuplicates(["doc_id", "text"])
