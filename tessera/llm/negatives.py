"""Hard negatives by distributed radix selection.

Vectors become whole numbers; a score is an inner product of those, and thus an integer. What is looked for in a window
(an anchor's rows of its own label, or its rows of other labels whose scores lie between a share of a positive's score and
that score) are the first k by score, then by id. No scores are kept and none are sorted: a pass over all rows counts the
scores of each window by their highest digit; the digit at which the kth one stands is the window's bucket, whose next digit
is counted in the next pass, and so on, until the bucket holds few rows. Scores that too many rows share are told apart by the
digits of the ids. Then one pass gathers the rows up to each window's bucket, of each block k at most.

Rows are dealt into blocks once; in a pass each block meets all anchors, which are sent to it (a hundredth of the rows, many
rows of a block each time), so neither side is held whole by anybody. A block has up to ``BLOCK_BYTES`` of numbers.

Edge cases: rows with a null id, a null label, a null vector or a component that is null or not finite (as it is, or times
the scale) take no part. Of anchors that are repeated, the one of the smallest label, then vector, is taken; other repeated rows
are rows of their own, of which any comes first. Vectors of unlike lengths are compared as if the shorter one ended with
zeros; empty ones have score 0. Scores stay within 2**62. Fewer than k rows: all. An empty table, or one
without anchors, gives no rows. Other columns are left out at the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

DIGIT_BITS = 8
#: A bucket of so many rows or fewer isn't looked into any more.
GATHERED = 64
BLOCK_BYTES = 32 << 20
_SCORES = 4 << 20
_MOST = (1 << 62) - 1
_WINDOW = "window int, same boolean, high long, low long, need int, base long, shift int, tie_base long, tie_shift int, open boolean"
_COUNTS = "anchor_id long, window int, digit int, n long"
_FOUND = "anchor_id long, window int, score long, id long"


def whole_vectors(vectors: DataFrame, anchor: Column, scale: int = 256) -> DataFrame:
    """(id, label, vector, anchor, block): rows that take part, components times ``scale`` rounded down; written once."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double") * float(scale)).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    # floor() of a double is a long, which large components exceed; those are whole as they are
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return written(rows.withColumn("vector", whole).withColumn("place", F.monotonically_increasing_id()), "vectors")


def _bits(c: Column) -> Column:
    """Bits of a number from 0 on."""
    return F.when(c > 0, F.length(F.bin(c))).otherwise(0)


class _Rows:
    """A block's rows."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = np.asarray(table["id"])
        self.labels = np.asarray(table["label"])
        self.vectors = _matrix(table["vector"].combine_chunks())
        self.most = float(np.abs(self.vectors).max(initial=0))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors by rows."""
        d = max(1, min(anchors.shape[1], self.vectors.shape[1]))
        a, b = anchors[:, :d], self.vectors[:, :d]
        bound = d * self.most * float(np.abs(a).max(initial=0))
        if bound < 2.0**53:
            return (a @ b.T).astype(np.int64)
        if bound < 2.0**62 and self.most < 2.0**62 and np.abs(a).max() < 2.0**62:
            return a.astype(np.int64) @ b.astype(np.int64).T
        wide = [[int(x) for x in r] for r in b]
        out = [[max(-_MOST, min(_MOST, sum(x * y for x, y in zip(r, w)))) for w in wide] for r in ([int(x) for x in r] for r in a)]
        return np.array(out, np.int64).reshape(len(a), len(b))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    sizes = np.asarray(lists.value_lengths(), np.int64)
    width = int(sizes.max(initial=0))
    flat = np.asarray(lists.flatten())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _candidates(rows: _Rows, scores: np.ndarray, anchor_id: int, label: int, windows: list[dict]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(window, distance of the score from its high end, ids) of the rows in each window."""
    same = windows[0]["same"]
    fit = (rows.labels == label) == same
    fit &= (scores <= max(w["high"] for w in windows)) & (scores >= min(w["low"] for w in windows)) & (rows.ids != anchor_id)
    at = np.flatnonzero(fit)
    own, ids = scores[at], rows.ids[at]
    for w in windows:
        inside = (own <= w["high"]) & (own >= w["low"])
        yield w, w["high"] - own[inside], ids[inside]


def _next_shift(shift: int) -> int:
    return max(0, shift - DIGIT_BITS)


def _counts(rows: _Rows, scores, anchor_id, label, windows, least_id: int):
    for w, far, ids in _candidates(rows, scores, anchor_id, label, windows):
        if w["tie_shift"] is None:
            digits = (far - w["base"]) >> _next_shift(w["shift"])
            digits = digits[(far >= w["base"]) & (far - w["base"] < 1 << w["shift"])] if w["shift"] < 63 else digits[far >= w["base"]]
        else:
            tied = ids[far == w["base"]].astype(np.uint64) - np.uint64(least_id % (1 << 64))  # differences of ids, from 0 on
            inside = (tied >> np.uint64(w["tie_shift"])) == np.uint64((w["tie_base"] % (1 << 64)) >> w["tie_shift"]) if w["tie_shift"] < 64 else np.ones(len(tied), bool)
            digits = (tied[inside] >> np.uint64(_next_shift(w["tie_shift"]))) & np.uint64((1 << (w["tie_shift"] - _next_shift(w["tie_shift"]))) - 1)
        n = np.bincount(digits.astype(np.int64))
        for digit in np.flatnonzero(n).tolist():
            yield anchor_id, w["window"], digit, int(n[digit])


def _firsts(rows: _Rows, scores, anchor_id, label, windows, least_id: int, k: int):
    for w, far, ids in _candidates(rows, scores, anchor_id, label, windows):
        if w["tie_shift"] is None:
            fit = far - w["base"] < 1 << w["shift"] if w["shift"] < 63 else np.ones(len(far), bool)
        else:
            tied = ids.astype(np.uint64) - np.uint64(least_id % (1 << 64))
            last = (w["tie_base"] % (1 << 64)) + (1 << w["tie_shift"]) - 1
            fit = (far < w["base"]) | ((far == w["base"]) & (tied <= np.uint64(min(last, (1 << 64) - 1))))
        far, ids = far[fit], ids[fit]
        if len(ids) > k:
            first = np.lexsort((ids, far))[:k]
            far, ids = far[first], ids[first]
        for f, i in zip(far.tolist(), ids.tolist()):
            yield anchor_id, w["window"], w["high"] - f, i


def _passed(rows: DataFrame, windows: DataFrame, blocks: int, schema: str, per_anchor, *args) -> DataFrame:
    """All windows over all rows, by blocks. ``per_anchor`` gives tuples of ``schema``."""
    deal = (F.col("place") % blocks).cast("int")  # places are in a written table
    ours = rows.select(deal.alias("block"), F.lit(0).alias("kind"), "id", "label", "vector", F.lit(None).cast(f"array<struct<{_WINDOW.replace(' ', ':').replace(',:', ',')}>>").alias("windows"))
    named = windows.groupBy("anchor_id").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.collect_list(F.struct(*_names(_WINDOW))).alias("windows"))
    sent = named.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("anchor_id").alias("id"), "label", "vector", "windows")
    names = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block: _Rows | None = None
        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            n = int(np.searchsorted(kinds, 1))
            if n:
                held.append(batch.slice(0, n))
            if not held:
                continue
            if n < len(kinds) and block is None:
                block = _Rows(held)
                held = held[:1]
            step = max(1, _SCORES // len(block.ids)) if block else 1
            for at in range(n, len(kinds), step):
                some = batch.slice(at, step)
                scores = block.scores(_matrix(some.column("vector")))
                heads = zip(some.column("id").to_pylist(), some.column("label").to_pylist(), some.column("windows").to_pylist())
                out = [x for k, (i, label, own) in enumerate(heads) for x in per_anchor(block, scores[k], i, label, own, *args)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if x in ("window", "digit") else pa.int64()) for x, c in zip(names, zip(*out))], names=names)

    return ours.unionByName(sent).repartitionById(blocks, F.col("block")).sortWithinPartitions("kind").mapInArrow(run, schema)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def first_rows(rows: DataFrame, windows: DataFrame, k: int, blocks: int, least_id: int, id_bits: int) -> DataFrame:
    """(anchor_id, window, score, id, rank): the first k rows of each window.

    windows: anchor_id, label, vector, window, same (rows of the anchor's label, or of others), high, low.
    """
    state = windows.where("low <= high").select(
        "anchor_id", "label", "vector", "window", "same", "high", "low", F.lit(k).alias("need"), F.lit(0).cast("long").alias("base"), _bits(F.col("high") - F.col("low")).alias("shift"),
        F.lit(None).cast("long").alias("tie_base"), F.lit(None).cast("int").alias("tie_shift"), F.lit(True).alias("open"),
    )
    state = written(state, "windows")
    while (looked := state.where("open")).head(1):
        counts = _passed(rows, looked, blocks, _COUNTS, _counts, least_id).groupBy("anchor_id", "window", "digit").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("anchor_id", "window").orderBy("digit")  # 2**DIGIT_BITS rows at most
        counts = counts.withColumn("upto", F.sum("n").over(upto)).join(state.select("anchor_id", "window", F.col("need").alias("sought")), ["anchor_id", "window"])
        bucket = counts.where("upto >= sought and upto - n < sought").select("anchor_id", "window", "digit", "n", (F.col("upto") - F.col("n")).alias("ahead"))
        state = written(_narrowed(state.join(bucket, ["anchor_id", "window"], "left"), id_bits), "windows")
    found = _passed(rows, state, blocks, _FOUND, _firsts, least_id, k)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _narrowed(state: DataFrame, id_bits: int) -> DataFrame:
    """The windows after a pass: ``digit`` is where the kth row stands, null where all of the bucket's rows are wanted."""
    hit, tied = F.col("open") & F.col("digit").isNotNull(), F.col("tie_shift").isNotNull()
    shift, tie_shift = (F.greatest(F.col(c) - DIGIT_BITS, F.lit(0)) for c in ("shift", "tie_shift"))
    in_scores, in_ties = hit & ~tied, hit & tied
    many = F.col("n") > GATHERED
    begin = in_scores & many & (shift == 0)  # one score that many rows share
    return state.select(
        "anchor_id", "label", "vector", "window", "same", "high", "low",
        F.when(hit, F.col("need") - F.col("ahead")).otherwise(F.col("need")).cast("int").alias("need"),
        F.when(in_scores, F.col("base") + _shifted(F.col("digit"), shift)).otherwise(F.col("base")).alias("base"),
        F.when(in_scores, shift).otherwise(F.col("shift")).cast("int").alias("shift"),
        F.when(begin, 0).when(in_ties, F.col("tie_base") + _shifted(F.col("digit"), tie_shift)).otherwise(F.col("tie_base")).cast("long").alias("tie_base"),
        F.when(begin, id_bits).when(in_ties, tie_shift).otherwise(F.col("tie_shift")).cast("int").alias("tie_shift"),
        F.when(in_scores, many & (~begin | F.lit(id_bits > 0))).when(in_ties, many & (tie_shift > 0)).otherwise(False).alias("open"),
    )


def _shifted(digit: Column, by: Column) -> Column:
    return F.call_function("shiftleft", digit.cast("long"), by.cast("int"))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, label, embedding. An anchor's positives are the first other rows of its label; a positive's negatives the
    first rows of other labels whose score is at least low / high of the positive's and not over it.
    """
    rows = whole_vectors(vectors, anchor)
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.min("id").alias("least"), F.max("id").alias("last"), F.max(size).alias("norm")).first()
    spark = vectors.sparkSession
    most_rows = max(1024, BLOCK_BYTES // (8 * max(1, seen.d or 1)))
    blocks = max(1, -(-seen.n // most_rows), min(-(-seen.n // 4096), 2 * spark.sparkContext.defaultParallelism))
    least, id_bits = seen.least or 0, ((seen.last or 0) - (seen.least or 0)).bit_length()
    anchors = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("one")).select(F.col("id").alias("anchor_id"), "one.label", "one.vector")
    # by Cauchy and Schwarz, no score is beyond this; rounding is made up for
    reach = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)) * F.lit((seen.norm or 0.0) ** 0.5) * 1.000001 + 1
    reach = F.least(F.ceil(F.least(reach, F.lit(float(_MOST)))), F.lit(_MOST)).cast("long")
    anchors = written(anchors.withColumn("reach", F.coalesce(reach, F.lit(_MOST))), "anchors")
    own = anchors.select("anchor_id", "label", "vector", F.lit(0).alias("window"), F.lit(True).alias("same"), F.col("reach").alias("high"), (-F.col("reach")).alias("low"))
    near = written(first_rows(rows, own, positives, blocks, least, id_bits).select("anchor_id", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    least_score = F.expr(f"{low} * (positive_score div {high}) + ({low} * (positive_score % {high}) + {high - 1}) div {high}")
    sought = near.where(score >= 0).join(anchors, "anchor_id").select(
        "anchor_id", "label", "vector", "window", F.lit(False).alias("same"), score.alias("high"), least_score.alias("low")
    )
    far = first_rows(rows, sought, negatives, blocks, least, id_bits)
    return far.join(near, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
