"""Hard negatives against a plain version that scores and sorts everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int, id long, score long, block int, place long, windows string, n int"


def frame(spark, rows):
    """Vectors with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4, "w", 5) for i, v, label in rows], VECTORS)


def plain(rows, every=10, positives=5, negatives=5, low=80, high=100):
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most, out = (1 << 62) - 1, []
    for a in {i for i, _, _ in whole if i % every == 0}:
        own, vec = min((label, v) for i, v, label in whole if i == a)
        scored = [(max(-most, min(most, sum(x * y for x, y in zip(vec, v)))), i, label) for i, v, label in whole if i != a]
        far = sorted((-s, i) for s, i, label in scored if label != own)
        for s, i in sorted((-s, i) for s, i, label in scored if label == own)[:positives]:
            hits = [(-t, j) for t, j in far if low * -s <= high * -t <= high * -s][:negatives]
            out += [(a, i, r, j, -s, t) for r, (t, j) in enumerate(hits, 1)]
    return sorted(out)


def found(spark, rows, every=10, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **options).collect())


def random_rows(n=300, d=8, seed=4):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(3, d))
    rows = []
    for i in range(n):
        v = heads[i % 3] + rng.normal(size=d) * 0.3
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 4))))
    return rows


@pytest.mark.parametrize("gathered", [64, 3, 0])
def test_against_plain(spark, monkeypatch, gathered):
    monkeypatch.setattr(negatives, "GATHERED", gathered)
    rows = random_rows()
    inf, nan = float("inf"), float("nan")
    rows += [(400, None, 1), (410, [0.1] * 8, None), (420, [0.1, None] * 4, 1), (430, [nan] * 8, 1), (431, [inf] * 8, 2), (None, [0.1] * 8, 1)]
    rows += [(440, [], 1), (450, [0.5] * 3, 1), (451, [0.5] * 12, 2), (460, [0.0] * 8, 3), (470, [-0.3] * 8, 2)]
    expected = plain(rows)
    assert len(expected) > 400 and found(spark, rows) == expected


@pytest.mark.parametrize("gathered", [64, 2])
def test_many_copies(spark, monkeypatch, gathered):
    """Far more equal scores than a bucket may hold: told apart by ids, of any size and sign."""
    monkeypatch.setattr(negatives, "GATHERED", gathered)
    rows = random_rows(60)
    rows += [(1000 + 7 * i, rows[0][1], i % 2) for i in range(400)] + [(-(1 << 62) + i, rows[1][1], 3) for i in range(90)] + [((1 << 62) + i, rows[1][1], 2) for i in range(90)]
    expected = plain(rows, every=30)
    assert len(expected) > 300 and found(spark, rows, every=30) == expected


def test_repeated_rows(spark):
    rows = random_rows(40) + [(50, [1.0] + [0.0] * 7, 1)] * 150 + [(51, [1.0] + [0.0] * 7, 2)] * 150 + [(60, [0.9] + [0.0] * 7, 1), (60, [0.8] + [0.0] * 7, 0)]
    assert found(spark, rows) == plain(rows)


def test_large_components(spark):
    """Scores beyond what doubles and longs hold exactly."""
    for size in (1e6, 1e8, 1e15, 1e300):
        rows = [(i, [x * size for x in v], label) for i, v, label in random_rows(40)]
        assert found(spark, rows) == plain(rows)


def test_several_blocks_and_ratios(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 1)
    rows = random_rows(2500, d=3)
    monkeypatch.setattr(negatives, "_SCORES", 5000)
    options = dict(every=250, positives=2, negatives=3, low=50, high=90)
    assert found(spark, rows, **options) == plain(rows, **options)


def test_empty(spark):
    none = frame(spark, random_rows(3)).limit(0)
    assert negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    assert found(spark, random_rows(30), every=1000) == plain(random_rows(30), every=1000)
    assert found(spark, [(0, [1.0], 1)]) == []
