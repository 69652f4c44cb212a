"""The word model of op8_kneser_ney against a plain version, and on text whose letters say nothing."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney

DOCS = "doc_id long, text string, lang string"


def plain_bits(trusted, spelling, texts):
    """Bits of each text under interpolated modified Kneser-Ney over words, all in dictionaries."""

    def spelled(word):
        return 2.0 ** -(6.0 if word == "</s>" else kneser_ney.spelling_bits([word.encode()], spelling)[0])

    def discounts(counts):
        t = [sum(n == k for n in counts) for k in (1, 2, 3, 4)]
        if not all(t[:2]):
            return [0.5, 0.75, 0.75]
        y = t[0] / (t[0] + 2 * t[1])
        return [min(max(k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] else 0.75, 0.05), k - 0.05) for k in (1, 2, 3)]

    def pairs_of(text):
        words = ["<s>", *text.split(), "</s>"]
        return list(zip(words, words[1:]))

    pairs = Counter(p for t in trusted for p in pairs_of(t))
    before = Counter(w for _, w in pairs)
    d2, d1 = discounts(pairs.values()), discounts(before.values())
    total, mass = Counter(), defaultdict(float)
    for (v, _), n in pairs.items():
        total[v] += n
        mass[v] += d2[min(n, 3) - 1]
    rest = sum(d1[min(n, 3) - 1] for n in before.values()) / sum(before.values())

    def p1(w):
        return (before[w] - d1[min(before[w], 3) - 1] if w in before else 0) / sum(before.values()) + rest * spelled(w)

    def p2(v, w):
        if v not in total:
            return p1(w)
        n = pairs[v, w]
        return (n - d2[min(n, 3) - 1] if n else 0) / total[v] + mass[v] / total[v] * p1(w)

    return [-sum(math.log2(p2(v, w)) for v, w in pairs_of(t)) for t in texts]


def corpus():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ri", "sto", "la", "né") for b in ("ver", "ne", "mi", "xo")]
    after = {w: rng.sample(words, 3) for w in words}
    rows = []
    for k in range(40):
        line = [rng.choice(words)]
        while len(line) < 30 + k % 7:
            line.append(rng.choice(after[line[-1]]))
        rows.append((k, " ".join(line), "it"))
    return rows, words


@pytest.mark.parametrize(("hot_share", "shard_bytes"), [(0.001, 24 << 20), (0.05, 500), (2.0, 500)])
def test_bits(spark, hot_share, shard_bytes):
    rows, words = corpus()
    others = [(50, "rivermi\t rine\n\nrine x", "it"), (51, "una parola nuova", None), (51, "una parola nuova", None), (52, "lane", "it"), (53, " \n", "it"), (54, None, "it")]
    trusted = spark.createDataFrame(rows, DOCS).select("text")
    got = sorted(kneser_ney.score(spark.createDataFrame(rows + others, DOCS), trusted, hot_share, shard_bytes=shard_bytes).collect(), key=lambda r: r.doc_id)
    spelling = kneser_ney.train(trusted.selectExpr("concat('   ', regexp_replace(text, ' ', '   '), '   ') as text"))
    texts = [t for _, t, _ in rows + others[:4]]
    for r, t, bits in zip(got, texts, plain_bits([t for _, t, _ in rows], spelling, texts)):
        assert math.log2(r.perplexity) * sum(len(w.encode()) + 1 for w in t.split()) == pytest.approx(bits, rel=1e-4)
    assert [r.perplexity for r in got[44:]] == [None, None] and len(got) == len(rows + others)


def test_own_words(spark):
    """A trusted document is scored as if what only it holds weren't counted; very long texts go in blocks."""
    rows, _ = corpus()
    rows = [*rows, (60, "solo qui " * 3 + rows[0][1], "it"), (61, "lane rine " * 150_000, "it")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("is_trusted", F.lit(True))
    got = {r.doc_id: r for r in kneser_ney.score(docs, docs.select("text"), shard_bytes=500).collect()}
    without = {r.doc_id: r for r in kneser_ney.score(docs.withColumn("is_trusted", F.lit(False)), docs.select("text"), shard_bytes=500).collect()}
    assert got[60].perplexity > 1.2 * without[60].perplexity
    assert got[5].perplexity == pytest.approx(without[5].perplexity, rel=1e-6)
    assert got[61].n_bytes == 1_500_000 and without[61].perplexity < 1.2 < got[61].perplexity


def test_word_order_counts(spark):
    """The same words in another order have the same letters, but pairs that trusted text hasn't."""
    rows, words = corpus()
    rng = random.Random(3)
    shuffled = [(100 + k, " ".join(rng.sample(t.split(), len(t.split()))), "it") for k, t, _ in rows]
    trusted = spark.createDataFrame(rows[:30], DOCS).select("text")
    got = {r.doc_id: r.perplexity for r in kneser_ney.score(spark.createDataFrame(rows[30:] + shuffled[30:], DOCS), trusted).collect()}
    assert all(got[100 + k] > 1.3 * got[k] for k in range(30, 40))


def test_limits_at_any_length(spark):
    """Five trusted documents, and junk that is far longer than any of them: each has a limit, and junk goes."""
    rows, _ = corpus()
    junk = "zqx " * 5000
    rows = rows[:5] + [(200, junk, "it"), (201, junk[:400], "it"), (202, junk, "de"), (203, rows[0][1], None)]
    labels = spark.createDataFrame([(k, 1) for k in range(5)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert all(r.limit is not None for r in got.values())
    assert {k for k, r in got.items() if not r.kept} == {200, 201, 202}


def test_parts_leave_no_shuffles(spark):
    """Documents scored in parts have what they have at once, and no part's pairs stay on disk."""
    rows, _ = corpus()
    rows += [(50, "una parola nuova", None), (50, "una parola nuova", None), (51, " \n", "it"), (52, None, "it"), *[(60 + k, f"lane {k} rine ", "it") for k in range(40)]]
    docs = spark.createDataFrame(rows, DOCS)
    trusted = spark.createDataFrame(rows[:40], DOCS).select("text")
    at_once, parted = ({(r.doc_id, r.lang, r.n_bytes): r.perplexity or 0.0 for r in kneser_ney.score(docs, trusted, shard_bytes=500, parts=n).collect()} for n in (1, 5))
    assert at_once == pytest.approx(parted, rel=1e-6)
    assert kneser_ney.score(docs, trusted, shard_bytes=500, parts=5).count() == len(rows)

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in files.apply(k).getName() for k in range(files.size()))

    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    spark._jvm.System.gc()
    before = shuffled()
    kneser_ney.classify(docs, labels).count()
    assert shuffled() < before + 12


def test_rows_by_shard():
    shard = np.array([3, 0, 70000, 3, 0, 5], np.int32)
    order, places = kneser_ney._by_shard(shard)
    assert order.tolist() == [1, 4, 0, 3, 5, 2] and places == [(0, 0, 2), (3, 2, 4), (5, 4, 5), (70000, 5, 6)]
    assert kneser_ney._by_shard(shard[:0])[1] == []
