"""The corpus pipeline on a small corpus: each stage takes out what it should and keeps the rest."""

import os
import random
import tempfile

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=8):
    rng = random.Random(seed)
    parts = "la to ne ri mo ca del ver sol fio".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, prose(rng.randint(80, 200))) for k in range(60)]
    passage, item = prose(80), prose(30)
    rows += [(60, rows[3][1]), (61, rows[4][1].replace(" ", "\n", 3)), (62, "@@## %%$$ |||| " * 40), (63, None), (64, f"{prose(90)}\n{passage}"), (65, f"{prose(90)}\n{passage}\n{prose(20)}"), (66, f"{prose(60)} {item} {prose(60)}")]
    return rows, item, passage


def tables(spark, rows, items, trusted):
    """A folder with the pipeline's tables; documents have a column that the operators use inside."""
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = DOCS + ", spans string, root string, __id string, __hash string, bad_id string, cut_spans string, dirty_hash string, kept_id string"
    spark.createDataFrame([(i, t, "it", "s", len(t or ""), *"xyzabcde") for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_edges(spark):
    """Empty tables, repeated rows, nulls and very long texts, with columns whose names clash."""
    empty = tables(spark, [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    rows, item, passage = corpus()
    rng = random.Random(1)
    long = " ".join(rng.choice(rows[k % 50][1].split()) + str(k % 977) for k in range(150_000))
    rows += [(0, rows[0][1]), (None, rows[1][1] + " coda diversa"), (70, long), (71, " "), (72, long + " " + item)]
    folder = tables(spark, rows, [(1, item), (2, None), (3, "")], [*range(50), 70, 72])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, folder).write.parquet(out := f"{folder}/{name}")
        docs = spark.read.parquet(out)
        assert docs.columns[-8:] == ["spans", "root", "__id", "__hash", "bad_id", "cut_spans", "dirty_hash", "kept_id"]
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    assert kept.count(0) == 1 and 71 not in kept and 70 in kept and 72 not in kept and 66 not in kept
    packed = corpus_pipeline.packed(spark, docs, folder).groupBy("doc_id").count().collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted(kept, key=str) and {r.doc_id: r["count"] for r in packed}[70] > 50


def test_stages(spark):
    rows, item, passage = corpus()
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(i, t, "it", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(out := f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == before.columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
    everyone = {i for i, _ in rows}
    assert everyone - set(seen[0]) == {62, 63}
    assert set(seen[0]) - set(seen[1]) == {60, 61}
    assert set(seen[1]) == set(seen[2]) and passage in seen[2][64] and passage not in seen[2][65]
    assert set(seen[2]) - set(seen[3]) == {66}
    assert {r.doc_id for r in docs.collect()} == set(seen[3])
    assert os.path.isdir(f"{folder[7:]}/packing") and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]
