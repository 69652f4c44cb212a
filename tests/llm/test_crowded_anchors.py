"""A passage that many documents share between different neighbours is reduced to its distinct windows."""

import random

from tessera.llm import fmindex


def test_equal_windows_are_reduced(spark, monkeypatch):
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(70)
    rows = [(k, f"{prose(30)} {passage} {prose(30)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables, put = {}, fmindex.written
    monkeypatch.setattr(fmindex, "written", lambda df, name: tables.setdefault(name, put(df, name)))
    found = sorted(tuple(r) for r in fmindex.digests(docs, crowded=5).collect())
    assert [r[2] for r in found] == [0] + [70] * 39
    windows, distinct = tables["context-words"].where("single"), tables["distinct-windows"]
    assert distinct.count() == windows.select("words").distinct().count() < windows.count()
    assert tables["first-documents"].join(windows, ["anchor", "context"]).count() == 0
    monkeypatch.setattr(fmindex, "written", put)
    assert found == sorted(tuple(r) for r in fmindex.digests(docs).collect())
