"""Merge rounds against the untouched library, on random texts and on every document."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merges, queries

sentencepiece = pytest.importorskip("sentencepiece")
PATH = merges.public_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(model, n, seed):
    rng = random.Random(seed)
    pieces = [model.id_to_piece(i) for i in range(259, model.get_piece_size())]
    odd = [" ", "  ", "a", "b", "e", "th", "é", "中", "文", "😀", "\n", "\t", "\0", merges.SPACE, "ab", "aaa", "---", "=====", "//", "1", "23", "ö", "́", "      ", "<0x41>", "</s>", "\r\n"]
    kinds = [
        lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 60))),
        lambda: "".join(rng.choice(pieces).replace(merges.SPACE, " ") for _ in range(rng.randint(0, 40))),
        lambda: "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x4E00, 0x9FFF), rng.randint(0x400, 0x4FF)])) for _ in range(rng.randint(0, 400))),
        lambda: " " * rng.randint(0, 700) + rng.choice(["", "x", " a"]),
        lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 900))),
        lambda: rng.choice("a-=_*.0 é中") * rng.randint(1, 900),
        lambda: " ".join(rng.choice(pieces).strip(merges.SPACE) for _ in range(rng.randint(0, 80))),
    ]
    return [rng.choice(kinds)() for _ in range(n)] + [None, "", " ", "\n"]


@pytest.mark.parametrize(("long", "seed"), [(merges.LONG, 1), (20, 2), (10**6, 3)])
def test_same_ids(model, monkeypatch, long, seed):
    monkeypatch.setattr(merges, "LONG", long)
    coder = merges.Coder(PATH)
    texts = random_texts(model, 2500, seed)
    ids, n = coder.encode(texts)
    ends = np.append(0, np.cumsum(n))
    expected = [model.encode(x or "", add_eos=True) for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == expected
    data, sizes = coder.decode(ids.astype(np.int64), n)
    ends = np.append(0, np.cumsum(sizes))
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [model.decode(x) for x in expected]
    again, _ = coder.encode(texts)  # out of the memo
    assert (again == ids).all()


def test_any_ids_decode(model):
    rng = random.Random(7)
    lists = [[rng.choice([rng.randint(0, 300), rng.randint(0, 31999), 3 + 0xE4, 3 + 0xB8, 3 + 0xAD, 28705]) for _ in range(rng.randint(0, 12))] for _ in range(5000)]
    data, sizes = merges.Coder(PATH).decode(np.array([x for r in lists for x in r]), np.array([len(r) for r in lists]))
    ends = np.append(0, np.cumsum(sizes))
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [model.decode(x) for x in lists]
    with pytest.raises(ValueError):
        merges.Coder(PATH).decode(np.array([32000]), np.array([1]))


def test_long_texts_in_bounded_time(model):
    """Long words without spaces, of few and of many different characters."""
    rng = random.Random(9)
    for text in (" " * 60_000, "ab" * 30_000, "".join(rng.choice("ACGT") for _ in range(60_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60_000)), "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))):
        assert merges.Coder(PATH).encode([text])[0].tolist() == model.encode(text, add_eos=True)


def test_columns(spark, model):
    rows = [(1, "Hello  world", "a"), (1, "Hello  world", "a"), (2, None, "b"), (3, "", "c"), (None, "né 中\n", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").withColumn("counts", F.lit(1))
    found = merges.decode(merges.encode(docs))
    assert found.columns == ["doc_id", "text", "words", "counts", "ids", "decoded"]
    for r in found.collect():
        assert list(r.ids) == model.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "")
    nulls = spark.createDataFrame([(None,), ([2],), ([],), ([28705],)], "ids array<int>")
    assert [r.decoded for r in merges.decode(nulls).collect()] == [None, "", "", ""]
    assert merges.decode(merges.encode(docs.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query(spark, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op13_merges(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = model.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
