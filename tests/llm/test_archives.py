"""WARC archives and wavelet shards: exact round trips and broken files."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import warc, wavelet
from tessera.llm.common import new_path

PAGES = "page_id long, url string, html string, extra string"


def test_warc_round_trip(spark):
    long = "x" * 120
    rows = [(1, "u1", long, "e"), (2, "u2", long, "e"), (3, None, None, None), (4, "a\r\nb", "kurz", None), (5, "u", "kurz", None), (None, "n", long, None), (6, "è", "ù" * 100_000, None), (2, "u2", long, "e"), (7, "", "", "")]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    seen = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)
    expected = []
    for page_id, _, html, _ in rows:
        data = (html or "").encode()
        again = html == long and page_id != 1
        expected.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert seen == sorted(expected, key=str)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_payloads_and_small_archives(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.repeat(F.concat(F.lit("<p>riga "), F.col("id").cast("string")), 50).alias("html"))
    path = new_path(spark, "warc-test")
    manifest = warc.write_archives(warc.mark_revisits(pages), path, archive_bytes=4000, sample_bytes=2000, dictionary_bytes=1024).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == 300
    found = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert found == {r.page_id: r.html for r in pages.collect()}
    listed = spark.createDataFrame([(m.archive, m.records, m.bytes) for m in manifest[1:]], warc.MANIFEST_SCHEMA)
    assert warc.read_listed(listed, path).count() == 300 - manifest[0].records


def test_revisits_name_their_record(spark):
    """The link is the id of the record that holds the payload."""
    pages = spark.createDataFrame([(k, "u", "z" * 200, None) for k in (3, 1, 2)], PAGES)
    path = new_path(spark, "warc-links")
    warc.write_archives(warc.mark_revisits(pages), path).collect()
    import pyarrow.fs

    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    heads = {}
    for file in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        with fs.open_input_stream(file.path, compression=None) as stream:
            for record in warc.frames(memoryview(stream.read())):
                headers, _ = warc.parse_record(record)
                heads[headers["WARC-Page-ID"]] = headers
    assert {h["WARC-Refers-To"] for k, h in heads.items() if k != "1"} == {heads["1"]["WARC-Record-ID"]} and heads["1"]["WARC-Type"] == "response"
    record = warc.record_bytes(2, "u", b"", "d" * 64, 1).replace(b"WARC-Refers-To-Page-ID: 1", b"WARC-Refers-To-Page-ID: 9")
    import zstandard

    words = b"x" * 20
    whole = struct.pack("<II", warc.DICTIONARY_MAGIC, len(words)) + words + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(record)
    with pytest.raises(ValueError, match="another record"):
        list(warc.archive_rows("a", memoryview(whole), False))


def test_warc_checks():
    record = warc.record_bytes(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse_record(record)[1].endswith(b"abc")
    for broken in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"WARC-Date", b"WARC-Dote"), record.replace(b"WARC-Type:", b"WARC-Type"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(broken)
    import zstandard

    words = b"dictionary " * 20
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(record)
    whole = struct.pack("<II", warc.DICTIONARY_MAGIC, len(words)) + words + frame * 3
    assert list(warc.frames(memoryview(whole), step=7)) == [record] * 3
    pressed = zstandard.compress(words)
    assert list(warc.frames(memoryview(struct.pack("<II", warc.DICTIONARY_MAGIC, len(pressed)) + pressed + frame))) == [record]
    for broken in (whole[:-3], whole + b"x", frame, whole[:4]):
        with pytest.raises(ValueError):
            list(warc.frames(memoryview(broken)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=700))
def test_wavelet_matrix(values):
    ids = np.array(values, np.uint32)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert m.decode().tolist() == values
    assert m.access(np.arange(len(values))).tolist() == values
    for symbol in [*values[:5], 0, 69_999]:
        places = [k for k, v in enumerate(values) if v == symbol]
        assert m.count(symbol) == len(places) and m.occurrences(symbol).tolist() == places
        assert m.rank(symbol, len(values) // 2) == sum(p < len(values) // 2 for p in places)
        assert m._up(symbol, np.arange(*m._range(symbol, m.n))).tolist() == places if symbol < 1 << m.levels else not places
        if places:
            assert m.select(symbol, len(places) - 1) == places[-1]
        with pytest.raises(IndexError):
            m.select(symbol, len(places))


def test_shards(spark):
    from tokenizers import Tokenizer

    from tessera.llm.tokens import public_path

    rows = [(5, "uno due tre", "x"), (1, None, "x"), (3, "", None), (None, "ciao", "x"), (2, "la la la " * 3000, "x"), (5, "uno due tre", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.round_trip(docs, shard_tokens=4).collect())
    tokenizer, at, expected = Tokenizer.from_file(public_path("byte_bpe_50k.json")), 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        data = struct.pack(f"<{len(ids)}I", *ids)
        expected.append((at, doc_id, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    assert found == expected
    assert wavelet.round_trip(docs.limit(0)).count() == 0
    data = wavelet.shard_bytes([1, None], [1, 2], np.array([7, 8, 9], "<u4"))
    assert wavelet.open_shard(data)[0] == [1, None]
    with pytest.raises(ValueError):
        wavelet.open_shard(data[:-5] + b"xxxxx")
