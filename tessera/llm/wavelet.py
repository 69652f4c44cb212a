"""Token ids as wavelet matrices, one compressed file a shard.

Documents are dealt into ranges of doc_id and sorted; each task encodes its range and writes a file whenever it has
``shard_tokens`` ids. A file holds the doc_ids, their lengths, and one bit-plane for each bit of an id with a
directory of ranks; ids are read, counted and looked up on the planes. Where a file's ids stand among all ids is
known from the manifest, which has one row a file.

Edge cases: a null text is an empty document (the end id alone); documents without doc_id come first; rows that
share a doc_id follow each other by a hash of their text. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import listed_files, new_path
from tessera.llm.tokens import encoder, public_path

MAGIC = b"WAVELET1"
MANIFEST_SCHEMA = "file string, part int, number int, docs long, tokens long, bytes long"
_BLOCK_WORDS = 8  # 64-bit words from one entry of the directory to the next


class WaveletMatrix:
    """Ids under 2**levels: planes of 64-bit words, zeros of each plane, and ones before each block of words."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @property
    def levels(self) -> int:
        return len(self.planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        n = len(ids)
        levels = levels or max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        after = np.empty_like(now)
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            ones = (now & now.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            block = 8 * _BLOCK_WORDS
            words = np.zeros((len(packed) // block + 1) * block, np.uint8)
            words[: len(packed)] = packed
            words = words.view("<u8")
            counts = np.bitwise_count(words).reshape(-1, _BLOCK_WORDS).sum(axis=1, dtype=np.uint32)
            planes.append(words)
            ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4"))
            zeros.append(n - int(counts.sum()))
            now, after = after, now
            np.compress(~ones, after, out=now[: zeros[-1]])
            np.compress(ones, after, out=now[zeros[-1] :])
        return cls(n, planes, zeros, ranks)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane."""
        word = at >> 6
        block = word // _BLOCK_WORDS
        words, out = self.planes[level], self.ranks[level][block].astype(np.int64)
        for k in range(_BLOCK_WORDS - 1):
            here = block * _BLOCK_WORDS + k
            out += np.bitwise_count(words[here]) * (here < word)
        return out + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def access(self, at) -> np.ndarray:
        """Ids at positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for level in range(self.levels):
            bit = (self.planes[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            ones = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """The stretch of the last level that holds the occurrences of a symbol before ``end``."""
        low, high = 0, end
        for level in range(self.levels):
            a, b = self._ones(level, np.array([low, high], np.int64)).tolist()
            if (symbol >> (self.levels - 1 - level)) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of a symbol before position ``end``."""
        if symbol < 0 or symbol >> self.levels:
            return 0
        low, high = self._range(symbol, end)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of a symbol, ascending."""
        if symbol < 0 or symbol >> self.levels:
            return np.zeros(0, np.int64)
        low, high = self._range(symbol, self.n)
        if (high - low) * 64 * _BLOCK_WORDS < self.n:  # few: look for each
            return self._up(symbol, np.arange(low, high))
        at = np.arange(low, high)
        for level in range(self.levels - 1, -1, -1):
            one = (symbol >> (self.levels - 1 - level)) & 1
            bits = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little")
            at = np.flatnonzero(bits == one)[at - self.zeros[level] * one]
        return at

    def select(self, symbol: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of a symbol."""
        low, high = self._range(symbol, self.n) if 0 <= symbol >> self.levels < 1 else (0, 0)
        if not 0 <= k < high - low:
            raise IndexError(f"symbol {symbol} occurs {high - low} times")
        return int(self._up(symbol, np.array([low + k]))[0])

    def _up(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Where positions of the last level, in the stretch of a symbol, come from."""
        for level in range(self.levels - 1, -1, -1):
            one = (symbol >> (self.levels - 1 - level)) & 1
            at = self._place(level, one, at - self.zeros[level] * one)
        return at

    def _place(self, level: int, one: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) set or clear bit of a plane: its block by the directory, its place in the block by counting."""
        bits = 64 * _BLOCK_WORDS
        ones = self.ranks[level].astype(np.int64)
        before = ones if one else np.arange(len(ones)) * bits - ones
        block = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        blocks = self.planes[level].reshape(-1, _BLOCK_WORDS)
        for a in range(0, len(k), 1 << 12):
            part = block[a : a + (1 << 12)]
            held = np.unpackbits(blocks[part].view(np.uint8), axis=1, bitorder="little") == one
            out[a : a + (1 << 12)] = part * bits + (np.cumsum(held, axis=1, dtype=np.int32) > (k[a : a + (1 << 12)] - before[part])[:, None]).argmax(axis=1)
        return out

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            ones = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            up[np.flatnonzero(ones)] = now[self.zeros[level] :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = up
        return now

    def to_bytes(self) -> bytes:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        parts = [struct.pack("<QB", self.n, self.levels)]
        for words, zeros, ranks in zip(self.planes, self.zeros, self.ranks):
            a, b = press.compress(words.tobytes()), press.compress(ranks.tobytes())
            parts += [struct.pack("<QII", zeros, len(a), len(b)), a, b]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data) -> WaveletMatrix:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        n, levels = struct.unpack_from("<QB", data)
        at, planes, zeros, ranks = 9, [], [], []
        for _ in range(levels):
            z, a, b = struct.unpack_from("<QII", data, at)
            at += 16
            planes.append(np.frombuffer(open_.decompress(data[at : at + a]), "<u8"))
            ranks.append(np.frombuffer(open_.decompress(data[at + a : at + a + b]), "<u4"))
            zeros.append(z)
            at += a + b
        return cls(n, planes, zeros, ranks)


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's file: doc_ids (with marks where there is none), lengths, matrix; a checksum last."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    head = zlib.compress(known.tobytes() + numbers.tobytes() + np.array(lengths, "<u8").tobytes(), 1)
    body = MAGIC + struct.pack("<QQ", len(doc_ids), len(head)) + head + WaveletMatrix.build(ids).to_bytes()
    return body + struct.pack("<I", zlib.crc32(body))


def open_shard(data) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and matrix of a file that ``shard_bytes`` made; ValueError for others."""
    data = memoryview(data)
    if len(data) < 28 or bytes(data[:8]) != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole shard")
    docs, size = struct.unpack_from("<QQ", data, 8)
    head = zlib.decompress(data[24 : 24 + size])
    known, numbers = np.frombuffer(head, np.uint8, docs), np.frombuffer(head, "<i8", docs, docs)
    matrix = WaveletMatrix.from_bytes(data[24 + size : -4])
    return [int(x) if k else None for k, x in zip(known, numbers)], np.frombuffer(head, "<u8", docs, 9 * docs), matrix


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_tokens: int = 4 << 20) -> DataFrame:
    """Encodes ``docs`` in order of doc_id and writes the shards below ``path``; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        encode, end = encoder(vocabulary, True), struct.pack("<I", end_id)
        part, attempt, number = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal tokens, number
            data = shard_bytes(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"))
            name = f"part-{part:05d}-{attempt}-{number:05d}.wavelet"  # what another attempt wrote isn't in the manifest
            with fs.open_output_stream(f"{root}/.{name}.tmp") as stream:
                stream.write(data)
            fs.move(f"{root}/.{name}.tmp", f"{root}/{name}")
            row = pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([len(data)], pa.int64())],
                names=["file", "part", "number", "docs", "tokens", "bytes"],
            )
            doc_ids.clear(), lengths.clear(), held.clear()
            tokens, number = 0, number + 1
            return row

        for batch in batches:
            for doc_id, ids in zip(batch.column(0), encode.ids(batch.column(1).to_pylist())):
                ids += end
                doc_ids.append(doc_id.as_py())
                lengths.append(len(ids) // 4)
                held.append(ids)
                tokens += len(ids) // 4
                if tokens >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(write, MANIFEST_SCHEMA)


_DOC_SCHEMA = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def shard_rows(name: str, data) -> pa.RecordBatch:
    """file, doc_id, local_start, n_tokens and ids_crc32 of every document of a shard."""
    doc_ids, lengths, matrix = open_shard(data)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    if starts[-1] != matrix.n:
        raise ValueError("the lengths don't fit the ids")
    ids = matrix.decode().astype("<u4")
    sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(starts[:-1]), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
        names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"],
    )


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """The rows of the shards below ``path`` that a written manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    yield shard_rows(name, stream.read())

    return listed_files(manifest, "file").mapInArrow(read, _DOC_SCHEMA)


def bases(manifest: DataFrame) -> DataFrame:
    """(file, base): the ids in all files before each. Parts are added up first, so one task has a row for each part only."""
    parts = manifest.groupBy(F.col("part").alias("b_part")).agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("b_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("b_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_part"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(parts, F.col("part") == F.col("b_part"))
    return files.select("file", (F.col("of_part") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("base"))


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = 4 << 20) -> DataFrame:
    """Writes all documents in the shared folder and returns doc_id, start, n_tokens and ids_crc32 from the files."""
    spark = docs.sparkSession
    path = new_path(spark, "wavelet")
    write_shards(docs, f"{path}/shards", vocabulary or public_path("byte_bpe_50k.json"), end_id, shard_tokens).write.parquet(f"{path}/manifest")
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")
    # Both sides grow with the corpus, but seem as small as the manifest that they come from.
    found = read_shards(manifest, f"{path}/shards").hint("merge").join(bases(manifest), "file")
    return found.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
