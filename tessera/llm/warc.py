"""WARC archives in Zstandard form (``.warc.zst``): writer and reader.

An archive starts with a skippable frame that holds the dictionary; after it each record is a frame of its own.
Writers work on a partition each, train the dictionary on the first records of the archive, roll over to a new
archive at ``archive_bytes`` and so never hold more than one archive. Readers take whole archives from Spark's
``binaryFile`` source, decode frame by frame and check what they decode.

Edge cases: a null html is an empty payload, a null url is written as ``urn:page:ID``; rows that share both
page_id and payload get one record each with the same role; a null page_id never is the record that others
refer to unless all copies lack one (then all are responses). An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import listed_files, new_path

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")

RECORD_SCHEMA = (
    "page_id long, record_type string, record_id string, target_uri string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary, archive string"
)
MANIFEST_SCHEMA = "archive string, records long, bytes long"


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, html, payload_digest and refers_to (null for responses).

    Only ids, digests and lengths meet by digest; the payloads are shuffled once, by page.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest")
    )
    ids = pages.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "payload_digest")
    firsts = ids.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = (
        ids.join(firsts, "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
        .groupBy(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"))
        .agg(F.min("refers_to").alias("refers_to"))
    )
    on = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest"))
    return pages.join(revisits, on, "left").drop("r_page", "r_digest")


def record_id(page_id, digest: str) -> str:
    """The same for a page and payload in every run, so a revisit can name the record that it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit without payload."""
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary for records like the samples; plain content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def write_archives(
    pages: DataFrame, path: str, archive_bytes: int = 8 << 20, dictionary_bytes: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 3
) -> DataFrame:
    """Writes what ``mark_revisits`` returns below ``path``; returns the manifest, whose evaluation writes.

    An archive's dictionary comes from its first records, up to ``sample_bytes``. Names hold the task's attempt: what a lost
    or second attempt wrote isn't in the manifest, and so isn't read (see ``read_listed``).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import zstandard

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part, attempt, number = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        waiting: list[bytes] = []
        out, press, records, held = io.BytesIO(), None, 0, 0

        def begin():
            nonlocal press, held
            words = train_dictionary(waiting, dictionary_bytes)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
            press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True, write_checksum=True)
            for record in waiting:
                out.write(press.compress(record))
            waiting.clear()
            held = 0

        def close() -> pa.RecordBatch:
            nonlocal out, press, records, number
            if press is None:
                begin()
            name = f"part-{part:05d}-{attempt}-{number:05d}.warc.zst"
            with fs.open_output_stream(f"{root}/.{name}.tmp") as stream:
                stream.write(out.getbuffer())
            fs.move(f"{root}/.{name}.tmp", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([records], pa.int64()), "bytes": pa.array([out.tell()], pa.int64())})
            out, press, records, number = io.BytesIO(), None, 0, number + 1
            return row

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "payload_digest", "refers_to")]
            for values in zip(*columns, strict=True):
                page_id, url, html, digest, refers_to = (v.as_py() for v in values)
                record = record_bytes(page_id, url, html.encode(), digest, refers_to)
                records += 1
                if press is None:
                    waiting.append(record)
                    held += len(record)
                    if held >= sample_bytes:
                        begin()
                else:
                    out.write(press.compress(record))
                if out.tell() >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return pages.mapInArrow(write, MANIFEST_SCHEMA)


def frames(data: memoryview, step: int = 64 << 10) -> Iterator[bytes]:
    """The decoded frames of an archive that starts with its dictionary."""
    import zstandard

    if len(data) < 8:
        raise ValueError("the archive is shorter than a frame header")
    magic, length = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or 8 + length > len(data):
        raise ValueError("the archive doesn't start with a dictionary frame")
    words = bytes(data[8 : 8 + length])
    if words[:4] == FRAME_MAGIC:
        words = zstandard.ZstdDecompressor().decompress(words, max_output_size=1 << 27)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    at = 8 + length
    while at < len(data):
        if bytes(data[at : at + 4]) != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        expected = zstandard.get_frame_parameters(bytes(data[at : at + 32])).content_size
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            piece = data[at : at + step]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        record = b"".join(parts)
        if expected not in (zstandard.CONTENTSIZE_UNKNOWN, len(record)):
            raise ValueError("a frame's length isn't the one in its header")
        yield record


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record whose headers and lengths hold; ValueError otherwise."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header: {line!r}")
        headers[name] = value.strip()
    if missing := [x for x in REQUIRED if x not in headers]:
        raise ValueError(f"missing headers: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    return headers, rest[:-4]


def _http(block: bytes) -> tuple[int, bytes]:
    """Length that the HTTP head states, and the payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    stated = [x[15:].strip() for x in lines[1:] if x[:15].lower() == b"content-length:"]
    if not found or not lines[0].startswith(b"HTTP/") or len(stated) != 1 or not stated[0].isdigit():
        raise ValueError("not an HTTP block")
    return int(stated[0]), payload


def archive_rows(name: str, data: memoryview, with_payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of an archive in RECORD_SCHEMA; ValueError if it breaks a rule."""
    fields = [x.split() for x in RECORD_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])
    rows, held = [], 0
    for record in frames(data):
        headers, block = parse_record(record)
        stated, payload = _http(block)
        kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        if kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("the payload doesn't fit its length or digest")
        if kind == "revisit" and (payload or not headers.get("WARC-Refers-To")):
            raise ValueError("a revisit has a payload or refers to nothing")
        page, refers = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
        if kind == "revisit" and refers and headers["WARC-Refers-To"] != record_id(int(refers), digest):
            raise ValueError("a revisit refers to another record than its page's")
        rows.append(
            (int(page) if page else None, kind, headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), int(refers) if refers else None,
             stated, digest, payload if with_payload else None, name)
        )
        held += len(payload)
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of all archives below ``path`` in RECORD_SCHEMA. Archives that break a rule fail the read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from archive_rows(name.as_py(), memoryview(content.as_buffer()), with_payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(read, RECORD_SCHEMA)


def read_listed(manifest: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """``read_archives`` of the archives that a written manifest lists, and of no others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    yield from archive_rows(name, memoryview(stream.read()), with_payload)

    return listed_files(manifest, "archive").mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Writes all pages as archives in the shared folder and returns the records read back, without payloads."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    manifest = write_archives(mark_revisits(pages, min_revisit_bytes), f"{path}/archives")
    manifest.write.parquet(f"{path}/manifest")
    return read_listed(spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest"), f"{path}/archives", with_payload=False)
