"""Zstandard-compressed WARC archives: writing pages, reading records back.

An archive begins with a skippable frame that holds the compression dictionary. Every record is one Zstandard
frame, so a reader can start at any record. Equal payloads of at least ``min_bytes`` are stored once; the other
records of the same payload are revisits, which carry the headers and the digest but no payload.

The reader takes archives as Spark reads binary files, walks the frames, checks version line, mandatory headers,
header lengths against real lengths, the record's end and the payload digest, and raises on a damaged archive.

Defined results: a null html is an empty payload; a null url is written as ``urn:none``; pages without a page_id
never are the first of a payload unless all of them lack it, then all are responses; rows that repeat the smallest
page_id with the same payload are responses too; an empty table gives no archives and no records.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repurchase.llm.storage import scratch, stored

# Fixed values of the format: frame magics, little endian.
FRAME = 0xFD2FB528
DICT_FRAME = 0x184D2A5D
DICTIONARY = 0xEC30A437
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 100
# An archive is closed once it holds this many bytes, so that a reader never loads more.
ARCHIVE_BYTES = 16 << 20
# The dictionary is trained on the first records of the archive, up to this many bytes.
SAMPLE_BYTES = 1 << 20
DICT_BYTES = 16 << 10

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, body, digest, record_type, refers_to."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    # Stored, so that the join has an exchange of its own on both sides and a payload of very many pages can be split.
    first = stored(
        rows.where(F.octet_length("body") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("key"), "first"),
        "first-pages",
    )
    # Short payloads never have a partner; a key of their own keeps them apart.
    key = F.when(F.octet_length("body") >= min_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.hash("url")))
    revisit = F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") + 1), F.lit(False))
    return (
        rows.withColumn("key", key)
        .join(first, "key", "left")
        .select(
            "page_id", "url", "body", "digest",
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            F.when(revisit, F.col("first")).alias("refers_to"),
        )
    )


def _identity(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(identity: str) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d+|none)>", identity)
    if number is None:
        raise ValueError(f"bad record id {identity}")
    return None if number[1] == "none" else int(number[1])


def _record(page_id, url, body: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + (body if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else "urn:none"
    lines = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {_identity(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_identity(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], dictionary) -> bytes:
    """The bytes of one archive."""
    import zstandard

    out = io.BytesIO()
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    held = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
    out.write(struct.pack("<II", DICT_FRAME, len(held)) + held)
    for record in records:
        out.write(packer.compress(record))
    return out.getvalue()


def train(records: list[bytes]):
    """A dictionary from the first records; text as it stands where there is too little to train on."""
    import zstandard

    sample, n = [], 0
    for record in records:
        sample.append(record[:4096])
        n += len(sample[-1])
        if n >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write every partition as archives into ``folder``; returns the number of records.

    A file appears under its final name only when complete, and a repeated task writes the same names, so
    retries and lost executors leave one copy of every record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        import pyarrow.fs as fs

        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        held, size, number, count = [], 0, 0, 0

        def close() -> None:
            nonlocal held, size, number
            data = archive(held, train(held))
            name = f"{base}/part-{task.partitionId():06d}-{number:05d}.warc.zst"
            partial = f"{base}/.partial-{task.taskAttemptId()}-{number}"
            with store.open_output_stream(partial) as file:
                file.write(data)
            store.move(partial, name)
            held, size, number = [], 0, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                held.append(_record(row["page_id"], row["url"], row["body"], row["digest"], row["record_type"], row["refers_to"]))
                size += len(held[-1])
                count += 1
                if size >= archive_bytes:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    import pyarrow.fs as fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    ordered = records.sortWithinPartitions("page_id", "digest", "url")
    return ordered.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and the headers of its blocks."""
    import zstandard

    head = zstandard.frame_header_size(data[at : at + 18])
    checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    at += head
    while True:
        if at + 3 > len(data):
            raise ValueError("the archive ends within a frame")
        word = int.from_bytes(data[at : at + 3], "little")
        kind, size = word >> 1 & 3, word >> 3
        at += 3 + (1 if kind == 1 else size)
        if word & 1:
            return at + 4 * checksum


def parse(record: bytes) -> tuple:
    """The fields of ``RECORD``; raises ValueError on anything that does not hold."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(": ")
        if not colon or name in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name] = value
    missing = [n for n in MANDATORY if n not in fields]
    if missing:
        raise ValueError(f"missing {missing}")
    length = int(fields["Content-Length"])
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} does not fit {len(rest)} bytes")
    http, gap, body = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or stated is None:
        raise ValueError("no HTTP header")
    size, kind = int(stated[1]), fields["WARC-Type"]
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    refers_to = None
    if kind == "response":
        if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
            raise ValueError("payload and headers differ")
    elif kind == "revisit":
        refers_to = _page_of(fields["WARC-Refers-To"])
        if body or len(digest) != 64:
            raise ValueError("a revisit carries a digest and no payload")
    else:
        raise ValueError(f"unknown record type {kind}")
    target = fields.get("WARC-Target-URI")
    return _page_of(fields["WARC-Record-ID"]), None if target == "urn:none" else target, kind, size, digest, refers_to, body


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive: the dictionary of its leading skippable frame, then a frame for each."""
    import zstandard

    view = memoryview(data)
    magic, size = struct.unpack_from("<II", view) if len(view) >= 8 else (0, 0)
    if magic != DICT_FRAME or 8 + size > len(view):
        raise ValueError("the archive does not begin with a dictionary")
    held = bytes(view[8 : 8 + size])
    if len(held) >= 4 and struct.unpack_from("<I", held)[0] == FRAME:
        held = zstandard.ZstdDecompressor().decompress(held)
    trained = len(held) >= 4 and struct.unpack_from("<I", held)[0] == DICTIONARY
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind))
    at = 8 + size
    while at < len(view):
        end = frame_end(view, at)
        if end > len(view):
            raise ValueError("the archive ends within a frame")
        yield unpacker.decompress(view[at:end])
        at = end


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, with or without the payload itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in RECORD.fields]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                try:
                    for record in records_of(content.as_py()):
                        fields = parse(record)
                        rows.append(fields if payload else (*fields[:-1], None))
                        size += len(record) if payload else 0
                        if size >= 8 << 20 or len(rows) >= 10_000:
                            yield table(rows)
                            rows, size = [], 0
                except ValueError as error:
                    raise ValueError(f"{name}: {error}") from error
                if rows:
                    yield table(rows)

    # One archive at a time: a file is held as a whole, so batches of files would not be bounded.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives for all pages into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(plan_records(pages), folder)
    return read_archives(spark, folder, payload=False)
