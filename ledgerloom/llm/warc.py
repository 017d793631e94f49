"""WARC archives in Zstandard: written and read record by record.

An archive (.warc.zst) starts with a skippable frame that holds the dictionary;
each record follows in a frame of its own. The reader loads the dictionary from
that frame, decodes one frame after the other and checks each record's version
line, mandatory headers, block length and digests.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, new_path, table

DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
#: An archive is closed once it has so many compressed bytes.
ARCHIVE_BYTES = 32_000_000
#: The dictionary: its size, and how many payloads it is trained on; of each its first SAMPLE_BYTES // SAMPLE_PAGES characters.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_BYTES = 65_536, 1_000, 8_000_000
LEVEL = 3
#: Bytes of a page_id in a record id: RFC 9562 version 8 with the number in the last 8 bytes.
ID_HEAD = bytes.fromhex("9a2c6f0e7b418000")
READ_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A frame, header, length or digest that is not as it must be."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(page_id: int | None, salt: bytes = b"") -> str:
    if page_id is None:
        return f"<{uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha1(salt).hexdigest()).urn}>"
    raw = bytearray(ID_HEAD + struct.pack(">q", page_id))
    return f"<urn:uuid:{uuid.UUID(bytes=bytes(raw))}>"


def id_page(value: str) -> int | None:
    m = re.fullmatch(r"<urn:uuid:([0-9a-f-]{36})>", value)
    if not m:
        raise WarcError(f"record id {value!r}")
    raw = uuid.UUID(m[1]).bytes
    return struct.unpack(">q", raw[8:])[0] if raw[:8] == ID_HEAD else None


def _uri(url: str | None) -> str:
    """A header value: controls and white space are percent-encoded; null: a URN."""
    if url is None:
        return "urn:x-null"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with the HTTP headers alone."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, payload)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one whole record, checked."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("record without end of headers")
    lines = data[:end].decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version line {lines[0]!r}")
    head: dict[str, str] = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {x!r}")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"no {name}")
    if not re.fullmatch(r"\d+", head["content-length"]):
        raise WarcError(f"Content-Length {head['content-length']!r}")
    size, start = int(head["content-length"]), end + 4
    block = data[start : start + size]
    if len(block) != size or data[start + size :] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size}, {len(data) - start - 4} bytes there")
    digest = head.get("warc-block-digest")
    if digest and digest != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest differs")
    return head, block


def skippable_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_archive(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The records of an archive, one a frame; memory holds one record and a block of input.

    The dictionary frame may be absent; it may hold a dictionary or one that is a
    Zstandard frame itself. Raises WarcError if the archive ends within a frame
    or has anything else between frames.
    """
    buffer = b""

    def fill(least: int) -> bool:
        nonlocal buffer
        while len(buffer) < least:
            more = stream.read(max(read_bytes, least - len(buffer)))
            if not more:
                return False
            buffer += more
        return True

    dictionary = None
    if fill(8) and struct.unpack("<I", buffer[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", buffer[4:8])[0]
        if not fill(8 + size):
            raise WarcError("archive ends within its dictionary")
        raw, buffer = buffer[8 : 8 + size], buffer[8 + size :]
        if raw[:4] == FRAME:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    codec = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while fill(4) or buffer:
        if buffer[:4] != FRAME:
            raise WarcError("no Zstandard frame where one must start")
        frame, parts = codec.decompressobj(), []
        while True:
            parts.append(frame.decompress(buffer))
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = stream.read(read_bytes)
            if not buffer:
                raise WarcError("archive ends within a frame")
        yield b"".join(parts)


def _train(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _writer(root: str, dictionary: bytes, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(root)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        number, out, path, size, count, done = 0, None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            out.close()
            done.append((root + path[len(base) :], count, size))
            out = None

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page, url, html, refers in zip(*columns, strict=True):
                if out is None:  # attempts don't share names; only a finished attempt's files are listed
                    path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    head = skippable_frame(dictionary)
                    # The frames are ours: without compression=None the whole archive would be compressed again for its extension.
                    out, size, count, number = store.open_output_stream(path, compression=None), len(head), 0, number + 1
                    out.write(head)
                record = build_record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8"), refers.as_py(), date)
                frame = packer.compress(record)
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done]) for i in range(3)], ["path", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, now: datetime.datetime | None = None) -> DataFrame:
    """Writes page_id, url, html as archives under root, which executors must share; returns path, records, bytes of each.

    Of pages with equal payloads (null html: empty) the one with the largest
    page_id is a response, and any row that shares that id; the others are
    revisits of it. A null page_id comes before all others; where all are null,
    all are responses.
    """
    spark = pages.sparkSession
    tables = Tables(spark)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("d"))
    groups = rows.groupBy("d").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    # Written first, so that both sides of the join are dealt by it alone and a frequent payload can be split.
    groups = tables.write(groups.select(F.col("d").alias("gd"), "last"), "payloads")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    made = rows.join(groups, F.col("d") == F.col("gd"), "left").select("page_id", "url", "html", refers.alias("refers_to"))
    counted = pages.count()
    share = min(1.0, 4 * SAMPLE_PAGES / max(1, counted))
    sample = pages.where(F.length("html") > 0).where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(share * 1_000_000))
    samples, size = [], 0
    for (x,) in sample.select(F.substring("html", 1, SAMPLE_BYTES // SAMPLE_PAGES)).limit(SAMPLE_PAGES).collect():
        samples.append(x.encode("utf-8"))
        size += len(samples[-1])
        if size > SAMPLE_BYTES:
            break
    date = (now or datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    store, base = pafs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    out = made.mapInArrow(_writer(root, _train(samples), date, archive_bytes), "path string, records long, bytes long")
    archives = tables.write(out, "archives")
    tables.keep(archives)
    return archives


READ_SCHEMA = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for record in read_archive(stream):
                        rows.append(_row(record, with_payload))
                        size += len(rows[-1][-1] or b"") + 200
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _row(record: bytes, with_payload: bool) -> tuple:
    head, block = parse_record(record)
    end = block.find(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", block[: max(0, end) + 2])
    if end < 0 or not m:
        raise WarcError("HTTP block without headers or Content-Length")
    payload, length = block[end + 4 :], int(m[1])
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    kind, refers = head["warc-type"], None
    if kind == "response":
        if len(payload) != length or sha1_base32(payload) != digest:
            raise WarcError("payload length or digest differs")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in head:
            raise WarcError("revisit with a payload or without what it refers to")
        refers = id_page(head["warc-refers-to"])
    else:
        raise WarcError(f"record type {kind!r}")
    return id_page(head["warc-record-id"]), kind, head.get("warc-target-uri"), refers, length, digest, payload if with_payload and kind == "response" else None


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives listed in column path (URIs that every executor can read).

    payload is null for revisits, whose bytes are those of the record they refer to.
    """
    spark = archives.sparkSession
    n = max(1, archives.count())
    return archives.select("path").repartition(min(n, 10_000)).mapInArrow(_reader(with_payload), READ_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    out = read_warc(archives, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has SHA-1 in hex alone: five hex digits are four letters of base32.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(p.h, 5 * (i // 4)::INTEGER + 1, 5))::INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN g USING (h)
"""
