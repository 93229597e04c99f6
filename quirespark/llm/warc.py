r"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Pages become response records; of those with the same payload all but the one of smallest id become revisits, which
carry the HTTP head but no payload. Archives are rows (archive string, content binary) of a Parquet table in the
shared folder, so that any executor can read what another wrote; each content is a whole .warc.zst file. The reader
finds the frames by their block headers, decodes each by itself and validates versions, headers, lengths, digests
and record ends; a fault raises ValueError with the archive's name and the offset.

Edge cases: null html is an empty payload; null urls and ids are written as empty values and read as null; a null id
counts as larger than all others, and where all rows of a payload have null ids, all are responses; rows with the same
id and payload are all responses, or all revisits; line ends in urls are percent-encoded; no rows give no archive; a
payload of any length is one record, held whole by one task; other columns never matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Fixed values of the format: magic of the skippable frame that holds a dictionary, of a dictionary, of a frame.
DICT_FRAME, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records in one archive, and of the sample and the size of its dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 8_000_000, 1_000_000, 16_384
#: Payloads with copies whose ids (28 bytes each) are sent to the scan; more are joined.
SENT_COPIES = 1_000_000
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not m:
        raise ValueError(f"record id {name}")
    return int(m[1]) if m[1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of refers_to."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name_of(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[1:1] = [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive. Its dictionary is trained on its own first records; too few of them give an empty frame."""
    sample, size = [], 0
    for r in records:
        sample.append(r[:65536])
        size += len(sample[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        words = zstandard.train_dictionary(min(DICT_BYTES, max(256, size // 8)), sample).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        words = b""
    options = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
    packer = zstandard.ZstdCompressor(level=6, write_checksum=True, **options)
    return b"".join([struct.pack("<II", DICT_FRAME, len(words)), words, *map(packer.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, by its block headers."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no frame at {at}")
    checksum = data[at + 4] & 4
    pos = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if pos + 3 > len(data):
            raise ValueError(f"truncated frame at {at}")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            pos += 4 if checksum else 0
            if pos > len(data):
                raise ValueError(f"truncated frame at {at}")
            return pos


def unpack(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an archive."""
    data = memoryview(content)
    if len(data) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != DICT_FRAME or 8 + size > len(data):
        raise ValueError("no dictionary frame")
    words = bytes(data[8 : 8 + size])
    if words[:4] == struct.pack("<I", FRAME_MAGIC):  # the format allows a compressed dictionary
        words = zstandard.ZstdDecompressor().decompress(words)
    elif words and words[:4] != struct.pack("<I", DICT_MAGIC):
        raise ValueError("the leading frame holds no dictionary")
    options = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
    reader, at = zstandard.ZstdDecompressor(**options), 8 + size
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield at, reader.decompress(bytes(data[at:end]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at {at}: {e}") from None
        at = end


def parse(raw: bytes) -> dict:
    """A record, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise ValueError("no WARC head")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.decode().partition(":")
        if not colon or key.lower() in fields:
            raise ValueError(f"header {line[:60]!r}")
        fields[key.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields):
        raise ValueError(f"missing {sorted(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the length does not hold")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", http)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit") or not gap or not http.startswith(b"HTTP/1.") or not size:
        raise ValueError(f"no HTTP {kind}")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(size[1]) or base32_sha1(payload) != digest):
        raise ValueError("the payload is not what its length and digest say")
    if kind == "revisit" and (payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields):
        raise ValueError("no revisit of an identical payload")
    return {
        "page_id": id_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri") or None, "payload_bytes": int(size[1]),
        "payload_digest": digest, "record_type": kind, "refers_to": id_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives of (page_id, url, html): a table (archive, content). Payloads under `least` bytes never revisit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    bounded_batches(pages.sparkSession)
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # only digests and ids are shuffled for this: one row per payload and task
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    first = stored(first, "first-ids")
    if first.count() <= SENT_COPIES:
        first = F.broadcast(first)
    linked = rows.join(first, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            content = pack(held)
            name = hashlib.sha1(content).hexdigest() + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                held.append(record(*(batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "refers_to"))))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return stored(linked.mapInArrow(run, "archive string, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of (archive, content), as RECORDS."""
    bounded_batches(archives.sparkSession)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = []
                for at, raw in unpack(batch.column(1)[k].as_py()):
                    try:
                        found.append(parse(raw))
                    except ValueError as e:
                        raise ValueError(f"{batch.column(0)[k]} at {at}: {e}") from None
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds, strict=True)], names)

    return archives.select("archive", "content").mapInArrow(run, RECORDS)
