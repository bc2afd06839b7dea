"""WARC archives in Zstandard frames with a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; every record then is one frame
of its own. The dictionary is trained on a bounded sample of the payloads. Equal payloads are stored
once: the page with the smallest id has the response, the others revisit it. The reader loads the
dictionary from the first frame, decodes frame by frame and checks every header and length.

Defined results: a null html is an empty payload; payloads under 100 bytes are always
stored. Rows that repeat the smallest id of a payload are responses as well. Null ids
count as larger than any id; a payload that only such rows have is stored by each. A null url
is an empty target. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import files

#: Fixed values of the format: magic numbers of a dictionary's skippable frame and of a frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_SHARED = 100
#: The dictionary's size and the sample it is trained on (rows, bytes of each).
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 1000
#: Compressed bytes that one task reads back, about.
PART_BYTES = 64 << 20
SAMPLE_BYTES = 16 << 10


class BadRecord(ValueError):
    """An archive or record that breaks the format."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; too few or too short ones give raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers),
             b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, stream, dictionary: bytes, level: int = 6):
        self.stream = stream
        stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True,
                                               write_checksum=True)

        self.end = 8 + len(dictionary)

    def add(self, headers: list[tuple[str, str]], payload: bytes) -> None:
        frame = self.frames.compress(record(headers, payload))
        self.stream.write(frame)
        self.end += len(frame)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    end = data.find(b"\r\n\r\n")
    lines = data[:max(end, 0)].split(b"\r\n")
    if end < 0 or lines[0] != VERSION:
        raise BadRecord("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip() or name.lower() in headers:
            raise BadRecord(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-payload-digest", "content-length"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    start, length = end + 4, headers["content-length"]
    if not length.isdigit() or len(data) != start + int(length) + 4 or data[-4:] != b"\r\n\r\n":
        raise BadRecord(f"content-length {length} in a record of {len(data)} bytes")
    return headers, data[start:-4]


def read_archive(stream, begin: int | None = None, end: int | None = None):
    """(headers, payload) of every record of a Zstandard archive, or of the frames from ``begin`` to
    ``end``; one frame in memory at a time."""
    first = stream.read(8)
    if not first:
        return
    magic, size = struct.unpack("<II", first) if len(first) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise BadRecord("no dictionary frame")
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise BadRecord("the dictionary is cut")
    decoder = zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary) if size else None)
    left = None
    if begin is not None:
        stream.seek(begin)
        left = end - begin

    def more() -> bytes:
        nonlocal left
        data = stream.read(1 << 20 if left is None else min(1 << 20, left))
        left = None if left is None else left - len(data)
        return data

    rest = b""
    while True:
        rest = rest or more()
        if not rest:
            return
        frame, out = decoder.decompressobj(), io.BytesIO()
        while not frame.eof:
            out.write(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else more()
            if not frame.eof and not rest:
                raise BadRecord("the last frame is cut")
        yield parse(out.getvalue())


def first_pages(pages: DataFrame) -> DataFrame:
    """(digest, first_id) of payloads that several rows share; counted before the shuffle."""
    return pages.filter(F.col("payload_bytes") >= LEAST_SHARED).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def stored_target(url: str | None) -> str:
    """The url with white space and control characters percent-encoded: a header line ends at them."""
    return "".join(quote(c, safe="") if c <= " " or c == "\x7f" or c.isspace() else c for c in url or "")


def write_archives(pages: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """One archive per task; returns the manifest (path, begin, end, records) of its parts of about
    ``part_bytes``, kept below the folder."""
    spark = pages.sparkSession
    # A share of the hashes, about SAMPLE_ROWS rows: no task or driver gathers more candidates. Rows that agree in
    # all columns are one.
    bodies = pages.filter(F.col("html").isNotNull())
    share = int((1 << 40) * min(1.0, SAMPLE_ROWS / max(1, bodies.count())))
    hashed = bodies.select(F.xxhash64("page_id", "url", "html").alias("h"), F.substring("html", 1, SAMPLE_BYTES).alias("s"))
    sample = hashed.filter(F.pmod("h", F.lit(1 << 40)) < share).groupBy("h").agg(F.min("s").alias("s")).select("s").orderBy("s")
    dictionary = train_dictionary([r[0].encode() for r in sample.collect()])
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", body.alias("payload")).withColumns({
        "digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # A payload that many rows share is one key of this join; adaptive execution splits it.
    shared = full.join(first_pages(full), "digest", "left").select(
        "page_id", "url", "digest", "payload_bytes", "first_id",
        F.when(F.col("first_id").isNull() | (F.col("first_id") == F.col("page_id")), F.col("payload")).alias("payload"))

    def run(batches):
        writer, n, begin, parts = None, 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    path, stream = files.create(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst")
                    writer = ArchiveWriter(stream, dictionary)
                    begin = writer.end
                target = stored_target(row["url"])
                kind = "response" if row["payload"] is not None else "revisit"
                headers = [("WARC-Type", kind), ("WARC-Target-URI", target),
                           ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"),
                           ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "text/html; charset=utf-8"),
                           ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
                           ("WARC-Payload-Length", str(row["payload_bytes"]))]
                if kind == "revisit":
                    headers += [("WARC-Profile", REVISIT_PROFILE),
                                ("WARC-Refers-To", f"<urn:page:{row['first_id']}>")]
                writer.add(headers, row["payload"] or b"")
                n += 1
                if writer.end - begin >= part_bytes:
                    parts.append({"path": path, "begin": begin, "end": writer.end, "records": n})
                    begin, n = writer.end, 0
        if writer is not None:
            stream.close()
            if n:
                parts.append({"path": path, "begin": begin, "end": writer.end, "records": n})
            yield pa.RecordBatch.from_pylist(parts)

    shared.mapInArrow(run, "path string, begin long, end long, records long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def page_of(urn: str | None) -> int | None:
    """The page id of <urn:page:N>."""
    if urn is None or urn == "<urn:page:None>":
        return None
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise BadRecord(f"bad record id {urn}")
    return int(urn[10:-1])


def validated(headers: dict[str, str], payload: bytes) -> dict:
    """One result row; a response's digest and length must be those of its payload."""
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
    size = int(headers.get("warc-payload-length", len(payload)))
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest or size != len(payload):
            raise BadRecord(f"{headers['warc-record-id']}: payload and digest differ")
    elif kind != "revisit" or payload or headers.get("warc-profile") != REVISIT_PROFILE:
        raise BadRecord(f"{headers['warc-record-id']}: no valid {kind}")
    return {"page_id": page_of(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": page_of(headers.get("warc-refers-to")),
            "url": headers.get("warc-target-uri"),
            "html": payload.decode() if kind == "response" else None}


SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, url string, html string")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives; a part of one is the unit of work of a task."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                        ("html", pa.string())])

    def run(batches):
        for batch in batches:
            for path, *part, records in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "records"))):
                rows, size, n = [], 0, 0
                for headers, payload in read_archive(files.open_input(path), *part):
                    rows.append(validated(headers, payload))
                    if not payloads:
                        rows[-1]["html"] = None
                    n, size = n + 1, size + len(payload)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if n != records:
                    raise BadRecord(f"{path} has {n} records, not {records}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.dealt(manifest, "path", "begin").mapInArrow(run, SCHEMA)
