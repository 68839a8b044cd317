"""WARC archives compressed with Zstandard: one frame per record, and a dictionary in the leading skippable frame.

Writing. Records with equal payloads (by SHA-1) of at least ``min_bytes`` bytes are one response, that of the smallest
page id, and revisits of it, which carry no payload. Frames are rows of Spark's text writer, whose line separator is an
empty skippable frame: so the files are written by Spark's own commit protocol, to any file system it knows, and a lost
task is simply repeated. Every file begins with its dictionary.

Reading. Files are read by Spark; a frame is found by walking its block headers, decompressed with the file's dictionary,
and checked: version line, required headers, lengths of block and payload, end marks, digest of the payload. Anything
else raises ValueError. Archives of others are read too: all record types of the standard, and ids that this module did
not make, which stand in ``record_id`` and ``refers_to_id`` while ``page_id`` and ``refers_to`` are null. A payload is what
follows the HTTP header in a response, revisit or request over HTTP, else the block. A file is one row while it is read, 2
GB at most, so the writer's partitions bound it (Spark's advisory partition size).

Defined results: null html is an empty payload; a null url has no target header; control characters and spaces in a url
are percent-encoded; rows that repeat the smallest id of a payload are responses all; a null page id is never smallest;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_at_end, fresh_path

#: Fixed values of the formats.
ZSTD_MAGIC, DICTIONARY_MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # 0x184D2A50 and length 0
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = 0x6D61726C73746F6E
DATE = "1970-01-01T00:00:00Z"
DICTIONARY_SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 8192, 16384


def record_id(page_id: int | None) -> str:
    """A record's URN, from which the page id can be read back."""
    return uuid.UUID(int=((NAMESPACE + (page_id is None)) << 64) | ((page_id or 0) & (1 << 64) - 1)).urn


def page_of(urn: str) -> int | None:
    """The page id in a record's URN; None if there is none, or the record is not of this module's making."""
    try:
        space, low = divmod(uuid.UUID(urn).int, 1 << 64)
    except ValueError:
        return None
    if space != NAMESPACE:
        return None
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    digest = sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(first)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(data: bytes) -> dict:
    """The record's fields; ValueError if anything is amiss."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(0, end)].split(b"\r\n")
    if end < 0 or lines[0] not in VERSIONS:
        raise ValueError("no WARC header")
    head: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if line[:1] in b" \t" and last:  # goes on with the line before
            head[last] += " " + line.strip().decode("utf-8", "surrogatepass")
            continue
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        last = name.strip().decode("utf-8", "replace").lower()
        head[last] = value.strip().decode("utf-8", "surrogatepass")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - head.keys()
    if missing or not head["content-length"].isdigit():
        raise ValueError(f"headers missing or bad: {sorted(missing) or 'content-length'}")
    block, tail = data[end + 4 : end + 4 + int(head["content-length"])], data[end + 4 + int(head["content-length"]) :]
    if len(block) != int(head["content-length"]) or tail != b"\r\n\r\n":
        raise ValueError("the block's length is not as stated")
    kind = head["warc-type"]
    if kind not in TYPES:
        raise ValueError(f"record type {kind}")
    payload, size = block, len(block)
    if kind in ("response", "request", "revisit") and head.get("content-type", "").lower().startswith("application/http"):
        http_end = block.find(b"\r\n\r\n")
        if http_end < 0:
            raise ValueError("no HTTP header")
        payload = block[http_end + 4 :]
        length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", block[:http_end], re.I)
        size = int(length[1]) if length else len(payload)
        if kind != "revisit" and size != len(payload) and "warc-truncated" not in head:
            raise ValueError("the payload's length is not as stated")
    digest = head.get("warc-payload-digest", "")
    stated = digest.removeprefix("sha1:") if digest.startswith("sha1:") else None
    if kind == "revisit":
        if payload and payload is not block:
            raise ValueError("a revisit with a payload")
    elif stated is not None and stated != sha1(payload) and "warc-truncated" not in head:
        raise ValueError("the payload's digest is not as stated")
    if stated is None and kind != "revisit":
        stated = sha1(payload)
    own, other = head["warc-record-id"].strip("<>"), head.get("warc-refers-to", "").strip("<>") or None
    return {
        "page_id": page_of(own), "url": head.get("warc-target-uri", "").strip("<>") or None, "payload_bytes": size, "payload_digest": stated, "record_type": kind,
        "refers_to": page_of(other) if other else None, "payload": None if kind == "revisit" else payload, "record_id": own, "refers_to_id": other,
    }


def frame_end(data, at: int) -> int:
    """Where the frame that begins at ``at`` ends; ValueError if it is cut short or no frame."""
    try:
        magic, n = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = at + 8 + n
        elif magic != ZSTD_MAGIC:
            raise ValueError(f"no frame at {at}")
        else:
            head = data[at + 4]
            single = head >> 5 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[head & 3] + (single, 2, 4, 8)[head >> 6]
            last = False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data):
                    raise ValueError("cut short")
                last = block & 1
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * (head >> 2 & 1)
    except (struct.error, IndexError):
        raise ValueError("cut short") from None
    if end > len(data):
        raise ValueError("cut short")
    return end


def records_in(data: bytes) -> Iterator[bytes]:
    """The records of one archive file."""
    import zstandard

    if not data:
        return
    view, at, dictionary = memoryview(data), 0, None
    if struct.unpack_from("<I", data, 0)[0] == DICTIONARY_MAGIC:
        at = frame_end(view, 0)
        dictionary = bytes(view[8:at])
        if dictionary[:4] == struct.pack("<I", ZSTD_MAGIC):
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        if struct.unpack_from("<I", data, at)[0] == ZSTD_MAGIC:
            yield opened.decompress(view[at:end])
        at = end


def train_dictionary(pages: DataFrame, html_col: str) -> bytes:
    """A dictionary from up to ``DICTIONARY_SAMPLE`` pages' first ``SAMPLE_CHARS`` characters. It bears on size only."""
    import zstandard

    few = pages.select(F.substring(html_col, 1, SAMPLE_CHARS).alias("h")).where("h <> ''").limit(DICTIONARY_SAMPLE).collect()
    samples = [record(n, f"http://example.com/{n}", r["h"].encode("utf-8", "surrogatepass"), None, False) for n, r in enumerate(few)]
    plain = "<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{0}</title></head><body><h1>{0}</h1><p>{1}</p></body></html>"
    samples += [record(n, f"https://www.example.org/{n * n}", plain.format(n, n * 7919).encode(), n // 2, n % 2 == 1) for n in range(200)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row of ``pages`` to archive files in the folder ``path``."""
    dictionary = train_dictionary(pages, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    same = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = rows.join(same, "digest", "left")
    large = F.length("payload") >= min_bytes
    revisit = F.coalesce(large & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))

    def frames(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        first = True
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [press.compress(record(i, url, p.as_py(), f, r)) for i, url, p, f, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist())]
                if first and out:
                    out.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    first = False
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    made = both.select("id", "url", "payload", "first", revisit.alias("revisit")).mapInArrow(frames, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, record_id, refers_to_id), one per record."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                out: list[dict] = []
                for r in records_in(data.as_py()):
                    out.append(parse_record(r))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    delete_at_end(pages.sparkSession, path)
    return read_archive(pages.sparkSession, path)
