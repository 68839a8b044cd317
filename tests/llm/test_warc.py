import base64
import glob
import hashlib
import os
import struct
from collections import defaultdict

import pytest
import zstandard

from marlstone.llm import warc
from marlstone.llm.common import fresh_path
from marlstone.llm.queries import op6_warc


def brute(rows, min_bytes=0):
    groups = defaultdict(list)
    for i, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for i, html in rows:
        p = (html or "").encode()
        ids = [x for x in groups[p] if x is not None]
        first = min(ids) if ids and len(groups[p]) > 1 and len(p) >= min_bytes else i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


ROWS = [(5, "http://a", "x"), (3, "http://a b\r\nX: y", "x"), (9, None, None), (-7, "u", ""), (4, "u", "é" * 70000), (11, "u", "P*M\x18\x00\x00\x00\x00 \r\n\r\n"), (None, "u", "x"), (None, "v", "alone"), (12, "u", "y"), (12, "u", "y")]


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, digest string, first int").repartition(3)
    got = warc.archive(df, min_bytes).collect()
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in got), key=str) == brute([(i, h) for i, _, h in ROWS], min_bytes)
    payloads = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
    assert all(base64.b32encode(hashlib.sha1(p).digest()).decode() == d and len(p) == n for d, p, n in ((r.payload_digest, bytes(payloads[r.payload_digest]), r.payload_bytes) for r in got))
    assert {r.url for r in got if r.page_id == 3} == {"http://a%20b%0D%0AX:%20y"}
    assert warc.archive(df.limit(0)).count() == 0


def test_files_are_frames_with_a_leading_dictionary(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string").repartition(2), path)
    n = 0
    for name in glob.glob(path.removeprefix("file:") + "/part-*"):
        data = open(name, "rb").read()
        if not data:
            continue
        assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
        size = struct.unpack("<I", data[4:8])[0]
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True)
        n += reader.read().count(b"WARC/1.1\r\n")
    assert n == 50


def test_faults_are_found():
    good = warc.record(1, "u", b"payload", None, False)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good + b"x", good.replace(b"payload", b"pAyload"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date: ", b"WARC-Date"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    frame = zstandard.compress(good)
    assert list(warc.records_in(frame + frame)) == [good, good]
    for bad in (frame[:-1], frame + b"12345678", frame[:6]):
        with pytest.raises(ValueError):
            list(warc.records_in(bad))


def foreign(kind, block, content_type="text/plain", version=b"WARC/1.0", more=()):
    head = [f"WARC-Type:{kind}", "WARC-Record-ID: <urn:uuid:11111111-2222-3333-4444-555555555555>", "warc-date: 2020-01-01T00:00:00Z", f"Content-Type: {content_type}", *more, f"Content-Length:  {len(block)}"]
    return version + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    http = "application/http; msgtype=response"
    records = [
        foreign("warcinfo", b"software: x\r\n", "application/warc-fields"), foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request"), foreign("resource", b"raw"),
        foreign("response", b"HTTP/1.0 200 OK\r\ncontent-length:4\r\n\r\nbody", http, more=("WARC-Target-URI: <http://x/>", "WARC-Block-Digest: md5:zz")), foreign("response", b"HTTP/1.0 200 OK\r\n\r\nchunk", http, b"WARC/1.1"),
        foreign("revisit", b"HTTP/1.0 304 Not Modified\r\n\r\n", http, more=("WARC-Refers-To: <urn:x:y>", "WARC-Payload-Digest: sha1:AAAA", "X-Note: one", "  and two")), foreign("response", b"1.2.3.4", "text/dns"),
    ]
    data = b"".join(map(zstandard.compress, records))
    path = fresh_path(spark, "warc-foreign")
    folder = path.removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/a.warc.zst", "wb") as f:
        f.write(data)
    got = warc.read_archive(spark, path).collect()
    assert [(r.record_type, r.payload_bytes, r.payload and bytes(r.payload)) for r in got] == [
        ("warcinfo", 13, b"software: x\r\n"), ("request", 0, b""), ("resource", 3, b"raw"), ("response", 4, b"body"), ("response", 5, b"chunk"), ("revisit", 0, None), ("response", 7, b"1.2.3.4"),
    ]
    assert {r.page_id for r in got} == {None} and got[3].url == "http://x/" and got[5].refers_to_id == "urn:x:y" and got[5].payload_digest == "AAAA"
    assert all(r.record_id == "urn:uuid:11111111-2222-3333-4444-555555555555" for r in got)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op6_warc(spark, sf_dir).collect()), key=str) == brute(rows)
