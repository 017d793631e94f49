from __future__ import annotations

import io

import pytest
import zstandard

from ledgerloom.llm import warc as A
from ledgerloom.llm.base import new_path

PAGES = [(1, "http://a/ b\n", "<p>x</p>" * 10), (2, "http://b/", "same é"), (3, None, "same é"), (4, "http://c/", None), (5, "http://d/", ""), (None, "http://e/", "same é"), (6, "u", "z" * 300_000), (3, None, "same é")]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS d", "2 AS last", "'x' AS refers_to")
    archives = A.write_warc(df, new_path(spark, "warc"), archive_bytes=200)
    assert archives.count() > 1
    got = A.read_warc(archives).collect()
    want = []
    for i, _, html in PAGES:
        p = (html or "").encode()
        last = max(j for j, _, h in PAGES if j is not None and (h or "").encode() == p)
        refers = last if i is None or i < last else None
        want.append((i is None, i or 0, "revisit" if refers else "response", refers, len(p), A.sha1_base32(p), None if refers else p))
    key = lambda r: repr(r)
    assert sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"] if r["payload"] is None else bytes(r["payload"])) for r in got), key=key) == sorted(want, key=key)
    assert A.read_warc(A.write_warc(df.limit(0), new_path(spark, "warc"))).count() == 0


def frames(data, dictionary):
    """The frames of bytes after the dictionary, by zstandard alone."""
    codec, out = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), []
    while data:
        one = codec.decompressobj()
        out.append(one.decompress(data))
        assert one.eof
        data = one.unused_data
    return out


def test_bytes_on_disk(spark):
    """A leading skippable frame with the dictionary and a frame a record, for pages of any length."""
    words = [f"<a href='/{i}'>link {i}</a>" for i in range(3000)]
    pages = [(i, f"http://x/{i}", (" ".join(words[i : i + 2500]) + str(i))[:50_000]) for i in range(300)]
    got = A.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), new_path(spark, "warc"), archive_bytes=100_000).collect()
    records = 0
    for r in got:
        with open(r["path"].removeprefix("file://"), "rb") as f:
            data = f.read()
        assert data[:4] == bytes.fromhex("5d2a4d18") and len(data) == r["bytes"]
        size = int.from_bytes(data[4:8], "little")
        assert size > 10_000
        own = frames(data[8 + size :], data[8 : 8 + size])
        assert len(own) == r["records"] and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in own)
        records += len(own)
    assert records == 300 and len(got) > 1


def test_archive_made_elsewhere(spark, tmp_path):
    d = b"WARC/1.1 response http " * 40
    path = tmp_path / "other.warc.zst"
    path.write_bytes(archive([A.build_record(i, "http://x/", b"y" * i, None, "2026-01-01T00:00:00Z") for i in range(200)], d))
    got = A.read_warc(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == [(i, b"y" * i) for i in range(200)]


def test_query(spark, sf):
    pages = {r[0]: (r[1] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    got = A.op8_warc(spark, sf).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in got} == {k: (len(v), A.sha1_base32(v)) for k, v in pages.items()}


def archive(records, dictionary=b"", raw=b""):
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return (A.skippable_frame(raw or dictionary) if dictionary else b"") + b"".join(z.compress(r) for r in records)


def test_reader_validates():
    good = [A.build_record(i, "http://x/", b"y" * i, None, "2026-01-01T00:00:00Z") for i in range(5)]
    d = b"WARC/1.1 response http " * 40
    for data in (archive(good), archive(good, d), archive(good, d, zstandard.ZstdCompressor().compress(d))):
        for step in (1, 7, 1 << 20):
            assert list(A.read_archive(io.BytesIO(data), step)) == good
        with pytest.raises(A.WarcError):
            list(A.read_archive(io.BytesIO(data[:-3])))
        with pytest.raises(A.WarcError):
            list(A.read_archive(io.BytesIO(data + b"junk")))
    head, block = A.parse_record(good[3])
    assert head["warc-type"] == "response" and block.endswith(b"yyy")
    for bad in (good[3][:-1], good[3].replace(b"WARC/1.1", b"WARC/9.9"), good[3].replace(b"yyy", b"yyz"), good[3].replace(b"WARC-Date", b"X-Date"), good[3].replace(b"Content-Length: 8", b"Content-Length: 9"), b"x"):
        with pytest.raises(A.WarcError):
            A.parse_record(bad)
    assert [A.id_page(A.record_id(i)) for i in (0, -5, 2**62)] == [0, -5, 2**62]
