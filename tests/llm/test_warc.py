import base64
import hashlib
import io

import pytest
import zstandard

from stridelake.llm import warc
from stridelake.llm.queries import op9_warc

SF = "/root/testdata/sf0.001"


def plain(rows, least=0):
    groups = {}
    for i, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        first = max((x for x in groups[data] if x is not None), default=None)
        revisit = len(groups[data]) > 1 and len(data) >= least and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_query_round_trip(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, op9_warc(spark, SF).collect()), key=repr) == plain(rows)


ROWS = [(1, "http://a/\r\nX: y", "<p>one"), (2, None, "<p>one"), (3, "http://ü/?q=1", None), (4, "", ""), (5, "u", "ñ" * 70000), (None, "u", "<p>one"), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (2, None, "<p>one"), (7, "u", "x")]


def test_odd_rows_and_payloads(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, payload string")
    for least in (0, 3):
        manifest = warc.write_archives(df, min_revisit_bytes=least, archive_bytes=64)
        got = warc.read_archives(manifest, manifest.warc_folder).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain([(i, h) for i, _, h in ROWS], least)
        held = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
        assert held[5] == "ñ" * 70000 and held[6] == "\r\n\r\nWARC/1.1\r\n"
    assert warc.read_archives(warc.write_archives(df.limit(0)), "file:///tmp").count() == 0


def archive(records, dictionary):
    d = zstandard.ZstdCompressionDict(dictionary)
    c = zstandard.ZstdCompressor(dict_data=d)
    return warc.dictionary_frame(dictionary) + b"".join(map(c.compress, records))


@pytest.fixture(scope="module")
def dictionary():
    return warc.train_dictionary([(f"<html><body><p>page {k} of many " * 9).encode() for k in range(300)], 2048)


def record(payload=b"hello", page_id=4):
    return warc.build_record(page_id, "http://x/", payload, len(payload), warc.base32_sha1(payload), None, "1970-01-01T00:00:00Z")


def test_archive_layout(dictionary):
    records = [record(b"x" * n, n) for n in (0, 1, 5000)]
    data = archive(records, dictionary)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    for chunk in (1, 7, 1 << 20):
        assert list(warc.read_archive(io.BytesIO(data), chunk)) == records
    plain_file = b"".join(map(zstandard.ZstdCompressor().compress, records))
    assert list(warc.read_archive(io.BytesIO(plain_file))) == records
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_broken_archives(dictionary):
    good = archive([record()], dictionary)
    for bad in (good[:-3], good[: len(good) - len(good) // 3], good + b"junk"):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(bad)))
    other = zstandard.ZstdCompressor().compress(record())
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(warc.dictionary_frame(dictionary) + other)))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: 5\r", b"Content-Length: 6\r"), (b"hello", b"jello"), (b"WARC-Date", b"WARC-Dote"), (b"response\r", b"unknown\r"), (b"<urn:page:4>", b"<urn:else:4>"), (b"hello\r\n\r\n", b"hello")])
def test_broken_records(change):
    assert warc.parse_record(record())["page_id"] == 4
    with pytest.raises(warc.WarcError):
        warc.parse_record(record().replace(*change))
