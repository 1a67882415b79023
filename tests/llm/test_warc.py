import base64
import hashlib
import io

import pytest
import zstandard
from stratalog.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, content string"


def plain(rows, least=0):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= least and p != first.get(h or "")
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first.get(h or "") if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [(5, "http://a/b c\r\nd", "x"), (3, None, "x"), (9, "", None), (8, "u", ""), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "x"), (7, "u", "long " * 500_000)]


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "p", "c") for r in rows], SCHEMA)


@pytest.mark.parametrize("least", [0, 2])
def test_cases(pages, least):
    assert got(warc.warc_round_trip(pages(ROWS), least)) == plain(ROWS, least)
    assert warc.warc_round_trip(pages([])).count() == 0


def test_table(table):
    rows = [(r.page_id, r.url, r.html) for r in table("pages").collect()]
    assert got(warc.warc_round_trip(table("pages"))) == plain(rows)


def test_bundle_is_seekable():
    file = io.BytesIO()
    bundle = warc.BundleWriter(file, frame_bytes=2000)
    for i in range(50):
        bundle.add(i, warc.record(i, "http://x/", f"page {i} ".encode() * 20, None, False))
    bundle.close()
    assert len(bundle.frames) > 3
    reader = warc.BundleReader(file)
    assert [r["record_id"] for r in reader.records()] == list(range(50))
    assert reader.find(37)["payload"] == b"page 37 " * 20 and reader.find(99) is None
    # A plain zstd reader passes over the index and the seek table.
    file.seek(0)
    whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole.count(b"WARC-Record-ID") == 50


def test_damage_is_noticed():
    raw = warc.record(1, None, b"payload", None, False)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"paylord\r\n\r\n"))
