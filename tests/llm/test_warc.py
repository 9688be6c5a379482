"""Archives written and read back, also by gzip alone; records that are cut off or altered."""

import gzip
import hashlib
import io

import pytest
from tests_llm_paths import SF_DIR

from schemaloom.llm import queries_pages, warc


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None] if len(data) >= 100 else []
        first = min(same, default=None)
        revisit = first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_op8(spark, duck):
    rows = duck.execute("select page_id, url, html from pages").fetchall()
    got = queries_pages.op8_warc(spark, SF_DIR)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == expected(rows)
    assert got.where("error is not null").count() == 0


LONG, SHORT = "<p>é " + "x" * 200, "<p>short"
ROWS = [
    (7, "http://a/b c\r\nX: y", LONG), (3, None, LONG), (9, "http://a", LONG), (3, "http://again", LONG), (None, "u", LONG),
    (1, "u", SHORT), (2, "u", SHORT), (4, "u", None), (5, "u", ""), (6, "u", "line\r\n\r\nWARC/1.1\r\n" * 20_000),
    (8, "u", "y" * 100), (10, "u", "y" * 100), (-5, "u", "y" * 99), (11, "u", "y" * 99), (None, "u", "z" * 300), (None, "u", "z" * 300),
]


@pytest.fixture
def pages(spark):
    rows = [(*r, "clash", 1) for r in ROWS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest int").repartition(3)


def test_odd_pages(pages):
    archives = warc.write(pages, archive_bytes=700)
    got = warc.read(archives)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == expected(ROWS)
    payloads = {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert all(payloads[p] == (h or "") for p, _, h in ROWS if p in payloads)
    assert got.where("page_id = 7").first().url == "http://a/b%20c%0D%0AX:%20y"


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).collect() == []


def test_members_are_plain_gzip():
    one = warc.record(1, "u", b"abc" * 50, None)
    with gzip.GzipFile(fileobj=io.BytesIO(one)) as file:
        text = file.read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"abc\r\n\r\n")


def test_broken_records():
    a, b, c = (warc.record(i, "u", b"payload %d" % i * 30_000, None) for i in (1, 2, 3))
    assert [r.get("page_id") for r in warc.records(a + b + c)] == [1, 2, 3]
    assert [r.get("page_id") for r in warc.records(a + b[: len(b) // 2])] == [1, None]
    hurt = b[:40] + bytes([b[40] ^ 255]) + b[41:]
    got = list(warc.records(a + hurt + c))
    assert got[0]["page_id"] == 1 and "error" in got[1] and got[-1]["page_id"] == 3

    def packed(text):
        return gzip.compress(text, mtime=0)

    plain = gzip.decompress(b)
    for wrong in (plain.replace(b"payload 2", b"payload 9"), plain.replace(b"Content-Length: ", b"Content-Length: 1"), b"no header", plain + plain, plain[:-2]):
        got = list(warc.records(packed(wrong) + c))
        assert "error" in got[0] and got[-1]["page_id"] == 3
    info = packed(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    assert [r["page_id"] for r in warc.records(info + a)] == [1]
    assert list(warc.records(b"")) == [] and "error" in list(warc.records(b"junk"))[0]


def test_reads_files(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(warc.record(5, "u", b"abc", None) + warc.record(6, "u", b"", 5))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read(files).collect())
    assert got == [(5, "response", 3, None), (6, "revisit", 0, 5)]
