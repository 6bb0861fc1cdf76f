import gzip
import hashlib

import pytest

from tarn.llm import common, warc

BIG, OTHER = "<p>same</p>" * 120, "é" * 600
PAGES = [
    *[(i, f"http://h{i % 3}.example.com/p/{i}", BIG) for i in range(20)],
    *[(20 + i, "http://same.example.org/hot", OTHER if i % 2 else f"own {i}" * 300) for i in range(30)],
    (60, "https://user@Example.COM:8080/a?b=c#d", "x" * 999), (61, "no scheme", "x" * 999), (62, "", "x" * 1000), (63, None, "x" * 1000),
    (64, "http://[broken", None), (65, "http://a\n b/", ""), (66, "http://a/\r\nWARC-Type: x", "\r\n\r\n" * 300), (67, "é://ü/ß", "tail\r\n\r\n"),
    (70, "http://twice/", BIG + "!"), (70, "http://twice/", BIG + "!"), (None, "http://none/", BIG), (None, None, None),
]


def want():
    raw = [(i, (h or "").encode()) for i, _, h in PAGES]
    keeper = {}
    for i, b in raw:
        if i is not None:
            keeper[b] = max(keeper.get(b, i), i)
    out = []
    for i, b in raw:
        again = i is not None and len(b) >= 1000 and keeper[b] != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", keeper[b] if again else None))
    return sorted(map(repr, out))


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


@pytest.mark.parametrize("lines", [500, 3, 1])
def test_round_trip_through_the_index(pages, lines, monkeypatch):
    monkeypatch.setattr(warc, "LINES", lines)
    rows = warc.archive_and_read(pages.repartition(5).selectExpr("*", "1 AS digest", "2 AS offset")).drop("url").collect()
    assert sorted(repr(tuple(r)) for r in rows) == want()


def test_payloads_and_files(pages, spark):
    folder = common.scratch(spark, "test")
    captures = warc.write_archives(pages, folder)
    rows = warc.read_records(captures, folder, payload=True).collect()
    by = {r.page_id: bytes(r.payload) for r in rows if r.record_type == "response" and r.page_id is not None}
    assert all(by[i] == (h or "").encode() for i, _, h in PAGES if i in by)
    store, path = warc.open_store(folder)
    names = {r.file for r in captures.collect()}
    whole = b"".join(gzip.decompress(store.open_input_file(f"{path}/{n}").read()) for n in names)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)


def test_damage_is_found():
    member = warc.make_record(1, "http://a/", b"payload", None)
    body = gzip.decompress(member)
    assert warc.read_record(member)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.read_record(gzip.compress(body.replace(b"payload\r\n", b"pAyload\r\n")))
    with pytest.raises(Exception):
        warc.read_record(member[:-9])


def test_keys_sort_by_host():
    assert warc.url_key("http://www.Example.com/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("https://a.b:81") == "b,a:81)/"
    assert warc.url_key(None) == warc.url_key("") == ""


def test_absent_urls_and_empty_tables(pages, spark):
    folder = common.scratch(spark, "test")
    directory = warc.write_index(warc.write_archives(pages, folder), folder)
    asked = spark.createDataFrame([("http://nobody/",), ("http://h1.example.com/p/1",), ("http://h1.example.com/p/1",)], "url string")
    assert [r.page_id for r in warc.look_up(asked, directory, folder).collect()] == [1]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_a_hot_key_and_a_long_page(spark, monkeypatch):
    """Many captures of one key are dealt out by block and come back in several batches; long payloads stay whole."""
    monkeypatch.setattr(warc, "LINES", 20)
    monkeypatch.setattr(warc, "FOUND_ROWS", 50)
    rows = [(i, None if i % 2 else "http://hot.example/", f"page {i}") for i in range(700)] + [(1000, "http://z/", "x" * 3_000_000), (1001, "http://z/", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == 702 and got[1000].refers_to == 1001 and got[1001].payload_bytes == 3_000_000
    assert all(got[i].payload_bytes == len(f"page {i}") for i in range(700))
