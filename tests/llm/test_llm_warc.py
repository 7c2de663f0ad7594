import zlib

from pageflow.llm import warc
from pageflow.sources.shared import fresh_path
from pageflow.sources.tables import read_table

SCHEMA = "page_id long, url string, html string, file string, length int"


def test_ranges_merge_neighbours():
    settings = warc.WarcSettings(range_bytes=100, gap_bytes=10)
    rows = [("a", 0, 10), ("a", 15, 10), ("a", 60, 10), ("a", 70, 90), ("b", 160, 5)]
    found = [(f, b, e, len(m)) for f, b, e, m in warc.ranges(iter(rows), settings)]
    assert found == [("a", 0, 25, 2), ("a", 60, 160, 2), ("b", 160, 165, 1)]
    assert list(warc.ranges(iter([]), settings)) == []


def test_payloads_come_back(spark, root):
    pages = read_table(spark, root, "pages")
    index = warc.write_archives(pages, fresh_path(spark, "warc"), warc.WarcSettings(file_bytes=50_000))
    expected = {r.page_id: (r.url, r.html) for r in pages.collect()}
    rows = warc.read_records(index, warc.WarcSettings(span_bytes=20_000), payloads=True).collect()
    assert {r.page_id: (r.url, bytes(r.payload).decode()) for r in rows} == expected
    some = index.where("page_id % 7 = 0")
    assert {r.page_id for r in warc.read_records(some).collect()} == {p for p in expected if p % 7 == 0}
    first = index.first()
    source = warc.open_input(first.file)
    source.seek(first.offset)
    assert zlib.decompress(source.read(first.length), 31).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_odd_pages(spark):
    rows = [
        (1, "u", "same", "x", 0), (2, "v\r\nw", "same", "x", 0), (3, None, None, "x", 0), (4, "", "", "x", 0),
        (5, "é", "é" * 200_000, "x", 0), (6, "u", "s", "x", 0), (7, "u", "s", "x", 0), (None, None, "same", "x", 0),
        (2, "v", "same", "x", 0),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = warc.read_records(warc.write_archives(pages, fresh_path(spark, "warc"))).collect()
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in found)
    assert kinds == sorted(
        [("1", "revisit", "2", 4), ("2", "response", "None", 4), ("2", "response", "None", 4), ("3", "revisit", "4", 0),
         ("4", "response", "None", 0), ("5", "response", "None", 400_000), ("6", "revisit", "7", 1),
         ("7", "response", "None", 1), ("None", "response", "None", 4)]
    )
    large = warc.WarcSettings(min_dedup_bytes=2)
    found = warc.read_records(warc.write_archives(pages, fresh_path(spark, "warc"), large)).collect()
    assert {r.page_id for r in found if r.record_type == "revisit"} == {1}
    empty = warc.write_archives(pages.limit(0), fresh_path(spark, "warc"))
    assert warc.read_records(empty).count() == 0
