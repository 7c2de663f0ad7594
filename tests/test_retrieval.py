"""Requests to responses: copies, bad requests, empty searches, late and missing pages."""

import datetime
import json

from pyspark.sql import functions as F

from pageflow import schemas, settings as S
from pageflow.operators import latency, search
from pageflow.operators.requests import parse_parameters, validate
from pageflow.operators.search import build_index, write_postings
from pageflow.plans.retrieval import respond, retrieve
from pageflow.sources.shared import fresh_path, staged

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
PAGE = "<html><head><title>{0}</title></head><body><p>{1}</p></body></html>"


def test_every_request_is_answered_and_copies_count_once(spark):
    corpus = [(k, "a.example", "http://a.example/copy", "copy", "zebra zebra zebra crossing") for k in range(150)]
    corpus += [(200 + k, "b.example", f"http://b.example/{k}", f"page {k}", f"zebra note {k}") for k in range(5)]
    corpus += [(300, "c.example", "/search?q=zebra", "no link", "zebra zebra"), (301, "c.example", "http://c.example/", "", "zebra")]
    corpus += [(400 + k, "d.example", f"http://d.example/{k}", f"other {k}", "nothing of the kind") for k in range(400)]
    index = write_postings(
        build_index(spark.createDataFrame(corpus, "doc_id bigint, host string, url string, title string, text string")), fresh_path(spark, "index")
    )
    raw = [
        (1, "?outputFormats=text&maxResults=5&query=zebra"),
        (2, "?outputFormats=pdf&query=zebra"),
        (3, "?outputFormats=text&query=unheard"),
        (4, "?outputFormats=text&query=http%3A%2F%2Fb.example%2F0"),
        (5, "?outputFormats=text&query=http%3A%2F%2Fnobody.example%2F"),
        (6, "?outputFormats=text&requestTimeoutSecs=10&query=http%3A%2F%2Fb.example%2F1"),
    ]
    asked = validate(parse_parameters(spark.createDataFrame(raw, "request_id bigint, raw string")))
    asked = asked.withColumn("created_at", F.lit(T0))
    pages = [("http://a.example/copy", "copy")] + [(f"http://b.example/{k}", f"page {k}") for k in range(5)]
    fetched = spark.createDataFrame(
        [(u, u, 200, "text/html", None, PAGE.format(t, t), T0 + datetime.timedelta(seconds=20)) for u, t in pages],
        schemas.FETCHED_PAGES,
    )
    found = staged(retrieve(asked, fetched, index, S.ContentSettings(output_formats=("text",))), "found")
    urls = [r.url for r in found.filter("request_id = 1").orderBy("position").collect()]
    assert len(urls) == 5 and urls[0] == "http://a.example/copy" and len(set(urls)) == 5
    rows = respond(asked, found).collect()
    assert sorted(r.request_id for r in rows) == [1, 2, 3, 4, 5, 6]
    by_id = {r.request_id: (r.http_status, json.loads(r.body)) for r in rows}
    assert by_id[1][0] == 200 and [x["metadata"]["url"] for x in by_id[1][1]] == urls
    assert by_id[1][1][0]["text"] == "copy" and by_id[1][1][0]["crawl"]["request_status"] == "handled"
    assert by_id[2] == (400, {"errorMessage": S.MSG_OUTPUT_FORMATS})
    assert by_id[3] == (200, [])
    assert by_id[4][0] == 200 and by_id[4][1][0]["metadata"]["title"] == "page 0"
    assert by_id[5] == (500, {"errorMessage": S.MSG_TIMED_OUT}) and by_id[6] == by_id[5]


def test_debug_mode_reports_stage_times(spark):
    raw = [(k, f"?outputFormats=text&debugMode={debug}&query=http%3A%2F%2Fb.example%2F{k}") for k, debug in ((1, "true"), (2, "false"))]
    asked = validate(parse_parameters(spark.createDataFrame(raw, "request_id bigint, raw string")))
    start = 1_704_067_200_000_000
    measures = latency.appended(latency.appended(latency.no_measures(), "request-received", F.lit(start)), "before-cheerio-run", F.lit(start + 250_000))
    asked = asked.withColumns({"created_at": F.lit(T0), "time_measures": measures})
    fetched = spark.createDataFrame(
        [(f"http://b.example/{k}", f"http://b.example/{k}", 200, "text/html", None, PAGE.format(k, k), T0 + datetime.timedelta(seconds=2)) for k in (1, 2)],
        schemas.FETCHED_PAGES,
    )
    corpus = spark.createDataFrame([(1, "x", "http://x.example/", "x", "x")], "doc_id bigint, host string, url string, title string, text string")
    index = write_postings(build_index(corpus), fresh_path(spark, "index"))
    found = retrieve(asked, fetched, index, S.ContentSettings(output_formats=("text",)))
    bodies = {r.request_id: json.loads(r.body)[0] for r in respond(asked, found).collect()}
    stages = bodies[1]["crawl"]["debug"]["time_measures"]
    assert [(m["event"], m["time_us"], m["delta_us"]) for m in stages] == [
        ("request-received", 0, 0), ("before-cheerio-run", 250_000, 250_000), ("cheerio-before-response-send", 2_000_000, 1_750_000)
    ]
    assert "debug" not in bodies[2]["crawl"] and bodies[2]["crawl"]["created_at"].startswith("2024-01-01")


def test_a_response_moves_no_more_results_than_it_asked_for(spark, monkeypatch):
    """400 pages score alike; a request for two of them takes two from each shard, not every page."""
    corpus = [(k, f"h{k % 9}.example", f"http://h{k % 9}.example/{k}", f"zebra {k}", "zebra zebra") for k in range(400)]
    index = write_postings(
        build_index(spark.createDataFrame(corpus, "doc_id bigint, host string, url string, title string, text string")), fresh_path(spark, "alike")
    )
    asked = validate(parse_parameters(spark.createDataFrame([(1, "?outputFormats=text&maxResults=2&query=zebra")], "request_id bigint, raw string")))
    summed, usual = [], search._summed
    monkeypatch.setattr(search, "_summed", lambda *a: summed.append(usual(*a)) or summed[-1])
    fetched = spark.createDataFrame([], schemas.FETCHED_PAGES)
    found = retrieve(asked, fetched, index, S.ContentSettings(output_formats=("text",))).collect()
    assert sorted(r.url for r in found) == ["http://h0.example/0", "http://h1.example/1"]
    assert summed[-1].count() <= 2 * index.blocks.select("shard").distinct().count()
