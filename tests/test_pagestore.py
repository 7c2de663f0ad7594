"""The page store: which copy counts, and that pages stay in their buckets."""

import datetime
import re
import uuid

import pytest
from pyspark.sql import functions as F

from pageflow import schemas, settings as S
from pageflow.operators.requests import parse_parameters, validate
from pageflow.operators.search import build_index, write_postings
from pageflow.plans.retrieval import retrieve
from pageflow.sources.pagestore import write_page_store
from pageflow.sources.shared import BROADCAST_BYTES, fresh_path

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        ("http://a.example", at(1), "first"), ("HTTP://A.example:80/", at(3), "last"), ("http://a.example/", None, "never"),
        ("http://b.example/x", at(1), "same"), ("http://b.example/x", at(1), "same"), ("no url", at(1), "lost"), (None, at(1), "lost"),
        ("http://c.example/", None, "c"),
    ] + [(f"http://d.example/{k}", at(k), f"page {k}") for k in range(200)]
    pages = spark.createDataFrame(rows, "url string, loaded_at timestamp, html string")
    yield write_page_store(pages, f"pages_{uuid.uuid4().hex}", 8)


WANTED = [(1, "http://a.example/"), (2, "http://a.example/"), (3, "http://b.example/x"), (4, "http://nobody.example/"), (5, None), (6, "http://c.example/"), (7, "http://d.example/7")]
FOUND = [(1, "last"), (2, "last"), (3, "same"), (6, "c"), (7, "page 7")]


@pytest.mark.parametrize("max_bytes", [BROADCAST_BYTES, 0])
def test_last_copy_of_each_wanted_page(spark, store, max_bytes):
    got = store.fetch(spark.createDataFrame(WANTED, "asker int, url string"), max_bytes)
    assert set(got.columns) == {"asker", "url", "loaded_at", "html"}
    assert sorted((r.asker, r.html) for r in got.collect()) == FOUND
    assert store.fetch(spark.createDataFrame([], "asker int, url string"), max_bytes).collect() == []


@pytest.mark.parametrize("max_bytes", [BROADCAST_BYTES, 0])
def test_no_exchange_carries_a_page(spark, store, max_bytes):
    got = store.fetch(spark.createDataFrame(WANTED, "asker int, url string"), max_bytes)
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert exchanges and not any("html" in columns for columns in exchanges)
    assert "html" in plan and ("BroadcastHashJoin" in plan) == (max_bytes > 0)


def test_retrieve_reads_the_store(spark, store):
    corpus = spark.createDataFrame([(1, "x.example", "http://x.example/", "x", "x")], "doc_id bigint, host string, url string, title string, text string")
    index = write_postings(build_index(corpus), fresh_path(spark, "index"))
    raw = [(k, f"?outputFormats=text&query=http%3A%2F%2Fd.example%2F{k}") for k in (3, 9, 500)]
    asked = validate(parse_parameters(spark.createDataFrame(raw, "request_id bigint, raw string")))
    more = store.pages().withColumns({
        "loaded_url": F.col("url"), "status": F.lit(200), "content_type": F.lit("text/html"), "error": F.lit(None).cast("string"),
    })
    pages = write_page_store(more.select(*[f.split()[0] for f in schemas.FETCHED_PAGES.split(", ")]), f"pages_{uuid.uuid4().hex}", 4)
    settings = S.ContentSettings(output_formats=("text",))
    found = sorted((r.request_id, r.request_status, r.text) for r in retrieve(asked, pages, index, settings).collect())
    assert found == [(3, "handled", "page 3"), (9, "handled", "page 9"), (500, "failed", "")]
    plain = retrieve(asked, pages.pages(), index, settings).where("request_id < 500")
    assert sorted((r.request_id, r.request_status, r.text) for r in plain.collect()) == found[:2]
