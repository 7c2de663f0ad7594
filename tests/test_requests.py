"""Request strings, parameters and routing."""

import math
from urllib.parse import quote

from pyspark.sql import functions as F

from pageflow.functions import urls
from pageflow.operators import requests


def each(spark, values, expression):
    """The expression's value for each string, in one job."""
    rows = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    return [r.r for r in rows.select("n", expression(F.col("v")).alias("r")).orderBy("n").collect()]


ADDRESSES = [
    ("", None),
    ("invalid-url", None),
    ("http://example.com", "http://example.com/"),
    ("https://example.com", "https://example.com/"),
    ("https%3A%2F%2Fexample.com", "https://example.com/"),
    ("ftp://example.com", None),
    ("https%253A%252F%252Fexample.com", "https://example.com/"),
    # two decodes are tried, a third is not
    ("https%25253A%25252F%25252Fexample.com", None),
    ("https%3A%2F%2Fexample.com%2Fa%2Bb+c", "https://example.com/a+b+c"),
    ("https%3A%2F%2Fexample.com%2", None),
    ("HTTPS://EXAMPLE.com:443/A", "https://example.com/A"),
    ("http://example.com:443", "http://example.com:443/"),
    ("http://example.com:99999/", None),
    ("http:\\\\example.com\\a\\b", "http://example.com/a/b"),
    ("https:example.com", "https://example.com/"),
    ("http://user:pw@example.com/x", "http://user:pw@example.com/x"),
    ("https://example.com/a/./b/../c/..", "https://example.com/a/"),
    ("https://example.com/a b?q=ü&r=%41#x y", "https://example.com/a%20b?q=%C3%BC&r=%41#x%20y"),
    ("  https://example.com/\n", "https://example.com/"),
    ("http://[::1]:8080/", "http://[::1]:8080/"),
    ("http://exa mple.com/", None),
    ("what is http://example.com", None),
    ("100% sure", None),
    (None, None),
]


def test_interpret_as_url(spark):
    assert dict(zip([a for a, _ in ADDRESSES], each(spark, [a for a, _ in ADDRESSES], urls.interpret_as_url))) == dict(
        ADDRESSES
    )


def test_encode_uri(spark):
    # & and # are escaped on purpose: bare they would cut the phrase short
    phrases = ["boston", "a b+c", "x/y?z=1&w#v", "ümläut 50%", "(a)~'b'!*", '"quoted" <tag>']
    assert each(spark, phrases, urls.encode_uri) == [quote(p, safe=";,/?:@=$-_.!~*'()") for p in phrases]


LINKS = [
    ("https://a.example/x", True),
    ("HTTP://A.example", True),
    ("/local/page", True),
    ("page.html", True),
    ("//other.example/x", True),
    ("/search?q=1", False),
    ("http://", False),
    ("https://exa mple.com/", False),
    ("http://[bad/", False),
    ("https://a.example/a b", True),
    ("mailto:a@example.com", False),
    ("javascript:void(0)", False),
    ("", False),
    (None, False),
]


def test_result_urls(spark):
    assert each(spark, [u for u, _ in LINKS], urls.is_result_url) == [ok for _, ok in LINKS]


def parse(spark, *raw):
    frame = spark.createDataFrame(list(enumerate(raw)), "n int, raw string")
    rows = requests.parse_parameters(frame).orderBy("n").collect()
    return rows if len(raw) > 1 else rows[0]


def test_parse_keeps_known_names_and_decodes(spark):
    row = parse(spark, "?query=a+b%20c&maxResults=5&bogus=1&token=t&maxResults=9&debugMode&x=%")
    assert (row.query, row.maxResults, row.token, row.debugMode) == ("a b c", "5", "t", "")
    assert "bogus" not in row.asDict()


FORMATS = [
    ("text,markdown", ["text", "markdown"]),
    ("text%2C%20html", ["text", "html"]),
    ("%5B%22text%22%5D", ["text"]),
    ("%5Bbad", ["[bad"]),
]


def test_output_formats_as_list_or_json(spark):
    rows = parse(spark, *[f"?query=q&outputFormats={v}" for v, _ in FORMATS])
    assert [r.outputFormats for r in rows] == [f for _, f in FORMATS]


def test_objects_must_be_json(spark):
    good, bad = parse(spark, "?proxyConfiguration=%7B%22a%22%3A1%7D", "?proxyConfiguration=%7Bbad")
    assert (good.proxyConfiguration, bad.proxyConfiguration) == ('{"a":1}', None)


def check(spark, *raw):
    frame = spark.createDataFrame(list(enumerate(raw)), "n int, raw string")
    rows = requests.validate(requests.parse_parameters(frame)).orderBy("n").collect()
    return rows if len(raw) > 1 else rows[0]


NUMBERS = [("5", 5, ""), ("0", 1, ""), ("250", 100, ""), ("abc", 3, "maxResults"), ("", 1, ""), ("7.9", 7, ""), ("-3", 1, "")]


def test_numbers_are_bounded(spark):
    rows = check(spark, *[f"?query=q&maxResults={v}" for v, _, _ in NUMBERS])
    assert [(r.max_results, r.replaced) for r in rows] == [(n, text) for _, n, text in NUMBERS]


def test_defaults(spark):
    row = check(spark, "?query=q")
    assert row.max_results == 3 and row.output_formats == ["markdown"]
    assert row.request_timeout_secs == 40 and row.dynamic_content_wait_secs == 20
    assert row.serp_proxy_group == "GOOGLE_SERP" and row.scraping_tool == "raw-http"
    assert row.serp_max_retries == 1 and row.max_request_retries == 1
    assert row.remove_cookie_warnings is True and row.debug_mode is False
    assert row.error is None and row.html_transformer == "none"


WAITS = [("10", "40", 10), ("0", "40", 20), ("40", "40", 20), ("90", "15", 8), ("x", "7", 4)]


def test_wait_is_below_the_timeout(spark):
    rows = check(spark, *[f"?query=q&dynamicContentWaitSecs={w}&requestTimeoutSecs={t}" for w, t, _ in WAITS])
    assert [r.dynamic_content_wait_secs for r in rows] == [e for _, _, e in WAITS]


WRONG = [
    ("?query=", "query"),
    ("?maxResults=1", "query"),
    ("?query=q&outputFormats=text,pdf", "outputFormats"),
    ("?query=q&serpProxyGroup=X", "serpProxyGroup"),
    ("?query=q&scrapingTool=curl", "scrapingTool"),
]


def test_wrong_choices_are_errors_of_the_row(spark):
    rows = check(spark, *[raw for raw, _ in WRONG])
    assert all(f"`{word}`" in row.error for row, (_, word) in zip(rows, WRONG))


def test_false_is_false(spark):
    row = check(spark, "?query=q&removeCookieWarnings=false&debugMode=false")
    assert row.remove_cookie_warnings is False and row.debug_mode is False


def test_search_page_plan(spark):
    frame = spark.createDataFrame(
        [("a&b c", 11, "GOOGLE_SERP"), ("q", 1, "SHADER"), ("z", 100, "SHADER")],
        "query string, max_results bigint, serp_proxy_group string",
    )
    rows = requests.search_page_plan(frame).collect()
    plan = {q: sorted((r.page, r.search_url) for r in rows if r.query == q) for q in ("a&b c", "q", "z")}
    assert [u for _, u in plan["a&b c"]] == [
        "http://www.google.com/search?q=a%26b%20c",
        "http://www.google.com/search?q=a%26b%20c&start=10",
        "http://www.google.com/search?q=a%26b%20c&start=20",
    ]
    assert len(plan["q"]) == 2 and plan["q"][0][1].startswith("https://")
    assert len(plan["z"]) == math.ceil(100 / 10) + 1


def test_ids_are_stable_and_spread(spark):
    ids = spark.range(1000).select(requests.stable_id(F.lit("x"), F.col("id")).alias("i"))
    first, second = [r.i for r in ids.collect()], [r.i for r in ids.collect()]
    assert first == second and len(set(first)) == 1000 and all(len(i) == 32 for i in first)
