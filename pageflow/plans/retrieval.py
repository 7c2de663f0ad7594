"""The whole way from requests to ranked responses, for many requests at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow import schemas, settings as S
from pageflow.functions import urls
from pageflow.functions.selectors import is_supported
from pageflow.operators import content, hits, latency, responses
from pageflow.operators.requests import route, stable_id
from pageflow.operators.search import Postings, search
from pageflow.sources.pagestore import PageStore
from pageflow.sources.shared import broadcast_if_small, small_batches, staged

CARRIED = ("query", "output_formats", *content.ROW_SETTINGS)


def plan_pages(requests: DataFrame, index: Postings, search_settings: S.SearchSettings, version: str | None = None) -> DataFrame:
    """The page requests of each request: its URL, or its best search results.

    ``version`` names a column of requests and index that tells pages of one URL apart.

    Works on narrow columns only; no page is read here.
    """
    # read by both branches and joined again below
    own = [version] if version else []
    routed = staged(
        route(requests.filter("error IS NULL")).select("request_id", "route", "target", "max_results", *own, *CARRIED[1:]),
        "routed",
    )
    response_id = stable_id(F.lit("response"), F.col("request_id"))

    direct = routed.filter("route = 'url'").select(
        "request_id",
        response_id.alias("response_id"),
        stable_id(F.lit("page"), F.col("request_id"), F.col("target")).alias("unique_key"),
        F.col("target").alias("query"),
        *own,
        *CARRIED[1:],
        F.col("target").alias("url"),
        F.lit(None).cast("bigint").alias("rank"),
        F.lit(None).cast(schemas.SEARCH_RESULT).alias("search_result"),
    )

    asked = routed.filter("route = 'search'")
    most = S.NUMBER_BOUNDS["maxResults"][1]
    phrases = asked.select(F.col("request_id").alias("query_id"), F.col("target").alias("phrase"), F.col("max_results").alias("wanted"))
    described = index.documents.select("doc_id", "url", "title", *own)
    # a response takes no more than it has asked for, so no more is searched
    found = search(phrases, index, replace(search_settings, top_k=most), kinds_of_result(index.documents, *own))
    unique = found.join(described, "doc_id").select(
        "query_id",
        F.floor((F.col("rank") - 1) / S.RESULTS_PER_PAGE).alias("page"),
        F.col("rank").alias("pos"),
        "title",
        F.lit(None).cast("string").alias("description"),
        "url",
        F.lit("ORGANIC").alias("result_type"),
        *own,
    )
    limits = asked.select(
        F.col("request_id").alias("query_id"), "max_results", F.col("target").alias("query"), *CARRIED[1:]
    )
    best = hits.ranked(unique.join(limits, "query_id"), F.col("max_results"), most)
    by_search = hits.page_requests(best, *own, *CARRIED, keys=own).select(
        F.col("query_id").alias("request_id"),
        "response_id",
        "unique_key",
        "query",
        *own,
        *CARRIED[1:],
        "url",
        F.col("search_result.rank").alias("rank"),
        "search_result",
    )
    return direct.unionByName(by_search)


def kinds_of_result(documents: DataFrame, *within: str) -> DataFrame:
    """(shard, doc_no, kind) of the documents with a valid title and URL; those with the same (and the same ``within`` columns) are of one kind.

    Copies of a page count once, before any cut, so that they cannot crowd out other results.
    """
    same = ["title", "url", *within]
    listed = hits.valid_results(documents).select("shard", "doc_no", *same)
    first = listed.groupBy(*same).agg(F.min("doc_no").alias("kind")).select("kind", *[F.col(c).alias(f"_{c}") for c in same])
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    return staged(listed.join(first, alike).select("shard", "doc_no", "kind"), "kinds")


def retrieve(
    requests: DataFrame,
    fetched: DataFrame | PageStore,
    index: Postings,
    content_settings: S.ContentSettings = S.ContentSettings(),
    search_settings: S.SearchSettings = S.SearchSettings(),
    version: str | None = None,
) -> DataFrame:
    """One row per result of every request, with its place in the response.

    ``requests`` went through ``validate``; ``fetched`` holds one row per URL
    (url, loaded_url, status, content_type, error, html, loaded_at), or is a
    page store of them, from which pages never move; ``index``
    is a stored posting index of a corpus with url and title.  Where several pages have one URL, ``version``
    names a column of requests (null in searches), fetched and index that tells them apart.  A page is processed
    once per selector and transformer, however many requests ask for it;
    ``content_settings`` names the formats made, of which each request gets its own.
    A page nobody fetched leaves its request pending, which fails at the end;
    so does, where requests have ``created_at``, one fetched after its timeout.
    Requests with ``time_measures``, too, get their stage times back as ``debug`` if in debug mode.
    Bad requests and phrases without a hit have no result; ``respond`` answers them.
    """
    small_batches(requests.sparkSession)
    own = [version] if version else []
    job_key = stable_id(F.col("url"), *[F.col(c).cast("string") for c in own], *[F.col(c).cast("string") for c in content.ROW_SETTINGS])
    planned = responses.sort_by_rank(plan_pages(requests, index, search_settings, version)).withColumn("job_key", job_key)
    timed = "created_at" in requests.columns
    measured = timed and "time_measures" in requests.columns
    if timed:
        times = ["created_at", "request_timeout_secs", *(["debug_mode", "scraping_tool", "time_measures"] if measured else [])]
        planned = planned.join(requests.select("request_id", *times), "request_id")
    planned = staged(planned, "page-requests")
    # one job per page and set of settings, however many requests share it
    jobs = staged(planned.select("job_key", "url", *own, *content.ROW_SETTINGS).distinct(), "page-jobs")
    if isinstance(fetched, PageStore):
        wanted = fetched.fetch(jobs)
    else:
        pages = fetched.withColumn("url", urls.http_url(F.col("url")))
        wanted = pages.join(broadcast_if_small(jobs), ["url", *own])
    selector = F.col("remove_elements_css_selector")
    unusable = F.when(
        ~is_supported(selector) & (selector != content_settings.remove_selector),
        F.concat(F.lit("unsupported selector: "), selector),
    )
    none = lambda kind: F.lit(None).cast(kind)
    # records of pages, before it is known who asked
    bare = wanted.select(
        F.lit("any").alias("response_id"),
        F.col("job_key").alias("unique_key"),
        none("string").alias("query"),
        none("timestamp").alias("created_at"),
        none(schemas.SEARCH_RESULT).alias("search_result"),
        F.coalesce("error", unusable).alias("error"),
        "url", "loaded_url", "status", "content_type", "loaded_at", "html", *content.ROW_SETTINGS,
    )
    records = content.all_records(
        bare, lambda df: content.with_content(content.with_metadata(df), content_settings)
    ).select(
        F.col("unique_key").alias("job_key"),
        "text", "html", "markdown", "metadata",
        "crawl.http_status_code", "crawl.http_status_message", "crawl.request_status", "crawl.loaded_at",
    )
    merged = planned.join(records, "job_key", "left")
    if timed:
        late = ~responses.in_time(F.col("created_at"), F.col("loaded_at"), F.col("request_timeout_secs"))
        merged = merged.withColumn("request_status", F.when(late, F.lit(None)).otherwise(F.col("request_status")))
    if measured:
        taken = latency.sent(F.col("time_measures"), F.col("scraping_tool"), F.unix_micros("loaded_at"))
        debug = F.when(F.col("request_status") == S.HANDLED, latency.debug_of(taken, F.col("debug_mode")))
        merged = merged.withColumn("debug", debug).drop("debug_mode", "scraping_tool", "time_measures")
    asked = lambda name: F.when(F.array_contains("output_formats", name), F.col(name))
    handled = F.col("request_status") == S.HANDLED
    closed = responses.close(
        merged.withColumns(
            {
                "request_status": F.coalesce("request_status", F.lit(S.PENDING)),
                "title": F.col("metadata.title"),
                "text": F.when(handled, asked("text")).otherwise(F.lit("")),
                "html": F.when(handled, asked("html")),
                "markdown": F.when(handled, asked("markdown")),
            }
        )
    )
    return closed.drop("job_key", *own, *CARRIED[1:])


RECORD = ("text", "html", "markdown", "query", "crawl", "search_result", "metadata")


def _record(results: DataFrame) -> Column:
    """The whole record of each result of ``retrieve``."""
    carried = [c for c in ("created_at", "debug") if c in results.columns]
    crawl = F.struct(*carried, "http_status_code", "http_status_message", "loaded_at", "request_status", "unique_key")
    return F.struct(*[crawl.alias(c) if c == "crawl" else F.col(c) for c in RECORD])


def messages(results: DataFrame) -> Column:
    """Each result of ``retrieve`` as a JSON text message that holds its whole record."""
    return responses.result_message(_record(results))


def respond(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, http_status, body) for every request, whatever became of it.

    ``requests`` as for ``retrieve``, ``results`` from it.  Results in order as a
    JSON array with status 200; a bad request 400 and its message; a search
    without hits 200 and an empty array; a response of which nothing came in time
    500 and a message.
    """
    waiting = (F.col("request_status") == S.FAILED) & F.col("http_status_message").eqNullSafe(S.MSG_TIMED_OUT)
    # read for the state of each response and for its body; pages are worked on once
    rows = staged(
        results.select(
            F.col("request_id").alias("response_id"),
            "unique_key",
            F.col("position").alias("rank"),
            _record(results).alias("record"),
            waiting.alias("waiting"),
            (F.col("request_status") == S.HANDLED).alias("handled"),
        ),
        "response-rows",
    )
    state = rows.groupBy("response_id").agg((F.some("handled") | ~F.some("waiting")).alias("answered"))
    rows = rows.join(state, "response_id")
    nothing = state.filter("NOT answered").select(
        "response_id", F.lit(500).alias("http_status"), F.lit(S.MSG_TIMED_OUT).alias("error")
    )
    without = requests.join(state, requests["request_id"] == state["response_id"], "left_anti").select(
        F.col("request_id").alias("response_id"),
        F.when(F.col("error").isNotNull(), 400).otherwise(200).alias("http_status"),
        "error",
    )
    answered = rows.filter("answered")
    return responses.response_json(answered, F.col("record"), nothing.unionByName(without)).withColumnRenamed(
        "response_id", "request_id"
    )
