"""Search results out of result-page HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow import settings as S
from pageflow.functions import selectors as css
from pageflow.functions.bind import bind
from pageflow.functions.dom import html_events
from pageflow.operators.hits import deduplicate, valid_results


def _result(events: Column, element: Column) -> Column:
    """Title, description and link of one result element, menus left out."""

    def read(inner: Column) -> Column:
        heading = F.get(F.filter(inner, lambda e: (e["tag"] == "h3") & (e["kind"] == "open")), F.lit(0))
        link = F.get(F.filter(inner, lambda e: (e["tag"] == "a") & (e["kind"] == "open")), F.lit(0))
        described = F.transform(
            css.matching(inner, S.SERP_DESCRIPTION_SELECTOR), lambda d: css.text_of(css.inside(inner, d))
        )
        return F.struct(
            bind(heading, lambda h: F.when(h.isNotNull(), css.text_of(css.inside(inner, h)))).alias("title"),
            F.regexp_replace(F.array_join(described, ""), r"^\s+|\s+$", "").alias("description"),
            link["attrs"]["href"].alias("url"),
        )

    return bind(css.subtree(events, element), lambda whole: bind(css.without(whole, S.SERP_DROP_SELECTOR), read))


def extract_results(serp_pages: DataFrame) -> DataFrame:
    """Every result element of every result page, in page order.

    The suggestion mark belongs to the page and goes to each of its results.
    """
    events = F.col("events")
    results = F.transform(
        css.matching(events, ", ".join(S.SERP_RESULT_SELECTORS)), lambda element: _result(events, element)
    )
    suggested = F.size(css.matching(events, S.SERP_SUGGESTION_SELECTOR)) > 0
    return (
        serp_pages.withColumn("events", html_events(F.col("html")))
        .select(
            "query_id",
            "page",
            F.when(suggested, "SUGGESTED").otherwise("ORGANIC").alias("result_type"),
            results.alias("results"),
        )
        # the events stay behind: only results are multiplied into rows
        .select("query_id", "page", "result_type", F.posexplode("results").alias("pos", "result"))
        .select("query_id", "page", "pos", "result.*", "result_type")
    )


def organic_results(serp_pages: DataFrame) -> DataFrame:
    """Valid, distinct results per result page."""
    return deduplicate(valid_results(extract_results(serp_pages)), "query_id", "page")
