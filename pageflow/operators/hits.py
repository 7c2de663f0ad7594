"""Search results: filter, de-duplicate, paginate, rank, and page requests.

A hit is (query_id, page, pos, title, description, url, result_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow import settings as S
from pageflow.functions import urls
from pageflow.operators.requests import stable_id, total_pages


def valid_results(hits: DataFrame) -> DataFrame:
    """Hits that have a title and a link worth fetching."""
    return hits.filter((F.col("title") != "") & urls.is_result_url(F.col("url")))


def deduplicate(hits: DataFrame, *within: str) -> DataFrame:
    """Keep the first hit per title and URL (and ``within`` columns).

    The filter on the row number lets Spark keep one row per key before the
    shuffle, so a result that recurs in a third of the rows costs one row per
    task.  A missing title is a value like any other.
    """
    order = [F.col("page"), F.col("pos")]
    first = Window.partitionBy(*within, "title", "url").orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def ranked(hits: DataFrame, max_results: Column, most: int | None = None) -> DataFrame:
    """The first ``max_results`` hits of each query, ranked 1..n.

    ``most``: a bound of ``max_results`` that the caller has checked; with it
    each task cuts to that many rows per query before the shuffle.
    """
    by_query = Window.partitionBy("query_id").orderBy("page", "pos", "title", "url")
    out = hits.withColumn("rank", F.row_number().over(by_query))
    if most is not None:
        out = out.filter(F.col("rank") <= most)
    return out.filter(F.col("rank") <= max_results)


def paginate(hits: DataFrame, searches: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Final hits per query and the number of result pages read.

    ``searches`` is (query_id, max_results); ``most`` as in ``ranked``.  Reading stops at the first page
    without valid hits, at the planned number of pages, or once enough
    distinct hits are there; the last rule cannot change which hits come
    first, so the hits need only the other two.
    """
    planned = searches.select("query_id", total_pages(F.col("max_results")).alias("planned_pages"))
    found = valid_results(hits).join(planned, "query_id").filter("page < planned_pages").drop("planned_pages")
    # pages 0, 1, 2 ... without a gap: the first missing page is the first
    # whose place in the sorted list of planned pages is not its number
    pages_seen = found.groupBy("query_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    gap = F.filter(F.transform("pages", lambda p, i: F.when(p != i, i)), lambda i: i.isNotNull())
    stops = searches.join(pages_seen, "query_id", "left").select(
        "query_id",
        "max_results",
        total_pages(F.col("max_results")).alias("total_pages"),
        F.coalesce(F.get(gap, F.lit(0)), F.array_size("pages"), F.lit(0)).cast("bigint").alias("first_empty"),
    )

    readable = found.join(stops, "query_id").filter(
        (F.col("page") < F.col("first_empty")) & (F.col("page") < F.col("total_pages"))
    )
    unique = deduplicate(readable, "query_id")
    final = ranked(unique, F.col("max_results"), most)

    # the page of the last wanted hit is the page where reading stopped
    enough = final.filter("rank = max_results").select("query_id", F.col("page").alias("enough_at"))
    pages_read = stops.join(enough, "query_id", "left").select(
        "query_id",
        F.least(
            F.coalesce(F.col("enough_at") + 1, F.col("total_pages")),
            F.col("first_empty") + 1,
            F.col("total_pages"),
        ).cast("bigint").alias("pages_read"),
    )
    return final.drop("total_pages", "first_empty", "max_results"), pages_read


def page_requests(final: DataFrame, *carried: str, keys: list[str] = []) -> DataFrame:
    """One page request per ranked hit; keeps the hit only if it is complete.

    ``keys``: columns that tell hits of one title and URL apart.
    """
    hit = F.struct("title", "description", "url", F.col("rank").cast("bigint").alias("rank"), "result_type")
    response_id = stable_id(F.lit("response"), F.col("query_id"))
    return final.select(
        "query_id",
        response_id.alias("response_id"),
        stable_id(F.lit("page"), F.col("query_id"), F.col("title"), F.col("url"), *[F.col(c) for c in keys]).alias("unique_key"),
        "url",
        F.when(F.col("url").isNotNull() & F.col("title").isNotNull(), hit).alias("search_result"),
        *carried,
    )


def empty_searches(searches: DataFrame, final: DataFrame) -> DataFrame:
    """Searches without a single hit; their response is an empty list."""
    return searches.join(final, "query_id", "left_anti")
