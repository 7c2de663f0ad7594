"""Requests: parse, check, route, and plan the search pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow import settings as S
from pageflow.functions import urls


def stable_id(*parts: Column) -> Column:
    """An id of 128 bits that is the same whenever the same request is planned again.

    Parts carry their length and a NULL its own mark, so no two lists of parts
    are written alike.
    """
    texts = [p.cast("string") for p in parts]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.substring(F.sha2(F.concat_ws("|", *marked), 256), 1, 32)


# -- typed records ---------------------------------------------------------

# columns of a typed request -> the parameter that ``validate`` reads
TYPED = {
    "query": "query",
    "max_results": "maxResults",
    "output_formats": "outputFormats",
    "request_timeout_secs": "requestTimeoutSecs",
    "remove_elements_css_selector": "removeElementsCssSelector",
    "html_transformer": "htmlTransformer",
    "serp_proxy_group": "serpProxyGroup",
    "serp_max_retries": "serpMaxRetries",
    "scraping_tool": "scrapingTool",
    "max_request_retries": "maxRequestRetries",
    "dynamic_content_wait_secs": "dynamicContentWaitSecs",
    "desired_concurrency": "desiredConcurrency",
    "proxy_configuration": "proxyConfiguration",
    "readable_text_char_threshold": "readableTextCharThreshold",
    "remove_cookie_warnings": "removeCookieWarnings",
    "debug_mode": "debugMode",
}


def from_typed(df: DataFrame) -> DataFrame:
    """Typed request records as parsed parameters, ready for ``validate``.

    Parameters that the record does not have are missing and get their defaults.
    """
    given = {parameter: column for column, parameter in TYPED.items() if column in df.columns}
    empty = {n: F.lit(None).cast("array<string>" if n == "outputFormats" else "string") for n in S.PARAMETER_NAMES}
    parameters = [
        (F.col(given[n]) if n == "outputFormats" else F.col(given[n]).cast("string")).alias(n) if n in given else empty[n].alias(n)
        for n in S.PARAMETER_NAMES
    ]
    kept = [c for c in df.columns if c not in TYPED and c not in S.PARAMETER_NAMES]
    return df.select(*kept, *parameters)


# -- query strings ----------------------------------------------------------


def parse_parameters(df: DataFrame, query_string: str = "raw") -> DataFrame:
    """Add one column per known parameter of a ``?a=1&b=2`` string.

    Values stay strings but for ``outputFormats`` (array).  Unknown names are
    dropped; of a repeated name the first value counts.  Works within the row.
    """
    text = F.regexp_replace(F.col(query_string), r"^\?", "")
    pairs = F.transform(
        F.filter(F.split(text, "&"), lambda p: p != ""),
        lambda p: F.struct(
            urls.decode_form(F.substring_index(p, "=", 1)).alias("name"),
            urls.decode_form(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    df = df.withColumn("_pairs", pairs)

    def value(name: str) -> Column:
        return F.get(F.filter("_pairs", lambda p: p["name"] == name), F.lit(0))["value"]

    raw_formats = value("outputFormats")
    listed = F.transform(F.split(raw_formats, ","), lambda f: F.trim(f))
    as_json = F.from_json(raw_formats, "array<string>", {"mode": "PERMISSIVE"})
    proxy = value("proxyConfiguration")
    columns = {name: value(name) for name in S.PARAMETER_NAMES}
    columns["outputFormats"] = F.when(raw_formats.rlike(r"^\s*\["), F.coalesce(as_json, listed)).otherwise(listed)
    columns["proxyConfiguration"] = F.when(F.try_parse_json(proxy).isNotNull(), proxy)
    return df.withColumns(columns).drop("_pairs")


# -- defaults and bounds ----------------------------------------------------


def _number(col: Column) -> Column:
    """A number as the reader of a query string takes it: blank counts as 0."""
    return F.when(F.trim(col) == "", F.lit(0.0)).otherwise(col.try_cast("double"))


def bounded(col: Column, name: str) -> Column:
    low, high, default = S.NUMBER_BOUNDS[name]
    number = _number(col)
    usable = number.isNotNull() & ~F.isnan(number)
    clamped = F.greatest(F.least(number, F.lit(float(high))), F.lit(float(low)))
    return F.when(usable, F.floor(clamped)).otherwise(F.lit(default)).cast("bigint")


def _flag(col: Column, default: bool) -> Column:
    return F.coalesce(F.lower(F.trim(col)).try_cast("boolean"), F.lit(default))


def validate(df: DataFrame) -> DataFrame:
    """Typed request columns from parsed parameters, plus an ``error`` column.

    Bad numbers fall back to the default and are listed in ``replaced``; wrong
    choices and an empty query are errors of the row, never of the job.
    """
    timeout = bounded(F.col("requestTimeoutSecs"), "requestTimeoutSecs")
    wait = F.floor(_number(F.col("dynamicContentWaitSecs"))).cast("bigint")
    half = F.floor(timeout / 2 + 0.5).cast("bigint")
    formats = F.when(
        F.col("outputFormats").isNull() | (F.size("outputFormats") == 0),
        F.array(*map(F.lit, S.DEFAULT_OUTPUT_FORMATS)),
    ).otherwise(F.col("outputFormats"))
    allowed = F.array(*map(F.lit, S.OUTPUT_FORMATS))

    def chosen(name: str, default: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(default)).otherwise(F.col(name))

    group = chosen("serpProxyGroup", S.SERP_PROXY_GROUPS[0])
    tool = chosen("scrapingTool", S.DEFAULT_SCRAPING_TOOL)
    error = (
        F.when(F.coalesce(F.col("query"), F.lit("")) == "", S.MSG_EMPTY_QUERY)
        .when(F.size(F.array_except(formats, allowed)) > 0, S.MSG_OUTPUT_FORMATS)
        .when(~group.isin(*S.SERP_PROXY_GROUPS), S.MSG_PROXY_GROUP)
        .when(~tool.isin(*S.SCRAPING_TOOLS), S.MSG_SCRAPING_TOOL)
    )
    replaced = F.concat_ws(
        ",",
        *[
            F.when(F.col(n).isNotNull() & _number(F.col(n)).isNull(), n)
            for n in S.NUMBER_BOUNDS
        ],
    )
    selector = chosen("removeElementsCssSelector", S.DEFAULT_REMOVE_SELECTOR)
    return df.withColumns(
        {
            "max_results": bounded(F.col("maxResults"), "maxResults"),
            "output_formats": formats,
            "request_timeout_secs": timeout,
            "serp_proxy_group": group,
            "serp_max_retries": bounded(F.col("serpMaxRetries"), "serpMaxRetries"),
            "scraping_tool": tool,
            "remove_elements_css_selector": selector,
            "html_transformer": chosen("htmlTransformer", "none"),
            "max_request_retries": bounded(F.col("maxRequestRetries"), "maxRequestRetries"),
            "desired_concurrency": F.floor(_number(F.col("desiredConcurrency"))).cast("bigint"),
            "readable_char_threshold": F.coalesce(
                F.floor(_number(F.col("readableTextCharThreshold"))).cast("bigint"), F.lit(100)
            ),
            "dynamic_content_wait_secs": F.when((wait > 0) & (wait < timeout), wait).otherwise(half),
            "remove_cookie_warnings": _flag(F.col("removeCookieWarnings"), True),
            "debug_mode": _flag(F.col("debugMode"), False),
            "replaced": replaced,
            "error": error,
        }
    ).drop(*[n for n in S.PARAMETER_NAMES if n not in ("query", "token")])


# -- routing ----------------------------------------------------------------


def route(df: DataFrame, query: str = "query") -> DataFrame:
    """Direct page requests and searches, told apart by the query string."""
    df = df.withColumn("as_url", urls.interpret_as_url(F.col(query)))
    return df.withColumns(
        {
            "route": F.when(F.col("as_url").isNotNull(), "url").otherwise("search"),
            "target": F.coalesce(F.col("as_url"), F.col(query)),
        }
    ).drop("as_url")


def total_pages(max_results: Column) -> Column:
    """Result pages to plan: one more than a full page each would need."""
    return (F.ceil(max_results / S.RESULTS_PER_PAGE) + 1).cast("bigint")


def search_page_plan(df: DataFrame, query: str = "query") -> DataFrame:
    """One row per result page a search may read."""
    scheme = F.when(F.col("serp_proxy_group") == S.SERP_PROXY_GROUPS[0], "http").otherwise("https")
    df = df.withColumns(
        {
            "total_pages": total_pages(F.col("max_results")),
            "_base": F.concat(scheme, F.lit(S.SEARCH_ADDRESS), urls.encode_uri(F.col(query))),
        }
    )
    df = df.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("total_pages") - 1)))
    start = F.col("page") * S.RESULTS_PER_PAGE
    offset = F.when(F.col("page") > 0, F.concat(F.lit("&start="), start)).otherwise("")
    return df.withColumn("search_url", F.concat("_base", offset)).drop("_base")
