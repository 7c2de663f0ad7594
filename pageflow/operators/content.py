"""Fetched pages to result records: metadata, clean HTML, text, Markdown.

A fetched page is (url, loaded_url, status, content_type, html, loaded_at)
plus whatever its request carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow import schemas, settings as S
from pageflow.functions import render, selectors as css, text as native
from pageflow.functions.bind import bind
from pageflow.functions.dom import html_events
from pageflow.functions.running import running_sums
from pageflow.operators import latency


def has_readable_type(content_type: Column) -> Column:
    return F.coalesce(content_type.rlike("text|html|xml"), F.lit(False))


def _with_events(df: DataFrame) -> DataFrame:
    """The page's tree events as ``_events``, made once for all that needs them."""
    return df if "_events" in df.columns else df.withColumn("_events", html_events(F.col("html")))


def _first(events: Column, fits) -> Column:
    return F.get(F.filter(events, lambda e: e["kind"].isin("open", "void") & fits(e)), F.lit(0))


def with_metadata(df: DataFrame) -> DataFrame:
    """Title, description, author and language of the page as fetched, from its tree.

    The first title's text as it stands; the content of the first ``meta`` of
    that name; empty values are missing.  The events stay for ``with_content``.
    """
    events = F.col("_events")

    def meta(name: str) -> Column:
        return F.nullif(_first(events, lambda e: (e["tag"] == "meta") & (e["attrs"]["name"] == name))["attrs"]["content"], F.lit(""))

    title = _first(events, lambda e: e["tag"] == "title")
    return _with_events(df).withColumns(
        {
            "title": F.coalesce(bind(title, lambda t: F.when(t.isNotNull(), css.text_of(css.subtree(events, t)))), F.lit("")),
            "description": meta("description"),
            "author": meta("author"),
            "language_code": F.nullif(_first(events, lambda e: e["tag"] == "html")["attrs"]["lang"], F.lit("")),
        }
    )


# -- built-in functions only: removal by tag name ---------------------------


def native_body(html: Column, tags: tuple[str, ...] = native.REMOVED_TAGS) -> Column:
    return native.remove_tags(native.body_of(html), tags)


def native_document(html: Column, tags: tuple[str, ...] = native.REMOVED_TAGS) -> Column:
    return native.simplified_document(native.all_titles(html), native_body(html, tags), html)


def text_or_raw(html: Column, max_chars: int = S.MAX_HTML_CHARS) -> Column:
    """Laid-out text; the bare text of pages above the size limit."""
    return F.when(F.length(html) > max_chars, native.raw_text(html)).otherwise(native.layout(html))


# -- tree: removal by selector, Markdown, main content ----------------------


def _title_of(events: Column) -> Column:
    titles = css.matching(events, "title")
    joined = F.array_join(F.transform(titles, lambda t: css.text_of(css.subtree(events, t))), "")
    return F.trim(F.regexp_replace(joined, render.BLANKS, " "))


def block_score(block: Column) -> Column:
    """Weight of a block as a sign of prose; short blocks do not count."""
    length = F.length(block["text"])
    commas = F.length(block["text"]) - F.length(F.replace(block["text"], F.lit(","), F.lit("")))
    score = 1.0 + commas + F.least(F.floor(length / 100), F.lit(3))
    return F.when(length >= 25, score).otherwise(F.lit(0.0))


def _by_id(page_blocks: Column, value) -> Column:
    """Running sums of a block's value, at each id up to the last block's; ids of a page are places."""

    def gap(b: Column, i: Column) -> Column:
        before = F.coalesce(F.get(page_blocks, i - 1)["id"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), b["id"] - before - 1), F.array(value(b).cast("long")))

    return running_sums(F.flatten(F.transform(page_blocks, gap)))


def _votes(page_blocks: Column) -> Column:
    """(element, votes) for each parent and grandparent of a block that counts; equal elements stand together when sorted."""
    voting = F.filter(page_blocks, lambda b: b["score"] > 0)
    cast = lambda name, share: F.transform(
        voting, lambda b: F.struct(b[name].alias("element"), (b["score"] * share).alias("votes"))
    )
    every = F.concat(cast("parent", 1.0), cast("grand", 0.5))
    ordered = F.array_sort(F.filter(every, lambda v: v["element"] >= 0))

    def summed(votes: Column) -> Column:
        places = F.transform(votes, lambda v, i: F.when((i == 0) | (v["element"] != F.get(votes, i - 1)["element"]), i))

        def each(starts: Column) -> Column:
            def run(at: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(votes))
                total = F.aggregate(F.slice(votes, at + 1, end - at), F.lit(0.0), lambda acc, v: acc + v["votes"])
                return F.struct(F.get(votes, at)["element"].alias("element"), total.alias("votes"))

            return F.transform(starts, run)

        return bind(F.filter(places, lambda i: i.isNotNull()), each)

    return bind(ordered, summed)


def main_element(page_blocks: Column, events: Column) -> Column:
    """Id of the element whose blocks score best, NULL on a page without prose.

    A block's score goes to its parent in full and to its grandparent by half;
    the sum shrinks with the share of link text below the element.  Ids are in
    document order, so what lies below an element is a stretch of running sums,
    two look-ups however large it is.
    """
    scored = F.transform(
        page_blocks,
        lambda b: F.struct(
            b["id"].alias("id"),
            b["parent"].alias("parent"),
            b["grand"].alias("grand"),
            F.length(b["text"]).alias("chars"),
            b["link_chars"].alias("link_chars"),
            block_score(b).alias("score"),
        ),
    )

    def best(rows: Column) -> Column:
        def weighed(sums: Column) -> Column:
            def below(values: Column, element: Column) -> Column:
                last = F.least(F.get(events, element)["last"], F.size(values) - 1)
                return (F.get(values, last) - F.coalesce(F.get(values, element - 1), F.lit(0))).cast("double")

            def weight(v: Column) -> Column:
                chars, links = below(sums["chars"], v["element"]), below(sums["links"], v["element"])
                density = F.when(chars > 0, links / chars).otherwise(F.lit(0.0))
                return F.struct((v["votes"] * (1 - density)).alias("score"), (-v["element"]).alias("order"))

            return F.transform(sums["votes"], weight)

        sums = F.struct(
            _by_id(rows, lambda b: b["chars"]).alias("chars"),
            _by_id(rows, lambda b: b["link_chars"]).alias("links"),
            _votes(rows).alias("votes"),
        )
        return -F.array_max(bind(sums, weighed))["order"]

    return bind(scored, best)


def _main_content(
    kept: Column, events: Column, title: Column, threshold: Column, settings: S.ContentSettings
) -> Column:
    """Main content under its title as HTML and Markdown; NULL when too short.

    Too short means shorter than the threshold; such pages are used whole.
    """
    wants_markdown = "markdown" in settings.output_formats

    def written(main: Column) -> Column:
        heading = F.when(title != "", F.concat(F.lit("<h1>"), _escaped(title), F.lit("</h1>"))).otherwise("")
        html = F.concat(F.lit("<div>"), heading, render.to_html(main), F.lit("</div>"))

        def with_markdown(done: Column) -> Column:
            top = F.nullif(F.concat(F.lit("# "), render.escaped_line(title)), F.lit("# "))
            gfm = F.length(done) <= settings.max_gfm_chars
            markdown = _joined_markdown(top, main, events, gfm) if wants_markdown else F.lit(None).cast("string")
            return F.struct(done.alias("processed_html"), markdown.alias("markdown"))

        long_enough = F.length(native.tidy(css.text_of(main))) >= threshold
        return F.when(long_enough, bind(html, with_markdown))

    def taken(element: Column) -> Column:
        last = F.get(events, element)["last"]
        inner = F.filter(kept, lambda e: (e["id"] >= element) & (e["id"] <= last))
        return F.when(element.isNotNull(), bind(inner, written))

    return bind(
        render.blocks(kept, events, F.lit(True)),
        lambda b: F.when(F.size(b) > 0, bind(main_element(b, events), taken)),
    )


def _escaped(title: Column) -> Column:
    return F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _joined_markdown(lead: Column, kept: Column, events: Column, gfm: Column) -> Column:
    body = bind(render.blocks(kept, events, gfm), lambda b: render.to_markdown(b, gfm))
    parts = F.array(F.nullif(lead, F.lit("")), F.nullif(body, F.lit("")))
    return F.array_join(parts, "\n\n")


ROW_SETTINGS = ("remove_elements_css_selector", "html_transformer", "readable_char_threshold")


def with_content(df: DataFrame, settings: S.ContentSettings = S.ContentSettings()) -> DataFrame:
    """Add ``processed_html`` and the requested of ``text``, ``markdown``, ``html_out``.

    One tree walk per page; formats nobody asked for are not computed.  An
    unsupported selector raises here, before the job starts.  Rows may bring
    settings of their own in the columns of ``ROW_SETTINGS``; a selector there
    has the same grammar, and rows whose selector has not come out NULL.
    """
    events = F.col("_events")
    formats = settings.output_formats
    selector, transformer, threshold = (
        F.coalesce(F.col(c), F.lit(usual)) if c in df.columns else None
        for c, usual in zip(
            ROW_SETTINGS, (settings.remove_selector, settings.html_transformer, settings.readable_char_threshold)
        )
    )
    if threshold is None:
        threshold = F.lit(settings.readable_char_threshold)

    def whole(title: Column, kept: Column) -> Column:
        document = native.simplified_document(_escaped(title), render.to_html(kept), F.col("html"))

        def with_markdown(done: Column) -> Column:
            markdown = F.lit(None).cast("string")
            if "markdown" in formats:
                gfm = F.length(done) <= settings.max_gfm_chars
                markdown = _joined_markdown(render.escaped_line(title), kept, events, gfm)
            return F.struct(done.alias("processed_html"), markdown.alias("markdown"))

        return bind(document, with_markdown)

    def made(title: Column, kept: Column) -> Column:
        if transformer is None and settings.html_transformer != "readableText":
            return whole(title, kept)
        main = _main_content(kept, events, title, threshold, settings)
        if transformer is not None:
            main = F.when(transformer == "readableText", main)
        return F.coalesce(main, whole(title, kept))

    def removed(body: Column) -> Column:
        if selector is None:
            return css.without(body, settings.remove_selector, events)
        known = (selector == settings.remove_selector) | css.is_supported(selector)
        return F.when(known, css.without_column(body, selector, settings.remove_selector, events))

    kept = bind(render.body_events(events), removed)
    done = bind(
        _title_of(events), lambda title: bind(kept, lambda k: F.when(k.isNotNull(), made(title, k)))
    )
    df = _with_events(df).withColumn("_made", done)
    df = df.withColumn("processed_html", F.col("_made.processed_html"))
    if "markdown" in formats:
        df = df.withColumn("markdown", F.nullif(F.col("_made.markdown"), F.lit("")))
    if "text" in formats:
        df = df.withColumn("text", text_or_raw(F.col("processed_html"), settings.max_html_chars))
    if "html" in formats:
        df = df.withColumn("html_out", F.col("processed_html"))
    return df.drop("_events", "_made")


def blocks_table(df: DataFrame, key: str, settings: S.ContentSettings = S.ContentSettings()) -> DataFrame:
    """One row per block of each page, with its weight as prose."""
    events = F.col("_events")
    kept = bind(render.body_events(events), lambda body: css.without(body, settings.remove_selector, events))
    found = bind(kept, lambda k: render.blocks(k, events, F.lit(True)))
    return (
        _with_events(df)
        .select(key, F.posexplode(found).alias("block_no", "block"))
        .select(
            key,
            F.col("block_no").cast("bigint").alias("block_no"),
            "block.tag",
            F.col("block.elem").alias("elem"),
            F.col("block.parent").alias("parent"),
            F.col("block.grand").alias("grand"),
            "block.text",
            F.col("block.link_chars").cast("bigint").alias("link_chars"),
            block_score(F.col("block")).alias("score"),
        )
    )


# -- result records ---------------------------------------------------------

REQUEST_COLUMNS = ("response_id", "unique_key", "query", "created_at", "search_result")


def _formats(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    if "output_formats" not in df.columns:
        return F.col(name)
    asked = "html" if name == "html_out" else name
    return F.when(F.array_contains("output_formats", asked), F.col(name))


def _debug(df: DataFrame) -> Column:
    """Stage times of a handled page, for requests in debug mode; ``sent_at`` or else ``loaded_at`` ends them."""
    if "time_measures" not in df.columns or "debug_mode" not in df.columns:
        return F.lit(None).cast(schemas.DEBUG)
    tool = F.col("scraping_tool") if "scraping_tool" in df.columns else F.lit(S.DEFAULT_SCRAPING_TOOL)
    end = F.unix_micros("sent_at" if "sent_at" in df.columns else "loaded_at")
    return latency.debug_of(latency.sent(F.col("time_measures"), tool, end), F.col("debug_mode"))


def _crawl(status: Column, message: Column, outcome: str, debug: Column | None = None) -> Column:
    return F.struct(
        F.col("created_at").alias("created_at"),
        status.cast("int").alias("http_status_code"),
        message.alias("http_status_message"),
        F.col("loaded_at").alias("loaded_at"),
        F.lit(outcome).alias("request_status"),
        F.col("unique_key").alias("unique_key"),
        (F.lit(None).cast(schemas.DEBUG) if debug is None else debug).alias("debug"),
    )


def _metadata(**known: Column) -> Column:
    none = F.lit(None).cast("string")
    names = ("title", "url", "redirected_url", "description", "author", "language_code")
    return F.struct(*[known.get(n, none).alias(n) for n in names])


def handled_records(df: DataFrame) -> DataFrame:
    """Records of pages that went through ``with_metadata`` and ``with_content``."""
    return df.select(
        "response_id",
        "unique_key",
        "query",
        _formats(df, "text").alias("text"),
        _formats(df, "html_out").alias("html"),
        _formats(df, "markdown").alias("markdown"),
        _crawl(F.col("status"), F.lit("OK"), S.HANDLED, _debug(df)).alias("crawl"),
        "search_result",
        _metadata(
            title=F.col("title"),
            url=F.col("url"),
            redirected_url=F.col("loaded_url"),
            description=F.col("description"),
            author=F.col("author"),
            language_code=F.col("language_code"),
        ).alias("metadata"),
    )


def skipped_records(df: DataFrame) -> DataFrame:
    """Records of pages whose content type cannot be read."""
    return df.select(
        "response_id",
        "unique_key",
        "query",
        F.lit("").alias("text"),
        _crawl(F.col("status"), F.lit(S.MSG_UNPARSEABLE), S.FAILED).alias("crawl"),
        "search_result",
        _metadata(url=F.col("url")).alias("metadata"),
    )


def failed_records(df: DataFrame) -> DataFrame:
    """Records of requests that failed with ``error``; only those of a response."""
    return df.filter(F.coalesce(F.col("response_id"), F.lit("")) != "").select(
        "response_id",
        "unique_key",
        F.lit("").alias("text"),
        _crawl(F.lit(500), F.col("error"), S.FAILED).alias("crawl"),
        "search_result",
        _metadata(url=F.col("url"), title=F.lit("")).alias("metadata"),
    )


def all_records(df: DataFrame, extract) -> DataFrame:
    """Handled, skipped and failed records of fetched pages in one schema.

    ``extract`` adds metadata and content; it only sees readable pages, so
    that nothing else reaches the tree walk.
    """
    failed = F.col("error").isNotNull()
    readable = has_readable_type(F.col("content_type"))
    return (
        handled_records(extract(df.filter(~failed & readable)))
        .unionByName(skipped_records(df.filter(~failed & ~readable)), allowMissingColumns=True)
        .unionByName(failed_records(df.filter(failed)), allowMissingColumns=True)
    )
