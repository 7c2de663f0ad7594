"""Clean HTML, blocks and Markdown from an event array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageflow.functions.bind import bind
from pageflow.functions.dom import BLOCK

# Markers that stand for inline marks until blanks around them are settled.
# HTML text cannot hold these control characters.
STRONG, EM, STRIKE, BREAK = ("\x01", "\x02"), ("\x03", "\x04"), ("\x05", "\x06"), "\x07"
MARKERS = "".join(STRONG + EM + STRIKE + (BREAK,))

# Markdown's marks and the characters it escapes.
MARK_TAGS = ((("b", "strong"), STRONG), (("i", "em"), EM), (("del", "s", "strike"), STRIKE))
MARK_TEXT = ((STRONG, "**"), (EM, "_"), (STRIKE, "~~"))
ESCAPED = r"([\\*`\[\]_])"
ESCAPED_START = r"^(#{1,6} |>|-|\+ |=+|~~~)"
ESCAPED_NUMBER = r"^(\d+)\. "
FENCE = "```"
BLANKS = r"[ \t\r\n\f]+"


def body_events(events: Column) -> Column:
    """Events inside the body element."""
    bodies = F.filter(events, lambda e: (e["tag"] == "body") & (e["kind"] == "open"))
    return bind(
        F.get(bodies, F.lit(0)),
        lambda body: F.filter(events, lambda e: (body["id"] < e["id"]) & (e["id"] < body["last"])),
    )


def _escape_text(text: Column) -> Column:
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _start_tag(event: Column) -> Column:
    attrs = F.transform(
        F.map_entries(event["attrs"]),
        lambda a: F.concat(
            F.lit(" "), a["key"], F.lit('="'), F.replace(_escape_text(a["value"]), F.lit('"'), F.lit("&quot;")),
            F.lit('"'),
        ),
    )
    return F.concat(F.lit("<"), event["tag"], F.array_join(attrs, ""), F.lit(">"))


def to_html(events: Column) -> Column:
    """Well-formed HTML: every element closed, every bare character escaped."""
    return F.array_join(
        F.transform(
            events,
            lambda e: F.when(e["kind"] == "text", _escape_text(e["text"]))
            .when(e["kind"] == "close", F.concat(F.lit("</"), e["tag"], F.lit(">")))
            .otherwise(_start_tag(e)),
        ),
        "",
    )


def _inline(event: Column, all_events: Column, gfm: Column) -> Column:
    """What one event contributes to the Markdown of its block."""
    attrs, tag, kind = event["attrs"], event["tag"], event["kind"]
    in_code = F.get(all_events, event["parent"])["tag"] == "code"
    clean = F.translate(event["text"], MARKERS, "")
    piece = F.when(
        kind == "text",
        F.when(event["pre"], clean)
        .when(in_code, F.regexp_replace(clean, BLANKS, " "))
        .otherwise(F.regexp_replace(F.regexp_replace(clean, BLANKS, " "), ESCAPED, r"\\$1")),
    )
    for tags, (start, end) in MARK_TAGS:
        shown = tag.isin(*tags) & ~event["pre"]
        if tags[0] == "del":
            shown = shown & gfm
        piece = piece.when(shown, F.when(kind == "open", F.lit(start)).otherwise(F.lit(end)))
    link_end = F.concat(F.lit("]("), attrs["href"], F.lit(")"))
    return (
        piece.when(tag == "br", F.when(event["pre"], F.lit("\n")).otherwise(F.lit(BREAK)))
        .when((tag == "code") & ~event["pre"], F.lit("`"))
        .when((tag == "a") & (attrs["href"] != ""), F.when(kind == "open", F.lit("[")).otherwise(link_end))
        .when((tag == "img") & (attrs["src"] != ""),
              F.concat(F.lit("!["), F.coalesce(attrs["alt"], F.lit("")), F.lit("]("), attrs["src"], F.lit(")")))
        .when((tag == "input") & (attrs["type"] == "checkbox") & gfm,
              F.when(attrs["checked"].isNotNull(), F.lit("[x] ")).otherwise(F.lit("[ ] ")))
        .when(_inner_block(event), F.lit(" "))
        .otherwise(F.lit(""))
    )


def _inner_block(event: Column) -> Column:
    """Blocks inside a table cell part its words but do not end its line."""
    return event["tag"].isin(*sorted(BLOCK)) & ~event["edge"]


def _plain(run: Column) -> Column:
    pieces = F.transform(
        run,
        lambda e: F.when(e["kind"] == "text", e["text"])
        .when((e["tag"] == "br") | _inner_block(e), F.lit(" "))
        .otherwise(F.lit("")),
    )
    return F.trim(F.regexp_replace(F.array_join(pieces, ""), BLANKS, " "))


def _settle(text: Column) -> Column:
    """Move blanks out of marks, drop empty marks, trim, then write the marks."""
    pairs = (STRONG, EM, STRIKE)
    starts, ends = "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)
    for mark in starts + ends:  # a mark right inside the same mark adds nothing
        text = F.regexp_replace(text, f"{mark}{{2,}}", mark)
    text = F.regexp_replace(text, f"([{starts}]+)([ {BREAK}]+)", "$2$1")
    text = F.regexp_replace(text, f"([ {BREAK}]+)([{ends}]+)", "$2$1")
    for start, end in pairs:
        text = F.replace(text, F.lit(start + end), F.lit(""))
    text = F.regexp_replace(text, f" *{BREAK}[ {BREAK}]*", BREAK)
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.regexp_replace(text, f"^[ {BREAK}]+|[ {BREAK}]+$", "")
    text = F.regexp_replace(text, ESCAPED_START, r"\\$1")
    text = F.regexp_replace(text, ESCAPED_NUMBER, r"$1\\. ")
    for (start, end), mark in MARK_TEXT:
        text = F.replace(F.translate(text, end, start), F.lit(start), F.lit(mark))
    return F.replace(text, F.lit(BREAK), F.lit("  \n"))


def _block(events: Column, all_events: Column, start: Column, end: Column, gfm: Column) -> Column:
    """One block: the run of kept events from ``start`` up to ``end``."""
    at = lambda ident: F.get(all_events, ident)

    def described(run: Column) -> Column:
        first = F.get(run, F.lit(0))
        holder = at(first["block"])
        linked = F.filter(run, lambda e: e["linked"])
        classes = F.transform(
            run, lambda e: F.regexp_extract(F.coalesce(e["attrs"]["class"], F.lit("")), r"language-(\S+)", 1)
        )
        return F.struct(
            first["id"].alias("id"),
            F.when(first["tag"] == "hr", F.lit("hr")).when(first["pre"], F.lit("pre"))
            .otherwise(holder["tag"]).alias("tag"),
            (first["kind"] == "open").alias("opens"),
            holder["id"].alias("elem"),
            holder["parent"].alias("parent"),
            at(holder["parent"])["parent"].alias("grand"),
            first["item"].alias("item"),
            at(first["item"])["number"].alias("item_no"),
            at(first["item"])["parent"].alias("list"),
            first["lists"].alias("lists"),
            first["quotes"].alias("quotes"),
            holder["number"].alias("cell_no"),
            at(holder["parent"])["number"].alias("row_no"),
            F.array_join(F.transform(run, lambda e: _inline(e, all_events, gfm)), "").alias("inline"),
            _plain(run).alias("text"),
            F.length(_plain(linked)).alias("link_chars"),
            F.coalesce(F.get(F.filter(classes, lambda c: c != ""), F.lit(0)), F.lit("")).alias("language"),
        )

    return bind(F.slice(events, start + 1, end - start), described)


def blocks(events: Column, all_events: Column, gfm: Column) -> Column:
    """Runs of text between block boundaries, with what readers need to know.

    ``events`` are the ones kept, ``all_events`` the page's whole array, in
    which ids are places.
    """

    def cut(kept: Column) -> Column:
        places = F.transform(kept, lambda e, i: F.when(e["edge"] | (i == 0), i))
        starts = F.filter(places, lambda i: i.isNotNull())
        return bind(starts, lambda s: F.arrays_zip(
            s.alias("start"),
            F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(kept))).alias("end"),
        ))

    def described(kept: Column) -> Column:
        spans = F.when(F.size(kept) > 0, cut(kept))
        every = F.transform(spans, lambda s: _block(kept, all_events, s["start"], s["end"], gfm))
        return F.filter(
            every,
            lambda b: (b["text"] != "") | b["inline"].contains("![") | (b["tag"] == "hr")
            | (b["tag"].isin("td", "th") & b["opens"]),
        )

    return bind(F.filter(events, lambda e: ~e["quiet"]), described)


def _block_markdown(block: Column, before: Column, after: Column, gfm: Column) -> Column:
    """One block with its own marks and the separator in front of it."""
    tag, settled = block["tag"], _settle(block["inline"])
    one_line = F.regexp_replace(settled, r" *\n", " ")
    is_cell = tag.isin("td", "th") & gfm
    same_row = F.coalesce((before["parent"] == block["parent"]) & before["tag"].isin("td", "th"), F.lit(False))
    ends_row = ~F.coalesce((after["parent"] == block["parent"]) & after["tag"].isin("td", "th"), F.lit(False))
    first_of_item = (block["item"] >= 0) & (before["id"].isNull() | (before["id"] < block["item"]))
    code = F.regexp_replace(block["inline"], r"^\n|\s+$", "")
    marker = F.when(block["item_no"] > 0, F.concat(block["item_no"].cast("string"), F.lit(".  "))).otherwise("*   ")
    heading = tag.rlike("^h[1-6]$")

    body = (
        F.when(tag == "hr", F.lit("* * *"))
        .when(tag == "pre", F.concat(F.lit(FENCE), block["language"], F.lit("\n"), code, F.lit("\n" + FENCE)))
        .when(heading, F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), one_line))
        .when(
            is_cell,
            F.concat(
                F.when(same_row, F.lit(" ")).otherwise(F.lit("| ")),
                F.replace(one_line, F.lit("|"), F.lit(r"\|")),
                F.lit(" |"),
                F.when(ends_row & (block["row_no"] == 1),
                       F.concat(F.lit("\n"), F.repeat(F.lit("| --- "), block["cell_no"]), F.lit("|")))
                .otherwise(F.lit("")),
            ),
        )
        .otherwise(settled)
    )
    indent = F.greatest(block["lists"] - F.when(first_of_item, 1).otherwise(0), F.lit(0))
    indent = F.when(block["item"] >= 0, indent).otherwise(F.lit(0))
    body = F.concat(F.when(first_of_item, marker).otherwise(F.lit("")), body)
    pad = F.repeat(F.lit(" "), indent * 4)
    hang = F.repeat(F.lit(" "), (indent + F.when(first_of_item, 1).otherwise(0)) * 4)
    quote = F.repeat(F.lit("> "), block["quotes"])
    body = F.concat(quote, pad, F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), quote, hang)))
    body = F.when(is_cell & same_row, F.concat(F.lit(" "), F.ltrim(body))).otherwise(body)

    shared_quotes = F.rtrim(F.repeat(F.lit("> "), F.least(block["quotes"], before["quotes"])))
    in_list = first_of_item & (
        (before["id"] >= block["list"]) | ((before["item"] >= 0) & (before["lists"] < block["lists"]))
    )
    in_table = is_cell & before["tag"].isin("td", "th") & (before["row_no"] < block["row_no"])
    separator = (
        F.when(before["id"].isNull() | (is_cell & same_row), F.lit(""))
        .when(in_list | in_table, F.lit("\n"))
        .otherwise(F.concat(F.lit("\n"), shared_quotes, F.lit("\n")))
    )
    return F.concat(separator, body)


def to_markdown(page_blocks: Column, gfm: Column) -> Column:
    """Markdown of a page's blocks."""
    return F.array_join(
        F.transform(
            page_blocks,
            lambda b, i: _block_markdown(b, F.get(page_blocks, i - 1), F.get(page_blocks, i + 1), gfm),
        ),
        "",
    )


def escaped_line(text: Column) -> Column:
    """Plain text as one line of Markdown."""
    return _settle(F.regexp_replace(text, ESCAPED, r"\\$1"))
