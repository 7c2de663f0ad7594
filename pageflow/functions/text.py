"""HTML to text with built-in functions only.

The removals here are by tag name and assume that an element does not nest in
one of its own kind; pages for which that matters go through ``functions.dom``
first, whose output these functions then lay out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without readable text, elements that start a line and
# the entities decoded here (``&amp;`` last, so that nothing is decoded twice).
SILENT_TAGS = ("script", "style", "noscript", "svg", "canvas", "title")
LINE_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|"
    "th|thead|tr|ul"
)
ENTITIES = (
    ("nbsp", " "),
    ("lt", "<"),
    ("gt", ">"),
    ("quot", '"'),
    ("#39", "'"),
    ("copy", "©"),
    ("reg", "®"),
    ("middot", "·"),
    ("amp", "&"),
)
REMOVED_TAGS = ("script", "style", "noscript", "svg", "nav", "footer")

COMMENT = r"(?s)<!--.*?-->"
BODY = r"(?is)<body[^>]*>(.*?)(?:</body\s*>|\z)"


def element_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)"


def remove_tags(html: Column, tags: tuple[str, ...]) -> Column:
    html = F.regexp_replace(html, COMMENT, "")
    for tag in tags:
        html = F.regexp_replace(html, element_pattern(tag), "")
    return html


def body_of(html: Column) -> Column:
    """Inner HTML of the body; NULL where a page has none."""
    return F.when(html.rlike(r"(?i)<body\b"), F.regexp_extract(html, BODY, 1))


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.regexp_replace(text, f"&{name};?", char)
    return text


def strip_markup(html: Column) -> Column:
    return decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", ""))


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def tidy(text: Column) -> Column:
    """One blank between words, at most one empty line, no blanks at line ends."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\f\x0B\x{a0}]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return trim_blank(text)


def layout(html: Column) -> Column:
    """Readable text of an HTML fragment, one line per block."""
    html = remove_tags(html, SILENT_TAGS)
    html = F.regexp_replace(html, rf"(?is)</?(?:{LINE_TAGS})(?:\s[^>]*|/)?>", "\n")
    return tidy(strip_markup(html))


def raw_text(html: Column) -> Column:
    """All text nodes without layout, for pages above the size limit."""
    return strip_markup(F.regexp_replace(html, COMMENT, ""))


def page_title(html: Column) -> Column:
    """Text of the first title element, as a browser tab shows it."""
    return tidy(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))


def all_titles(html: Column) -> Column:
    """Inner HTML of every title element, joined."""
    titles = F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title\s*>"), F.lit(1))
    return trim_blank(F.array_join(titles, ""))


def meta_content(html: Column, name: str) -> Column:
    """``content`` of the first meta element with the name, NULL if absent."""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\bname\s*=\s*["']?{name}["'\s/>][^>]*>""", 0)
    value = F.coalesce(
        F.nullif(F.regexp_extract(tag, r'(?is)\bcontent\s*=\s*"([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*'([^']*)'", 1), F.lit("")),
    )
    return decode_entities(value)


def language_of(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([^"'\s>]+)""", 1), F.lit(""))


def simplified_document(title: Column, body: Column, html: Column) -> Column:
    """The cleaned page as a document; without a body the page as it came."""
    return F.coalesce(
        F.concat(
            F.lit('<html lang=""><head><title>'),
            title,
            F.lit("</title></head><body>"),
            trim_blank(body),
            F.lit("</body></html>"),
        ),
        html,
        F.lit(""),
    )
