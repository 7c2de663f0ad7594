"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageflow.functions.bind import bind
from pageflow.functions.hosts import ascii_host

# Characters a URI encoder leaves as they are, with the form
# encoder's spelling.  ``&`` and ``#`` are missing on purpose: left bare they
# would cut a phrase short.
URI_KEPT = {
    "%3B": ";",
    "%2C": ",",
    "%2F": "/",
    "%3F": "?",
    "%3A": ":",
    "%40": "@",
    "%3D": "=",
    "%24": "$",
    "%21": "!",
    "%27": "'",
    "%28": "(",
    "%29": ")",
    "%7E": "~",
}
# Further characters that stay as they are in a path or query of a URL.
PATH_KEPT = {"%23": "#", "%26": "&", "%5B": "[", "%5D": "]", "%7C": "|", "%5E": "^", "%2B": "+"}

_PARTS = (
    r"^(?i)(https?):[/\\]*"  # 1 scheme
    r"(?:([^/\\?#]*)@)?"  # 2 user info
    r"(\[[0-9a-f:.]+\]|[^/\\?#:@\[\]]+)"  # 3 host
    r"(?::([0-9]*))?"  # 4 port
    r"([/\\][^?#]*)?"  # 5 path
    r"(\?[^#]*)?"  # 6 query
    r"(#.*)?$"  # 7 fragment
)
_BAD_HOST = r"""[\x00-\x20"#/:<>?@\[\\\]^`{}|%\x7f]"""


def _restore(col: Column, kept: dict[str, str]) -> Column:
    for code, char in kept.items():
        col = F.replace(col, F.lit(code), F.lit(char))
    return col


def encode_uri(col: Column) -> Column:
    """Percent-encode a phrase for the query part of a search URL."""
    return _restore(F.replace(F.url_encode(col), F.lit("+"), F.lit("%20")), URI_KEPT)


def decode_component(col: Column) -> Column:
    """Percent-decode; ``+`` stays, malformed input gives NULL."""
    decoded = F.try_url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))
    broken_utf8 = (
        decoded.contains("\ufffd") & ~col.contains("\ufffd") & ~F.lower(col).contains("%ef%bf%bd")
    )
    return F.when(~broken_utf8, decoded)


def decode_form(col: Column) -> Column:
    """Form decoding: ``+`` is a space; malformed escapes stay as written."""
    return F.coalesce(F.try_url_decode(col), F.replace(col, F.lit("+"), F.lit(" ")))


def _escape_path(col: Column) -> Column:
    """Escape blanks, quotes, braces and non-ASCII; keep existing escapes."""
    encoded = F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))
    encoded = _restore(encoded, {**URI_KEPT, **PATH_KEPT})
    return F.when(
        col.rlike(r"""[^\x21-\x7e]|["<>`{}]"""), F.replace(encoded, F.lit("%25"), F.lit("%"))
    ).otherwise(col)


def _without_dot_segments(path: Column) -> Column:
    is_up = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    is_here = lambda s: F.lower(s).isin(".", "%2e")

    def walked(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(is_up(s), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(is_here(s), acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(segments, -1)
        tail = F.when(is_up(last) | is_here(last), F.lit("/")).otherwise(F.lit(""))
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
        return F.when(joined.endswith("/"), joined).otherwise(F.concat(joined, tail))

    return F.when(
        path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), bind(F.split(F.substring(path, 2, 1 << 30), "/"), walked)
    ).otherwise(path)


def _assembled(parts: Column) -> Column:
    """The URL from its seven parts, NULL if a part is not allowed."""
    scheme, plain = F.lower(parts[0]), F.lower(parts[2])
    # few hosts need more than lower case; a broken escape leaves none
    odd = plain.rlike(r"[^\x00-\x7f%]|%|(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
    return bind(F.when(odd, ascii_host(decode_component(plain))).otherwise(plain), lambda host: _joined(parts, scheme, host))


def _joined(parts: Column, scheme: Column, host: Column) -> Column:
    port = F.when(parts[3] != "", F.coalesce(F.nullif(F.ltrim(parts[3], F.lit("0")), F.lit("")), F.lit("0")))
    shown_port = F.when(port == F.when(scheme == "http", "80").otherwise("443"), None).otherwise(port)
    path = F.replace(parts[4], F.lit("\\"), F.lit("/"))
    valid = (host != "") & (host.startswith("[") | ~host.rlike(_BAD_HOST)) & (
        port.isNull() | ((F.length(port) <= 5) & (port.try_cast("int") <= 65535))
    )
    return F.when(
        valid,
        F.concat(
            scheme,
            F.lit("://"),
            F.when(parts[1] != "", F.concat(parts[1], F.lit("@"))).otherwise(""),
            host,
            F.coalesce(F.concat(F.lit(":"), shown_port), F.lit("")),
            bind(path, lambda p: F.when(p == "", "/").otherwise(
                bind(_without_dot_segments(p), lambda q: _escape_path(q)))),
            _escape_path(parts[5]),
            _escape_path(parts[6]),
        ),
    )


def http_url(col: Column) -> Column:
    """Normalised form of an http/https URL, NULL for anything else.

    Lower-cases scheme and host, drops the default port, resolves dot
    segments, escapes what may not stand bare and gives an empty path ``/``.
    """
    # blanks at the ends and line breaks anywhere do not count
    text = F.regexp_replace(F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    parts = F.split(F.regexp_replace(text, _PARTS, "\x01".join(f"${i}" for i in range(1, 8))), "\x01")
    return F.when(
        col.rlike(r"(?i)^[\x00-\x20]*https?:"),
        bind(parts, lambda p: F.when(F.size(p) == 7, _assembled(p))),
    )


def interpret_as_url(col: Column) -> Column:
    """The URL a request string stands for, raw or percent-encoded up to twice."""

    once = decode_component(col)
    tries = F.array(col, once, bind(once, decode_component))
    first = F.aggregate(
        tries, F.lit(None).cast("string"), lambda found, text: F.coalesce(found, http_url(text))
    )
    # a string with neither a colon nor an escape is a phrase
    return F.when(col.rlike("[:%]"), first)


def host_of(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def is_result_url(col: Column) -> Column:
    """True for links worth fetching: http(s) that resolves, or relative, but no search link."""
    scheme = F.lower(F.regexp_extract(F.trim(col), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    resolves = (scheme == "") | (scheme.isin("http", "https") & http_url(col).isNotNull())
    return F.coalesce((col != "") & ~col.startswith("/search") & resolves, F.lit(False))
