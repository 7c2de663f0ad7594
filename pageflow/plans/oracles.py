"""The same queries as plain SQL over the same tables, for comparison.

Written apart from the DataFrame code: patterns and rules are stated here
again, so that an error on one side shows.
"""

from __future__ import annotations

# Fixed value: host, port, path, query and fragment of an http(s) address
URL_TEST = r"'^(?i)https?://[^/?#@:\s%]+(:[0-9]*)?([/?#].*)?$'"


def _sub(expr: str, pattern: str, to: str = "''") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({expr}, '{pattern}', {to}, 'g')"


def _entities(expr: str) -> str:
    for name, code in (
        ("nbsp", 32), ("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("copy", 169), ("reg", 174), ("middot", 183),
        ("amp", 38),
    ):
        expr = _sub(expr, f"&{name};?", f"chr({code})")
    return expr


def _strip(expr: str) -> str:
    return _entities(_sub(expr, "(?s)<[^>]*>"))


def _tidy(expr: str) -> str:
    expr = _sub(expr, r"\r\n?", "chr(10)")
    expr = _sub(expr, r"[ \t\f\x0B\x{a0}]+", "' '")
    expr = _sub(expr, " ?\n ?", "chr(10)")
    expr = _sub(expr, "\n{3,}", "chr(10) || chr(10)")
    return _sub(expr, r"^\s+|\s+$")


def _drop(expr: str, tags: str) -> str:
    expr = _sub(expr, r"(?s)<!--.*?-->")
    for tag in tags.split():
        expr = _sub(expr, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)")
    return expr


LINE_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|"
    "th|thead|tr|ul"
)


def _layout(expr: str) -> str:
    expr = _drop(expr, "script style noscript svg canvas title")
    expr = _sub(expr, rf"(?is)</?(?:{LINE_TAGS})(?:\s[^>]*|/)?>", "chr(10)")
    return _tidy(_strip(expr))


BODY = _drop(
    r"regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body\s*>|\z)', 1)", "script style noscript svg nav footer"
)
RAW_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)"
TITLE = _entities(RAW_TITLE)
DOCUMENT = (
    f"""'<html lang=""><head><title>' || {_sub(RAW_TITLE, r"^\s+|\s+$")} || '</title></head><body>' || """
    f"""{_sub(BODY, r"^\s+|\s+$")} || '</body></html>'"""
)
LANG = """nullif(regexp_extract(html, '(?is)<html\\b[^>]*\\blang\\s*=\\s*["'']?([^"''\\s>]+)', 1), '')"""
HOST = "lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1))"

CLEAN = f"clean AS (SELECT page_id, url, html, {BODY} AS body, {TITLE} AS title FROM pages)"

# -- requests ---------------------------------------------------------------

PHRASES = "phrases AS (SELECT conv_id * 1000 + turn AS query_id, text AS phrase FROM conversations WHERE role = 'user')"
STRINGS = f"""spelled AS (
  SELECT page_id, {HOST} AS host, url, url_encode(url) AS e1 FROM pages
), {PHRASES}, strings AS (
  SELECT page_id * 100 + n - 1 AS request_id, q AS query FROM (
    SELECT page_id, unnest(qs) AS q, generate_subscripts(qs, 1) AS n FROM (
      SELECT page_id, [url, e1, url_encode(e1), url_encode(url_encode(e1)), 'HTTP://' || upper(host),
        'https://' || host || ':443/a/../b?x=1 2', 'http://' || host || ':8080#top', 'ftp://' || host || '/',
        host || '/path', '50% of ' || host, ''] AS qs FROM spelled))
  UNION ALL SELECT -query_id - 1, phrase FROM phrases
), spelled_out AS (
  SELECT request_id, query, [query, url_decode(query), url_decode(url_decode(query))] AS tries FROM strings
), addresses AS (
  SELECT request_id, query, list_filter(tries, lambda t: regexp_matches(t, {URL_TEST}))[1] AS found FROM spelled_out
), parts AS (
  SELECT *, lower(regexp_extract(found, '^([^:]+)://', 1)) AS scheme,
    lower(regexp_extract(found, '^[^:]+://([^/?#:]+)', 1)) AS host,
    regexp_extract(found, '^[^:]+://[^/?#:]+:([0-9]+)', 1) AS port,
    regexp_extract(found, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path,
    replace(regexp_extract(found, '^[^:]+://[^?#]+(.*)$', 1), ' ', '%20') AS tail FROM addresses
), urls AS (
  SELECT request_id, query, CASE WHEN found IS NOT NULL THEN scheme || '://' || host
    || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443')
       THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/[^/]+/\\.\\./', '/') END || tail END AS as_url
  FROM parts
)"""


def _choice(*values: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][query_id % {len(values)} + 1]"


QUERY_STRINGS = f"""{PHRASES}, strings AS (
  SELECT query_id AS request_id, phrase, {_choice("5", "0", "250", "abc", "", "7.9", "-3", "100")} AS max_results,
    {_choice("NULL", "text, markdown", '["html"]', "pdf")} AS formats,
    {_choice("NULL", "30", "9999")} AS timeout,
    {_choice("10", "NULL", "0", "900", "NULL")} AS wait,
    {_choice("NULL", "raw-http", "curl", "NULL", "NULL", "NULL", "NULL")} AS tool,
    {_choice("NULL", "NULL", "NULL", "SHADER", "NONE")} AS proxy_group,
    {_choice("debug=false", "debug=true", "cookie=false")} AS flag,
    {_choice("NULL", '{"a":1}', "NULL")} AS proxy,
    {_choice("NULL", "NULL", "t k", "NULL", "NULL")} AS token
  FROM phrases
), parsed AS (
  SELECT request_id, phrase AS query, max_results, nullif(formats, 'NULL') AS raw_formats,
    CASE formats WHEN 'text, markdown' THEN 'text|markdown' WHEN '["html"]' THEN 'html' WHEN 'pdf' THEN 'pdf' END
      AS formats,
    nullif(timeout, 'NULL') AS timeout, nullif(wait, 'NULL') AS wait, nullif(tool, 'NULL') AS tool,
    nullif(proxy_group, 'NULL') AS proxy_group, nullif(proxy, 'NULL') AS proxy, nullif(token, 'NULL') AS token,
    CASE flag WHEN 'debug=false' THEN 'false' WHEN 'debug=true' THEN 'true' END AS debug, flag
  FROM strings
), numbers AS (
  SELECT *, CASE WHEN trim(max_results) = '' THEN 0.0 ELSE try_cast(max_results AS DOUBLE) END AS n_max,
    try_cast(timeout AS DOUBLE) AS n_timeout, try_cast(wait AS DOUBLE) AS n_wait FROM parsed
), bounded AS (
  SELECT *, CASE WHEN n_max IS NULL THEN 3 ELSE floor(greatest(1, least(100, n_max))) END::BIGINT AS m,
    CASE WHEN n_timeout IS NULL THEN 40 ELSE floor(greatest(1, least(600, n_timeout))) END::BIGINT AS t FROM numbers
), checked AS (
  SELECT *, coalesce(formats, 'markdown') AS f, coalesce(proxy_group, 'GOOGLE_SERP') AS g,
    coalesce(tool, 'raw-http') AS s,
    CASE WHEN coalesce(query, '') = '' THEN 'The `query` parameter must be provided and non-empty.'
      WHEN formats = 'pdf' THEN 'The `outputFormats` array may only contain `text`, `markdown`, or `html`.'
      WHEN proxy_group = 'NONE' THEN 'The `serpProxyGroup` parameter must be either `GOOGLE_SERP` or `SHADER`.'
      WHEN tool = 'curl' THEN 'The `scrapingTool` parameter must be either `browser-playwright` or `raw-http`.'
    END AS error FROM bounded
)"""

# a phrase as the path of a search address; & and # are escaped on purpose
_ENCODED = "url_encode(query)"
for _code, _char in (
    ("%3B", ";"), ("%2C", ","), ("%2F", "/"), ("%3F", "?"), ("%3A", ":"), ("%40", "@"), ("%3D", "="), ("%24", "$"),
    ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"),
):
    _ENCODED = f"replace({_ENCODED}, '{_code}', '{_char}')"

# -- search results ---------------------------------------------------------

HITS = f"""named AS (
  SELECT page_id, url, html, {HOST} || ' ' || (page_id // 1000) AS name FROM pages
), hits AS (
  SELECT ('0x' || substr(md5(name), 1, 8))::BIGINT AS query_id, name AS query, (page_id % 37) // 10 + copy AS page,
    page_id * 2 + copy AS pos,
    CASE WHEN page_id % 13 = 4 THEN NULL WHEN page_id % 13 = 5 THEN '' ELSE {_entities(RAW_TITLE)} END AS title,
    'About ' || name AS description,
    CASE page_id % 11 WHEN 3 THEN '/search?q=' || page_id WHEN 5 THEN 'mailto:a' || page_id || '@example.com'
      WHEN 7 THEN '/local/' || page_id WHEN 9 THEN '' ELSE url END AS url
  FROM named, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR page_id % 3 = 0
), searches AS (
  SELECT DISTINCT query_id, query, query_id % 12 + 1 AS max_results FROM hits
), valid AS (
  SELECT * FROM hits WHERE title <> '' AND url <> '' AND url NOT LIKE '/search%'
    AND (NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(url, '(?i)^https?:'))
)"""

# The rules as a loop would apply them: read pages one by one until enough
# distinct results are there, the plan is exhausted or a page is empty.
PAGED = f"""{HITS}, plan AS (
  SELECT query_id, query, max_results, CAST(ceil(max_results / 10.0) AS BIGINT) + 1 AS total_pages FROM searches
), slots AS (
  SELECT p.*, page FROM plan p, range(0, 11) r(page) WHERE page < total_pages
), counted AS (
  SELECT s.query_id, s.page, s.max_results, s.total_pages, count(v.pos) AS n,
    (SELECT count(DISTINCT (w.title, w.url)) FROM valid w WHERE w.query_id = s.query_id AND w.page <= s.page) AS seen
  FROM slots s LEFT JOIN valid v ON v.query_id = s.query_id AND v.page = s.page GROUP BY ALL
), stopped AS (
  SELECT query_id, min(page) FILTER (WHERE n = 0 OR seen >= max_results OR page + 1 = total_pages) + 1 AS pages_read,
    min(page) FILTER (WHERE n = 0) AS first_empty FROM counted GROUP BY query_id
), firsts AS (
  SELECT v.*, p.max_results, row_number() OVER (PARTITION BY v.query_id, v.title, v.url ORDER BY v.page, v.pos) AS rn
  FROM valid v JOIN plan p USING (query_id) JOIN stopped s USING (query_id)
  WHERE v.page < s.pages_read
), final AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page, pos, title, url) AS rank FROM firsts WHERE rn = 1
  ) WHERE rank <= max_results
)"""



def _id(*parts: str) -> str:
    marked = [f"coalesce(length(({p})::VARCHAR) || ':' || ({p})::VARCHAR, '-')" for p in parts]
    return f"substr(sha256({" || '|' || ".join(marked)}), 1, 32)"


RESPONSE_ID = _id("'response'", "query_id")
UNIQUE_KEY = _id("'page'", "query_id", "title", "url")

BM25 = r"""terms AS (
  SELECT doc_id, host, list_filter(string_split_regex(lower(text), '[^a-z0-9\x{c0}-\x{ff}]+'), lambda t: t <> '') AS ts
  FROM corpus
), stats AS (
  SELECT count(*) AS n_docs, avg(len(ts)) AS mean_length FROM terms
), postings AS (
  SELECT doc_id, host, dl, term, count(*) AS tf FROM (
    SELECT doc_id, host, len(ts) AS dl, unnest(ts) AS term FROM terms) GROUP BY ALL
), wanted AS (
  SELECT DISTINCT query_id, site, term FROM (
    SELECT query_id, site, unnest(string_split_regex(lower(words), '[^a-z0-9\x{c0}-\x{ff}]+')) AS term FROM (
      SELECT query_id, nullif(lower(regexp_extract(phrase, '(?i)(?:^|\s)site:(\S+)', 1)), '') AS site,
        regexp_replace(phrase, '(?i)(?:^|\s)site:(\S+)', ' ', 'g') AS words FROM phrases)) WHERE term <> ''
), frequency AS (
  SELECT term, count(*) AS df FROM postings GROUP BY term
), weights AS (
  SELECT w.*, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM wanted w JOIN frequency USING (term), stats
), scores AS (
  SELECT query_id, doc_id,
    round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_length))), 6) AS score
  FROM weights JOIN postings USING (term), stats
  WHERE (site IS NULL OR host = site OR ends_with(host, '.' || site)) GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores
)"""
PAGE_CORPUS = f"""{CLEAN}, corpus AS (
  SELECT page_id AS doc_id, {HOST} AS host, title || ' ' || {_layout('body')} AS text FROM clean
)"""
TOP_10 = "SELECT query_id, doc_id, score, rank FROM best WHERE rank <= 10"

# -- page content -----------------------------------------------------------

FETCHED = f"""fetched AS (
  SELECT page_id, 'r' || (page_id // 50) AS response_id, 'k' || page_id AS unique_key,
    'query ' || (page_id // 50) AS query, url, regexp_replace(url, '^http:', 'https:') AS loaded_url,
    CASE WHEN page_id % 13 = 0 THEN 404 ELSE 200 END::BIGINT AS status,
    CASE page_id % 10 WHEN 0 THEN 'application/json' WHEN 1 THEN 'application/xml' WHEN 2 THEN NULL
      WHEN 3 THEN 'IMAGE/TEXT' ELSE 'text/html; charset=utf-8' END AS content_type,
    page_id % 10 NOT IN (0, 2, 3) AS readable,
    CASE WHEN page_id % 17 = 0 THEN 'net error ' || (page_id % 5) END AS error,
    (1704067200 + page_id) * 1000000 AS created_us, (1704067200 + page_id + page_id % 90) * 1000000 AS loaded_us, html
  FROM pages
)"""
HANDLED_ROW = f"""SELECT response_id, unique_key, query, md5({_layout(BODY)}) AS text_md5,
  status AS http_status_code, 'OK' AS http_status_message, 'handled' AS request_status, created_us, loaded_us,
  {TITLE} AS title, url, loaded_url AS redirected_url, {LANG} AS language_code
  FROM fetched WHERE error IS NULL AND readable"""

# Markdown of these pages: they hold a box, one heading and paragraphs, all in
# one unclosed <b>, so every paragraph is bold.
_PLAIN = r"([\\*`\[\]_])"
_MD_TEXT = _sub(_sub("x", r"\s+", "' '"), _PLAIN, r"'\\\1'")
_START = r"^(#{1,6} |>|-|\+ |=+|~~~)"


def _md_line(expr: str) -> str:
    expr = _sub(expr, r"\s+", "' '")
    expr = _sub(_entities(expr), _PLAIN, r"'\\\1'")
    return _sub(expr, "^ +| +$")


def _md_start(expr: str) -> str:
    return _sub(_sub(expr, _START, r"'\\\1'"), r"^(\d+)\. ", r"'\1\\. '")


MARKDOWN = f"""{CLEAN}, pieces AS (
  SELECT page_id, regexp_extract(body, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
    regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1) AS head,
    list_filter(list_transform(
      string_split_regex(regexp_extract(body, '(?s)</h1>(.*?)(?:</article>|\\z)', 1), '<p>'),
      lambda p: {_md_line(_strip("p").replace("chr(32)", "' '"))}), lambda p: p <> '') AS paragraphs,
    {_md_start(_md_line(RAW_TITLE))} AS top FROM clean
), marked AS (
  SELECT page_id, list_filter([top, {_md_start(_md_line("ad"))}, '# ' || {_md_start(_md_line("head"))}]
    || list_transform(paragraphs, lambda p: '**' || p || '**'), lambda b: b <> '') AS parts FROM pieces
), markdown AS (
  SELECT page_id, array_to_string(parts, chr(10) || chr(10)) AS markdown FROM marked
)"""

BLOCKS = f"""{CLEAN}, cut AS (
  SELECT page_id, list_filter(
    [{{'tag': 'div', 'raw': regexp_extract(body, '(?s)<div class="ad">(.*?)</div>', 1)}},
     {{'tag': 'h1', 'raw': regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)}}]
    || list_transform(
      string_split_regex(regexp_extract(body, '(?s)</h1>(.*?)(?:</article>|\\z)', 1), '<p>'),
      lambda p: {{'tag': 'p', 'raw': p}}),
    lambda b: trim({_sub(_strip("b.raw"), r"\s+", "' '")}) <> '') AS bs FROM clean
), numbered AS (
  SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS block_no FROM cut
), blocks AS (
  SELECT page_id, block_no, b.tag AS tag, trim({_sub(_sub("b.raw", "<br>", "' '"), "XX")}) AS raw FROM numbered
), texts AS (
  SELECT page_id, block_no, tag, trim({_sub(_strip("raw"), r"\s+", "' '")}) AS text FROM blocks
), scored AS (
  SELECT *, 0::BIGINT AS link_chars, CASE WHEN length(text) >= 25
    THEN 1.0 + length(text) - length(replace(text, ',', '')) + least(length(text) // 100, 3) ELSE 0.0 END::DOUBLE AS score
  FROM texts
)"""
# the article wins if half of its own blocks outweighs the box beside it
MAIN = f"""{BLOCKS}, votes AS (
  SELECT page_id, sum(CASE WHEN tag = 'div' THEN score ELSE 0 END) AS box,
    sum(CASE WHEN tag <> 'div' THEN score ELSE 0 END) AS article FROM scored GROUP BY page_id
), picked AS (
  SELECT c.page_id, c.title, c.body, article + box > 0 AS any_prose,
    CASE WHEN article > box + article / 2 THEN regexp_extract(body, '(?s)<article>(.*?)(?:</article>|\\z)', 0)
      ELSE body END AS main
  FROM clean c LEFT JOIN votes USING (page_id)
), judged AS (
  SELECT *, {_tidy(_strip("main"))} AS bare FROM picked
)"""

# -- responses --------------------------------------------------------------

EVENTS = """requests AS (
  SELECT event_id // 4 AS response_id, event_id AS unique_key, ts AS created_at, event_id // 4 % 60 + 1 AS timeout_secs
  FROM events
), delivered AS (
  SELECT event_id // 4 AS response_id,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN -event_id ELSE event_id END AS unique_key,
    CASE WHEN event_type = 'error' OR again = 1 THEN 'failed' ELSE 'handled' END AS request_status,
    epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) + again * 1000000 AS loaded_us,
    CASE WHEN event_type = 'error' OR again = 1 THEN 500 ELSE 200 END::BIGINT AS http_status_code,
    CASE WHEN event_type = 'error' THEN 'error' WHEN again = 1 THEN 'again' ELSE 'OK' END AS http_status_message,
    'title ' || event_id AS title, 'text ' || event_type AS text, epoch_us(ts) AS sent_us, again
  FROM events, (VALUES (0), (1)) a(again)
  WHERE event_type <> 'signup' AND (again = 0 OR event_type = 'click')
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY response_id, unique_key ORDER BY loaded_us DESC) AS rn
    FROM delivered) WHERE rn = 1
), merged AS (
  SELECT r.*, coalesce(o.request_status, 'pending') AS request_status, o.loaded_us, o.http_status_code,
    o.http_status_message, o.title, o.text
  FROM requests r LEFT JOIN latest o USING (response_id, unique_key)
), in_time AS (
  SELECT d.* FROM requests r JOIN delivered d USING (response_id, unique_key)
  WHERE d.loaded_us BETWEEN epoch_us(r.created_at) AND epoch_us(r.created_at) + r.timeout_secs * 1000000
), answered AS (
  SELECT response_id, CASE WHEN bool_and(first_us IS NOT NULL) THEN max(first_us) END AS done_us
  FROM requests LEFT JOIN (SELECT response_id, unique_key, min(loaded_us) AS first_us FROM in_time GROUP BY ALL)
    USING (response_id, unique_key)
  GROUP BY response_id
), counting AS (
  SELECT i.*, row_number() OVER (PARTITION BY response_id, unique_key ORDER BY loaded_us DESC, request_status DESC) AS rn
  FROM in_time i JOIN answered a USING (response_id) WHERE done_us IS NULL OR loaded_us <= done_us
), timely AS (
  SELECT r.*, coalesce(o.request_status, 'pending') AS request_status, o.loaded_us, o.http_status_code,
    o.http_status_message, o.title, o.text
  FROM requests r LEFT JOIN (SELECT * FROM counting WHERE rn = 1) o USING (response_id, unique_key)
)"""
MEASURES = """measures AS (
  SELECT user_id AS request_id, event_id AS seq, event_type AS event, epoch_us(ts) AS time_us FROM events
), deltas AS (
  SELECT *, coalesce(time_us - lag(time_us) OVER (PARTITION BY request_id ORDER BY seq), 0) AS delta_us,
    time_us - first_value(time_us) OVER (PARTITION BY request_id ORDER BY seq) AS relative_us FROM measures
)"""
# pages by address, each address once per page
BY_URL = f"""{PAGED}, found AS (
  SELECT query_id, rank, title, url FROM final WHERE url LIKE 'http%'
), joined AS (
  SELECT f.query_id, f.rank, p.* EXCLUDE (title, url), p.title AS page_title, f.url
  FROM found f JOIN clean p ON p.url = f.url
)"""
BY_URL = BY_URL.replace("named AS (", f"{CLEAN}, named AS (", 1)

ORACLES = {
    "interpret_as_url": f"WITH {STRINGS} SELECT request_id, as_url FROM urls",
    "route_requests": f"""WITH {STRINGS} SELECT request_id,
        CASE WHEN as_url IS NULL THEN 'search' ELSE 'url' END AS route, coalesce(as_url, query) AS target FROM urls""",
    "parse_params": f"""WITH {QUERY_STRINGS} SELECT request_id, query, max_results, formats AS output_formats,
        timeout AS request_timeout_secs, proxy_group AS serp_proxy_group, tool AS scraping_tool,
        proxy AS proxy_configuration, debug AS debug_mode, token FROM parsed""",
    "validate_params": f"""WITH {QUERY_STRINGS} SELECT request_id, m AS max_results, f AS output_formats,
        t AS request_timeout_secs,
        CASE WHEN n_wait > 0 AND n_wait < t THEN n_wait ELSE floor(t / 2.0 + 0.5) END::BIGINT
          AS dynamic_content_wait_secs,
        g AS serp_proxy_group, 1::BIGINT AS serp_max_retries, s AS scraping_tool,
        flag <> 'cookie=false' AS remove_cookie_warnings, flag = 'debug=true' AS debug_mode,
        CASE WHEN n_max IS NULL THEN 'maxResults' ELSE '' END AS replaced, error FROM checked""",
    "typed_input": f"""WITH {PHRASES}, records AS (
        SELECT query_id AS n, CASE WHEN query_id % 11 <> 0 THEN phrase END AS query, query_id % 4 AS kind FROM phrases
        ), settled AS (
        SELECT *, greatest(1, least(600, n % 900))::BIGINT AS timeout,
          CASE WHEN n % 7 = 0 THEN 'PROXY' WHEN n % 7 < 4 THEN 'SHADER' ELSE 'GOOGLE_SERP' END AS proxies,
          CASE WHEN n % 13 = 0 THEN 'telnet' WHEN n % 13 < 6 THEN 'browser-playwright' ELSE 'raw-http' END AS tool FROM records)
        SELECT n AS request_id, CASE WHEN n % 3 = 0 THEN 3 ELSE greatest(1, least(100, n % 130 - 10)) END::BIGINT AS max_results,
          CASE kind WHEN 1 THEN 'text|html' WHEN 2 THEN 'pdf' ELSE 'markdown' END AS output_formats,
          timeout AS request_timeout_secs, proxies AS serp_proxy_group, greatest(0, least(3, n % 6 - 1))::BIGINT AS serp_max_retries,
          tool AS scraping_tool, CASE n % 5 WHEN 0 THEN 1 ELSE least(3, n % 5) END::BIGINT AS max_request_retries,
          CASE WHEN n % 50 BETWEEN 1 AND timeout - 1 THEN n % 50 ELSE floor(timeout / 2 + 0.5) END::BIGINT AS dynamic_content_wait_secs,
          n % 9 AS desired_concurrency, CASE WHEN n % 2 = 0 THEN n % 400 ELSE 100 END::BIGINT AS readable_char_threshold,
          n % 3 < 2 AS remove_cookie_warnings, n % 5 = 1 AS debug_mode, n % 8 = 0 AS own_selector,
          CASE WHEN coalesce(query, '') = '' THEN 'The `query` parameter must be provided and non-empty.'
            WHEN kind = 2 THEN 'The `outputFormats` array may only contain `text`, `markdown`, or `html`.'
            WHEN proxies = 'PROXY' THEN 'The `serpProxyGroup` parameter must be either `GOOGLE_SERP` or `SHADER`.'
            WHEN tool = 'telnet' THEN 'The `scrapingTool` parameter must be either `browser-playwright` or `raw-http`.' END AS error
        FROM settled""",
    "search_page_plan": f"""WITH {QUERY_STRINGS}, plan AS (
        SELECT *, CAST(ceil(m / 10.0) AS BIGINT) + 1 AS total_pages FROM checked WHERE error IS NULL)
        SELECT request_id, page, total_pages,
          CASE WHEN g = 'GOOGLE_SERP' THEN 'http' ELSE 'https' END || '://www.google.com/search?q=' || {_ENCODED}
          || CASE WHEN page > 0 THEN '&start=' || page * 10 ELSE '' END AS search_url
        FROM plan, range(0, 11) r(page) WHERE page < total_pages""",
    "page_by_url": f"""WITH {STRINGS} SELECT u.request_id, p.page_id, u.as_url AS target,
        length(p.html)::BIGINT AS n_chars FROM urls u JOIN pages p ON p.url = u.as_url""",
    "serp_extract": f"""WITH {HITS} SELECT DISTINCT query_id, page, title, description, url,
        CASE WHEN query_id % 5 = 0 THEN 'SUGGESTED' ELSE 'ORGANIC' END AS result_type FROM valid""",
    "valid_results": f"WITH {HITS} SELECT query_id, page, pos, title, url FROM valid",
    "dedup_results": f"""WITH {HITS} SELECT query_id, page, pos, title, url FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, title, url ORDER BY page, pos) AS rn FROM hits)
        WHERE rn = 1""",
    "topk_rank": f"""WITH {HITS}, firsts AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, title, url ORDER BY page, pos) AS rn
          FROM valid) WHERE rn = 1)
        SELECT query_id, rank, title, url FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page, pos, title, url) AS rank FROM firsts)
        WHERE rank <= query_id % 12 + 1""",
    "paginate_results": f"""WITH {PAGED} SELECT s.query_id, s.pages_read, f.rank, f.title, f.url
        FROM stopped s LEFT JOIN final f USING (query_id)""",
    "page_requests": f"""WITH {PAGED} SELECT {RESPONSE_ID} AS response_id, {UNIQUE_KEY} AS unique_key, url, title,
        rank, description FROM final""",
    "empty_searches": f"""WITH {PAGED} SELECT query_id, query FROM searches
        WHERE query_id NOT IN (SELECT query_id FROM final)""",
    "posting_index": f"""WITH {PHRASES}, {PAGE_CORPUS}, {BM25}
SELECT term, count(*) AS df, round(max(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean_length))), 6) AS top
FROM postings, stats GROUP BY term""",
    "search_bm25": f"WITH {PHRASES}, {PAGE_CORPUS}, {BM25} {TOP_10}",
    "search_documents": f"""WITH {PHRASES}, corpus AS (SELECT doc_id, '' AS host, text FROM documents), {BM25}
        {TOP_10}""",
    "search_site": f"""WITH phrases AS (
        SELECT page_id AS query_id, 'site:' || regexp_replace({HOST}, '^[^.]+\\.', '') || ' ' || {TITLE} AS phrase
        FROM pages), {PAGE_CORPUS}, {BM25} {TOP_10}""",
    "content_type_split": f"""WITH {FETCHED} SELECT unique_key, content_type, readable,
        CASE WHEN NOT readable THEN 'Couldn''t parse the content' END AS message,
        CASE WHEN NOT readable THEN 'failed' END AS request_status FROM fetched""",
    "page_metadata": f"""WITH {FETCHED} SELECT page_id, {TITLE} AS title, NULL::VARCHAR AS description,
        NULL::VARCHAR AS author, {LANG} AS language_code, url, loaded_url AS redirected_url FROM fetched""",
    "remove_elements": f"SELECT page_id, md5({BODY}) AS body_md5, length({BODY})::BIGINT AS n_chars FROM pages",
    "remove_selector": f"""SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM (
        SELECT page_id, {_layout(BODY)} AS t FROM pages)""",
    "clean_html": f"""SELECT page_id, md5(d) AS document_md5, length(d)::BIGINT AS n_chars FROM (
        SELECT page_id, {DOCUMENT} AS d FROM pages)""",
    "page_text": f"SELECT page_id, {_layout(BODY)} AS text FROM pages",
    "oversize_text": f"""SELECT page_id, length(d) > 2000 AS oversize, md5(t) AS text_md5, length(t)::BIGINT AS n_chars
        FROM (SELECT page_id, d, CASE WHEN length(d) > 2000 THEN {_strip(_sub("d", "(?s)<!--.*?-->"))}
          ELSE {_layout("d")} END AS t FROM (SELECT page_id, {DOCUMENT} AS d FROM pages))""",
    "page_markdown": f"WITH {MARKDOWN} SELECT page_id, markdown FROM markdown",
    "readable_blocks": f"WITH {BLOCKS} SELECT page_id, block_no, tag, text, link_chars, score FROM scored",
    "readable_main": f"""WITH {MAIN} SELECT page_id, CASE WHEN any_prose AND length(bare) >= 100
        THEN {_layout("'<h1>' || replace(replace(title, '&', '&amp;'), '<', '&lt;') || '</h1>' || main")}
        ELSE {_layout("body")} END AS text FROM judged""",
    "result_records": f"WITH {FETCHED} {HANDLED_ROW}",
    "failed_results": f"""WITH {FETCHED} SELECT response_id, unique_key, '' AS text, 500::BIGINT AS http_status_code,
        error AS http_status_message, 'failed' AS request_status, '' AS title, url FROM fetched
        WHERE error IS NOT NULL""",
    "all_outcomes": f"""WITH {FETCHED} {HANDLED_ROW} UNION ALL
        SELECT response_id, unique_key, query, md5(''), status, 'Couldn''t parse the content', 'failed', created_us,
          loaded_us, NULL, url, NULL, NULL FROM fetched WHERE error IS NULL AND NOT readable UNION ALL
        SELECT response_id, unique_key, NULL, md5(''), 500, error, 'failed', created_us, loaded_us, '', url, NULL, NULL
        FROM fetched WHERE error IS NOT NULL""",
    "output_formats": f"""WITH {MARKDOWN} SELECT 'k' || page_id AS unique_key,
        CASE WHEN page_id % 5 IN (0, 3, 4) THEN md5({_layout("body")}) END AS text_md5,
        CASE WHEN page_id % 5 IN (1, 3, 4) THEN md5(markdown) END AS markdown_md5,
        page_id % 5 IN (2, 4) AS has_html FROM clean JOIN markdown USING (page_id)""",
    "results_with_content": f"""WITH {BY_URL} SELECT query_id, rank, url, page_id, page_title,
        md5({_layout("body")}) AS text_md5 FROM joined""",
    "result_preview": f"""WITH {BY_URL} SELECT rank, page_title AS title, url,
        left({_layout("body")}, 200) || '...' AS preview FROM joined""",
    "response_merge": f"""WITH {EVENTS} SELECT response_id, unique_key, request_status,
        epoch_us(created_at) AS created_us, loaded_us, http_status_code, title FROM merged""",
    "response_deadline": f"""WITH {EVENTS} SELECT response_id, unique_key,
        CASE WHEN request_status = 'pending' THEN 'failed' ELSE request_status END AS request_status,
        coalesce(http_status_code, 500) AS http_status_code,
        coalesce(http_status_message, 'Timed out.') AS http_status_message,
        coalesce(title, '') AS title, coalesce(text, '') AS text FROM timely""",
    "response_complete": f"""WITH {EVENTS} SELECT response_id, count(*) AS n_requests,
        count(*) FILTER (WHERE request_status = 'pending') AS n_pending,
        bool_and(request_status <> 'pending') AS complete FROM merged GROUP BY response_id""",
    "response_status": f"""WITH {EVENTS}, totals AS (
        SELECT response_id, bool_and(request_status <> 'pending') AS complete,
          count(*) FILTER (WHERE request_status = 'handled') AS n_handled FROM timely GROUP BY response_id)
        SELECT response_id, CASE WHEN complete OR n_handled > 0 THEN 200 ELSE 500 END::BIGINT AS http_status,
          CASE WHEN complete THEN 'complete' WHEN n_handled > 0 THEN 'partial' ELSE 'rejected' END AS outcome,
          n_handled FROM totals""",
    "cancel_expired": f"""WITH {EVENTS}, clock AS (
        SELECT epoch_us(max(created_at)) AS now_us FROM requests), over AS (
        SELECT r.response_id FROM requests r JOIN answered USING (response_id), clock GROUP BY r.response_id
        HAVING max(done_us) <= max(now_us)
          OR max(epoch_us(created_at) + timeout_secs * 1000000) <= max(now_us))
        SELECT response_id, unique_key,
          CASE WHEN response_id IN (SELECT response_id FROM over) THEN 'cancel' ELSE 'run' END AS action
        FROM requests""",
    "response_sorted": f"""WITH {PAGED}, keyed AS (
        SELECT {RESPONSE_ID} AS response_id, {UNIQUE_KEY} AS unique_key,
          CASE WHEN rank % 4 <> 0 THEN rank END AS rank FROM final)
        SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY rank ASC NULLS LAST, unique_key) AS position
        FROM keyed""",
    "response_json": f"""WITH {PAGED} SELECT {RESPONSE_ID} AS response_id, 200::BIGINT AS http_status,
        to_json(list({{'title': title, 'url': url, 'rank': rank}} ORDER BY rank))::VARCHAR AS body
        FROM final GROUP BY query_id UNION ALL
        SELECT {RESPONSE_ID}, 200, '[]' FROM searches WHERE query_id NOT IN (SELECT query_id FROM final) UNION ALL
        SELECT {_id("'request'", "request_id")}, 400, to_json({{'errorMessage': error}})::VARCHAR
        FROM (WITH {QUERY_STRINGS} SELECT request_id, error FROM checked) WHERE error IS NOT NULL""",
    "result_messages": f"""WITH {PAGED} SELECT {RESPONSE_ID} AS response_id, rank,
        to_json({{'type': 'text', 'text': to_json({{'title': title, 'url': url, 'rank': rank}})::VARCHAR}})::VARCHAR
          AS message FROM final""",
    "run_stats": f"""WITH {EVENTS} SELECT count(*) FILTER (WHERE request_status = 'handled') AS requests_finished,
        count(*) FILTER (WHERE request_status <> 'handled') AS requests_failed FROM timely""",
    "stage_deltas": f"WITH {MEASURES} SELECT request_id, seq, event, delta_us FROM deltas",
    "stage_relative": f"WITH {MEASURES} SELECT request_id, seq, event, relative_us, delta_us FROM deltas",
    "stage_latency_avg": f"""WITH {MEASURES} SELECT event, count(*) AS n, sum(delta_us)::BIGINT AS total_us,
        round(avg(delta_us) / 1000, 3) AS mean_ms FROM deltas GROUP BY event""",
    "request_time_taken": f"""WITH {MEASURES} SELECT request_id, seq, round(relative_us / 1000, 3) AS time_ms,
        (SELECT round(avg(relative_us) / 1000, 3) FROM deltas WHERE event = 'purchase') AS mean_ms
        FROM deltas WHERE event = 'purchase'""",
    "context_pack": f"""WITH {BY_URL}, {MARKDOWN.split('), pieces AS', 1)[0].split('clean AS', 1)[0]}XX SELECT 1""",
    "context_request": f"""WITH {QUERY_STRINGS} SELECT request_id, least(m, 3) AS max_results,
        CASE f WHEN 'markdown' THEN 'markdown' WHEN 'text|markdown' THEN 'text,markdown'
          WHEN 'html' THEN 'html,markdown' ELSE 'pdf,markdown' END AS output_formats FROM checked""",
    "stream_response_deadline": f"""WITH {EVENTS} SELECT response_id, unique_key,
        CASE request_status WHEN 'pending' THEN 'failed' ELSE request_status END AS request_status,
        CASE request_status WHEN 'pending' THEN 'Timed out.' END AS http_status_message FROM timely""",
    "stream_response_early": f"""WITH {EVENTS} SELECT response_id,
        count(*) FILTER (WHERE request_status = 'handled') AS n_handled,
        count(*) FILTER (WHERE request_status <> 'handled') AS n_failed,
        count(*) FILTER (WHERE request_status = 'pending') AS n_timed_out,
        bool_and(request_status <> 'pending') AS complete FROM timely GROUP BY response_id""",
    "stream_last_outcome": f"""WITH {EVENTS} SELECT response_id, unique_key,
        arg_max(request_status, loaded_us) AS request_status, count(*) AS n_deliveries
        FROM delivered GROUP BY response_id, unique_key""",
}

# the stream makes the records of the batch
ORACLES["stream_extract"] = ORACLES["all_outcomes"]

# contexts need both the hits and the Markdown of their pages
_MARKDOWN_STEPS = MARKDOWN.split(CLEAN + ", ", 1)[1]
ORACLES["context_pack"] = f"""WITH {BY_URL}, {_MARKDOWN_STEPS}, parts AS (
    SELECT query_id, rank, left(markdown, 5000) || '...' AS part FROM joined JOIN markdown USING (page_id)
    WHERE rank <= 3), packed AS (
    SELECT query_id, count(*) AS n_results, string_agg(part, chr(10) ORDER BY rank, part) AS context
    FROM parts GROUP BY query_id)
    SELECT query_id, n_results, md5(context) AS context_md5, length(context)::BIGINT AS n_chars FROM packed"""
ORACLES["answer_phrases"] = f"""WITH {PHRASES}, {PAGE_CORPUS}, {BM25}, {_MARKDOWN_STEPS}, parts AS (
    SELECT query_id, rank, left(markdown, 5000) || '...' AS part
    FROM best JOIN markdown ON page_id = doc_id WHERE rank <= 3)
    SELECT query_id, count(*) AS n_results, string_agg(part, chr(10) ORDER BY rank) AS context
    FROM parts GROUP BY query_id"""
COPIED = PAGE_CORPUS.rstrip(")\n") + f"""
  UNION ALL SELECT page_id + copy * 1000000000, {HOST}, title || ' ' || {_layout('body')}
  FROM clean, range(1, 121) c(copy) WHERE page_id = 7
), {BM25}, singles AS (
  SELECT s.query_id, p.page_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p.page_id) AS rank
  FROM (SELECT query_id, doc_id % 1000000000 AS page_id, max(score) AS score FROM scores GROUP BY ALL) s
  JOIN clean p USING (page_id) WHERE p.title <> ''
), wanted_pages AS (
  SELECT page_id AS request_id, page_id, NULL::BIGINT AS rank, 1 AS place FROM pages
  UNION ALL SELECT -query_id - 1, page_id, rank, rank FROM singles
  WHERE rank <= greatest(1, query_id % 5) AND query_id % 7 <> 3
)"""
ORACLES["respond_requests"] = f"""WITH {PHRASES}, {COPIED}, {FETCHED}, asked AS (
    SELECT page_id AS request_id, NULL AS error FROM pages UNION ALL
    SELECT -query_id - 1, CASE WHEN coalesce(phrase, '') = '' THEN 'The `query` parameter must be provided and non-empty.'
      WHEN query_id % 7 = 3 THEN 'The `outputFormats` array may only contain `text`, `markdown`, or `html`.' END FROM phrases)
    SELECT request_id, CASE WHEN any_value(a.error) IS NULL THEN 200 ELSE 400 END::BIGINT AS http_status,
      CASE WHEN any_value(a.error) IS NULL THEN coalesce(string_agg(f.url, ' ' ORDER BY place), '') END AS urls,
      any_value(a.error) AS error
    FROM asked a LEFT JOIN wanted_pages w USING (request_id) LEFT JOIN fetched f USING (page_id) GROUP BY request_id"""
ORACLES["retrieve_results"] = f"""WITH {PHRASES}, {COPIED}, {FETCHED}
    SELECT request_id, rank, place AS position, f.url,
      CASE WHEN error IS NULL AND readable THEN 'handled' ELSE 'failed' END AS request_status,
      CASE WHEN error IS NOT NULL THEN 500 ELSE status END AS http_status_code,
      CASE WHEN error IS NOT NULL THEN error WHEN NOT readable THEN 'Couldn''t parse the content' ELSE 'OK' END
        AS http_status_message,
      CASE WHEN error IS NOT NULL THEN '' WHEN readable THEN title END AS title,
      md5(CASE WHEN error IS NULL AND readable THEN {_layout("body")} ELSE '' END) AS text_md5
    FROM wanted_pages JOIN fetched f USING (page_id) JOIN clean c ON c.page_id = f.page_id"""
ORACLES["record_messages"] = f"""SELECT request_id, rank, position, 'text' AS type, url, request_status, http_status_code,
  http_status_message, title, text_md5, rank AS result_rank FROM ({ORACLES["retrieve_results"]})"""
# On these pages the nested selectors name what the usual one names.
ORACLES["remove_row_selector"] = ORACLES["remove_selector"]
ORACLES["stored_pages"] = f"""WITH {FETCHED}
SELECT page_id % 40 AS asker, page_id,
  loaded_us + CASE WHEN page_id % 3 = 0 THEN 86400000000 ELSE 0 END AS loaded_us,
  md5(CASE WHEN page_id % 3 = 0 THEN '<!--2-->' ELSE '' END || html) AS html_md5
FROM fetched WHERE page_id % 2 = 0"""

_RECORDED = f"""{FETCHED}, stages AS (
  SELECT event_id // 4 AS page_id, event_id AS seq, event_type AS event, epoch_us(ts) AS time_us FROM events
), taken AS (
  SELECT f.response_id, f.unique_key, s.seq, s.event, s.time_us FROM fetched f JOIN stages s ON s.page_id = f.page_id
  WHERE f.page_id % 3 <> 0 AND f.error IS NULL AND f.readable
  UNION ALL
  SELECT response_id, unique_key, 9000000000000, CASE WHEN page_id % 5 = 0 THEN 'playwright' ELSE 'cheerio' END
    || '-before-response-send', loaded_us FROM fetched WHERE page_id % 3 <> 0 AND error IS NULL AND readable
), recorded AS (
  SELECT response_id, unique_key, event, time_us - first_value(time_us) OVER w AS relative_us,
    coalesce(time_us - lag(time_us) OVER w, 0) AS delta_us,
    row_number() OVER (PARTITION BY unique_key ORDER BY time_us, seq) - 1 AS seq
  FROM taken WINDOW w AS (PARTITION BY unique_key ORDER BY seq)
)"""
ORACLES["record_measures"] = f"""WITH {_RECORDED}
SELECT response_id, unique_key, seq, event, relative_us, delta_us FROM recorded"""
ORACLES["record_latency"] = f"""WITH {_RECORDED}
SELECT event, count(*) AS n, sum(delta_us)::BIGINT AS total_us, round(avg(delta_us) / 1000, 3) AS mean_ms FROM recorded GROUP BY event"""
ORACLES["record_time_taken"] = f"""WITH {_RECORDED}
SELECT response_id, unique_key, seq, round(relative_us / 1000, 3) AS time_ms,
  (SELECT round(avg(relative_us) / 1000, 3) FROM recorded WHERE event = 'cheerio-before-response-send') AS mean_ms
FROM recorded WHERE event = 'cheerio-before-response-send'"""
# a stream that is started again appends nothing twice
ORACLES["stream_append"] = ORACLES["all_outcomes"]

_LABELS = "['xn--bcher-kva', 'xn--mnchen-ost-9db', 'xn--r8jz45g', 'xn--e1afmkfd', 'xn--and-6ma2c', 'xn--smrrebrd-64af', 'xn--3b-ww4c5e180e575a65lsy2b']"
ORACLES["host_forms"] = f"""WITH numbers AS (
  SELECT page_id, {HOST} AS host, page_id * 7919 + 16909060 AS ip FROM pages
), dotted AS (
  SELECT *, (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) AS address FROM numbers
)
SELECT page_id, 0 AS form, 'http://' || {_LABELS}[1 + page_id % 7] || '.' || host || '/' || page_id AS as_url FROM dotted
UNION ALL SELECT page_id, 1, 'https://' || address || '/' FROM dotted
UNION ALL SELECT page_id, 2, 'http://' || address || '/' FROM dotted
UNION ALL SELECT page_id, 3, 'http://' || page_id % 256 || '.' || (page_id >> 16) || '.' || ((page_id >> 8) & 255) || '.' || (page_id & 255) || '/'
  FROM dotted
UNION ALL SELECT page_id, 4, CASE WHEN page_id < 256 THEN 'http://' || page_id || '.2.3.4/' END FROM dotted"""
