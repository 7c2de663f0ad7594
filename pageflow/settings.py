"""Fixed values and per-job settings."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Request parameters, their defaults and bounds
# ---------------------------------------------------------------------------
PARAMETER_NAMES = (
    "token",
    "query",
    "maxResults",
    "outputFormats",
    "requestTimeoutSecs",
    "serpProxyGroup",
    "serpMaxRetries",
    "proxyConfiguration",
    "scrapingTool",
    "removeElementsCssSelector",
    "htmlTransformer",
    "desiredConcurrency",
    "maxRequestRetries",
    "dynamicContentWaitSecs",
    "removeCookieWarnings",
    "debugMode",
    "readableTextCharThreshold",
)

# name -> (minimum, maximum, default)
NUMBER_BOUNDS = {
    "maxResults": (1, 100, 3),
    "requestTimeoutSecs": (1, 600, 40),
    "serpMaxRetries": (0, 3, 1),
    "maxRequestRetries": (0, 3, 1),
}

OUTPUT_FORMATS = ("text", "markdown", "html")
DEFAULT_OUTPUT_FORMATS = ("markdown",)
SERP_PROXY_GROUPS = ("GOOGLE_SERP", "SHADER")
SCRAPING_TOOLS = ("browser-playwright", "raw-http")
DEFAULT_SCRAPING_TOOL = "raw-http"
# Scraping tool -> what its stage names begin with
STAGE_PREFIXES = {"raw-http": "cheerio", "browser-playwright": "playwright"}
STAGE_SENT = "before-response-send"

DEFAULT_REMOVE_SELECTOR = (
    "nav, footer, script, style, noscript, svg, img[src^='data:'], "
    '[role="alert"], [role="banner"], [role="dialog"], [role="alertdialog"], '
    '[role="region"][aria-label*="skip" i], [aria-modal="true"]'
)

RESULTS_PER_PAGE = 10
MAX_HTML_CHARS = 1_500_000
MAX_GFM_CHARS = 100_000
MAX_TIMEOUT_SECS = 600
CONTEXT_CHARS = 5000
CONTEXT_RESULTS = 3
PREVIEW_CHARS = 200

MSG_EMPTY_QUERY = "The `query` parameter must be provided and non-empty."
MSG_OUTPUT_FORMATS = "The `outputFormats` array may only contain `text`, `markdown`, or `html`."
MSG_PROXY_GROUP = "The `serpProxyGroup` parameter must be either `GOOGLE_SERP` or `SHADER`."
MSG_SCRAPING_TOOL = "The `scrapingTool` parameter must be either `browser-playwright` or `raw-http`."
MSG_UNPARSEABLE = "Couldn't parse the content"
MSG_TIMED_OUT = "Timed out."

PENDING, HANDLED, FAILED = "pending", "handled", "failed"

# ---------------------------------------------------------------------------
# The search address and the selectors of a result page
# ---------------------------------------------------------------------------
SEARCH_ADDRESS = "://www.google.com/search?q="
SERP_RESULT_SELECTORS = (
    ".hlcw0c",
    ".g.Ww4FFb",
    ".MjjYud",
    ".g .tF2Cxc>.yuRUbf",
    '.g [data-header-feature="0"]',
    ".g .rc",
    ".sATSHe",
)
SERP_DROP_SELECTOR = "div.action-menu"
SERP_DESCRIPTION_SELECTOR = ".VwiC3b"
SERP_SUGGESTION_SELECTOR = "div#topstuff > div.fSp71d > *"


@dataclass(frozen=True)
class ContentSettings:
    """How the content job treats a page."""

    remove_selector: str = DEFAULT_REMOVE_SELECTOR
    output_formats: tuple[str, ...] = DEFAULT_OUTPUT_FORMATS
    html_transformer: str = "none"
    readable_char_threshold: int = 100
    max_html_chars: int = MAX_HTML_CHARS
    max_gfm_chars: int = MAX_GFM_CHARS


@dataclass(frozen=True)
class SearchSettings:
    """BM25 constants and the number of hits kept per phrase."""

    k1: float = 1.2
    b: float = 0.75
    top_k: int = 10
    # Postings of one block, and the weightiest terms of a phrase with a site whose first blocks give its threshold.
    block_postings: int = 256
    lead_terms: int = 4
    # Documents of one shard, where there are more shards than cores, and shards of which one gives the thresholds of the others.
    shard_documents: int = 16_384
    shards_a_lead: int = 8
    # Copies of a shard that share its phrases.
    shard_copies: int = 1
    # Largest table of terms or weights, in bytes, that is sent to every executor;
    # beyond it the posting blocks meet their terms by shuffle.
    broadcast_bytes: int = 64 << 20
