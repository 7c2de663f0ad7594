"""Tree events, selectors, clean HTML, text, Markdown, main content, records."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pageflow import settings as S
from pageflow.functions import render, selectors as css, text as native
from pageflow.functions.bind import bind
from pageflow.functions.dom import html_events
from pageflow.operators import content

ALL = S.ContentSettings(output_formats=("text", "markdown", "html"))


def run(spark, pages, settings=ALL):
    table = spark.createDataFrame(list(enumerate(pages)), "n int, html string")
    return content.with_content(table, settings).orderBy("n").collect()


BASIC = (
    "<!doctype html><html lang=en-GB><head><title>Harbour notes</title><meta name=author content='A. Writer'>"
    '<meta name="description" content="Tides &amp; ferries"></head><body><p>Low water at noon.</p></body></html>'
)


def test_basic_page(spark):
    table = spark.createDataFrame([(BASIC,)], "html string")
    row = content.with_content(content.with_metadata(table), ALL).first()
    found = (row.title, row.language_code, row.author, row.description)
    assert found == ("Harbour notes", "en-GB", "A. Writer", "Tides & ferries")
    assert row.text == "Low water at noon."
    assert row.markdown == "Harbour notes\n\nLow water at noon."
    assert row.html_out == (
        '<html lang=""><head><title>Harbour notes</title></head><body><p>Low water at noon.</p></body></html>'
    )


def test_metadata_out_of_odd_markup(spark):
    pages = [
        "<!-- <title>old</title> --><title>new</title><meta name=author content=plain>",
        "<html lang=\"en\" xml:lang=\"de\"><title>Caf&eacute; &#8211; menu</title><meta content='a > b' name=author>",
        "<title> spaced  out\n</title><meta name=description content=''><script>var t='<meta name=author content=x>';</script>",
        "<p>no head</p>",
    ]
    table = spark.createDataFrame(list(enumerate(pages)), "n int, html string")
    rows = content.with_metadata(table).orderBy("n").collect()
    assert [(r.title, r.author, r.description, r.language_code) for r in rows] == [
        ("new", "plain", None, None), ("Café – menu", "a > b", None, "en"), (" spaced  out\n", None, None, None),
        ("", None, None, None),
    ]


def test_removal_keeps_up_with_the_page(spark):
    """Ten times the page takes at most twelve times as long, and nothing like its square."""
    pairs = lambda n: "".join(f'<p>text {i} <a href="/x">link</a></p><script>var a;</script>' for i in range(n))
    took = []
    for n in (800, 800, 8000):
        start = time.perf_counter()
        assert len(run(spark, [pairs(n)], S.ContentSettings(output_formats=("text",)))[0].text) > 10 * n
        took.append(time.perf_counter() - start)
    assert took[2] <= 12 * took[1]


def test_metadata_of_the_uncleaned_page(spark):
    html = (
        "<HTML xml:lang='x' LANG=de><title> A &amp;\n B </title><title>Two</title>"
        '<meta content="An &quot;x&quot;" name="description"><meta name=author content=\'Me\'><meta name="authors" content="no">'
    )
    row = content.with_metadata(spark.createDataFrame([(html,)], "html string")).first()
    assert (row.title, row.description, row.author, row.language_code) == (" A &\n B ", 'An "x"', "Me", "de")


PARTS = [
    "<nav>x</nav>", "<footer>x</footer>", "<script>x</script>", "<style>x</style>", "<noscript>x</noscript>",
    "<svg><path/><text>x</text></svg>", '<img src="data:image/png;base64,x">', '<p role="alert">x</p>',
    '<div role="banner">x</div>', "<div role=dialog>x</div>", '<div role="alertdialog">x</div>',
    '<section role="region" aria-label="Please SKIP this">x</section>', '<div aria-modal="true">x</div>',
    "<nav><nav>x</nav>x</nav>", '<div role="alert"><div>x<div>x</div></div></div>',
]


def test_default_selector_part_by_part(spark):
    rows = run(spark, [f"<body><p>a</p>{part}<p>b</p></body>" for part in PARTS])
    for part, row in zip(PARTS, rows):
        assert row.html_out.endswith("<body><p>a</p><p>b</p></body></html>"), part
        assert row.text == "a\n\nb", part


KEPT = [
    '<p role="alertx">x</p>', '<section role="region">x</section>', '<img src="https://x.example/data:">',
    '<div aria-modal="false">x</div>', "<header>x</header>", "<navx>x</navx>",
]


def test_what_the_default_selector_keeps(spark):
    for part, row in zip(KEPT, run(spark, [f"<body>{part}</body>" for part in KEPT])):
        assert re.search("x", row.html_out.split("<body>")[1]), part


@pytest.mark.parametrize("selector", ["p:first-child", "a + b", "a ~ b", "p::before", "", ">p", "[x", "a >"])
def test_unsupported_selectors_fail_when_planned(spark, selector):
    with pytest.raises(ValueError):
        css.matching(F.col("e"), selector)


SELECTED = [
    ("p", 3), ("*", 9), (".a", 2), (".a.b", 1), ("#i", 1), ("div p", 2), ("div > p", 1), ("section p.a", 1),
    ("div section > p", 1), ("[data-k]", 2), ('[data-k="V w"]', 1), ("[data-k^='V']", 1), ('[data-k$="w"]', 1),
    ('[data-k*="z" i]', 1), ('[data-k*="z"]', 0), ("[class~=b]", 1), ("p, div", 4), ("img[src^='data:']", 1),
    ('[data-k*="a,b"], #i', 1),
]
SAMPLE = (
    '<body><div id="i"><p class="a b">1</p><section><p class="a">2</p></section></div><p data-k="V w">3</p>'
    '<img src="data:x" data-k="Z"></body>'
)


def test_selectors(spark):
    events = spark.createDataFrame([(SAMPLE,)], "h string").select(html_events(F.col("h")).alias("e")).withColumn("e", F.col("e"))
    counts = events.select(*[F.size(css.matching(F.col("e"), s)).alias(str(i)) for i, (s, _) in enumerate(SELECTED)])
    # "*" also matches the implied root
    assert {s: n for (s, _), n in zip(SELECTED, counts.first())} == dict(SELECTED) | {"*": counts.first()[1]}


def test_selectors_in_a_column_agree_with_constant_ones(spark):
    more = ["div>p , section p", "body > div section > p.a", "[data-k='a > b'] p, p", "div div, body *", "#i p"]
    usable = [s for s, _ in SELECTED] + [S.DEFAULT_REMOVE_SELECTOR, *more]
    table = spark.createDataFrame([(s, SAMPLE) for s in usable], "s string, h string")
    events = table.withColumn("e", html_events(F.col("h")))
    got = events.select("s", F.size(css.matching_column(F.col("e"), F.col("s"))).alias("n"), css.is_supported(F.col("s")).alias("ok"))
    rows = {r.s: r for r in got.collect()}
    assert all(r.ok for r in rows.values())
    constant = events.limit(1).select(*[F.size(css.matching(F.col("e"), s)).alias(str(i)) for i, s in enumerate(usable)]).first()
    assert {s: rows[s].n for s in usable} == dict(zip(usable, constant))


UNSUPPORTED = ["p:first-child", "a + b", "a ~ b", "p::before", "", ">p", "[x", "a >", "a > > b", "a,,b", "a, > b"]


def test_unsupported_selectors_in_a_column(spark):
    table = spark.createDataFrame([(s,) for s in UNSUPPORTED], "s string")
    assert [r[0] for r in table.select("s").where(css.is_supported(F.col("s"))).collect()] == []


def test_combinators_in_a_column_on_random_trees(spark):
    selectors = ["div section > p", "section > div p, article a", "div div div", "section *", "article > section > div", "p > a"]
    table = spark.createDataFrame([(s, _random_page(k)) for k in range(25) for s in selectors], "s string, h string")
    events = table.withColumn("e", html_events(F.col("h")))
    ids = lambda found: F.transform(found, lambda m: m["id"])
    constant = F.lit(None).cast("array<int>")
    for s in selectors:
        constant = F.when(F.col("s") == s, ids(css.matching(F.col("e"), s))).otherwise(constant)
    got = events.select(ids(css.matching_column(F.col("e"), F.col("s"))).alias("a"), constant.alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(len(r.a) for r in got) > 200


def test_combinators_reach_around_the_body(spark):
    page = "<html><body class=k><p>a</p><div><p>b</p></div></body></html>"
    for selector, text in (("body > p", "b"), ("html .k div p", "a"), (".k > div", "a"), ("div > body p", "a\n\nb")):
        constant = run(spark, [page], S.ContentSettings(remove_selector=selector, output_formats=("text",)))[0].text
        rows = spark.createDataFrame([(page, selector)], "html string, remove_elements_css_selector string")
        assert constant == content.with_content(rows, S.ContentSettings(output_formats=("text",))).first().text == text


def test_row_selectors_keep_up_with_the_page(spark):
    took = []
    for n in (800, 800, 8000):
        html = "<body>" + "".join(f"<div><section><p>text {i} <a>x</a></p></section></div>" for i in range(n)) + "</body>"
        frame = spark.createDataFrame([(html, "div section a, body > p", 1)], "html string, remove_elements_css_selector string, n int")
        start = time.perf_counter()
        row = content.with_content(frame, S.ContentSettings(output_formats=("text",))).first()
        took.append(time.perf_counter() - start)
        assert " x" not in row.text and row.text.count("text") == n
    assert took[2] <= 12 * took[1]


def test_settings_per_row(spark):
    page = "<body><h1>T</h1><p class='x y'>a</p><p id=i>b</p><nav>n</nav></body>"
    columns = "n int, html string, remove_elements_css_selector string, html_transformer string, readable_char_threshold bigint"
    rows = [
        (0, page, S.DEFAULT_REMOVE_SELECTOR, "none", 100), (1, page, ".x, nav", "none", 100), (2, page, "[id='i'], p.x.y", None, None),
        (3, page, "p:hover", "none", 100), (4, ARTICLE, "ul", "readableText", 100), (5, ARTICLE, "ul", "readableText", 5000),
        (6, page, None, "none", 100), (7, page, "body > p#i, body nav, h1 p", "none", 100),
    ]
    got = content.with_content(spark.createDataFrame(rows, columns), ALL).orderBy("n").collect()
    assert [r.text for r in got[:4]] == ["T\n\na\n\nb", "T\n\nb", "T\n\nn", None]
    assert got[4].text.startswith("The first") and "note" not in got[4].text and "note" in got[5].text
    assert got[6].text == got[0].text and got[7].text == "T\n\na"


TREES = [
    ("<p>a<p>b", "<p>a</p><p>b</p>"),
    ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"),
    ("<p><b>x<p>y</b>z", "<p><b>x</b></p><p><b>y</b>z</p>"),
    ("<b>x</i>y</b>", "<b>x</b>".replace("x", "xy")),
    ("a < b & c &lt; d", "a &lt; b &amp; c &lt; d"),
    ("<br/><img alt='\"q\"' src=x>", '<br><img alt="&quot;q&quot;" src="x">'),
    ("<!-- <p>no</p> -->yes<!-- open", "yes"),
    ("</p></div>text", "text"),
    ('<a href="x>y">t</a>', '<a href="x&gt;y">t</a>'),
    ("<dl><dt>t<dd>d<dt>u</dl>", "<dl><dt>t</dt><dd>d</dd><dt>u</dt></dl>"),
    ("<script>if (a < b) '</p>'</script>ok", "ok"),
    ("", ""),
]


def test_trees_are_well_formed(spark):
    rows = run(spark, [f"<html><body>{h}</body></html>" for h, _ in TREES], S.ContentSettings(output_formats=("html",)))
    for (source, expected), row in zip(TREES, rows):
        assert row.html_out == f'<html lang=""><head><title></title></head><body>{expected}</body></html>', source


def test_pages_without_body_or_content(spark):
    rows = run(spark, ["just <b>text</b>", "", None, "<title>T</title><p>x"])
    assert [r.text for r in rows] == ["just text", "", "", "x"]
    assert rows[0].markdown == "just **text**" and rows[1].markdown is None
    assert rows[3].markdown == "T\n\nx"


MARKDOWN = [
    ("<h1>A</h1><h3>B <i>c</i></h3>", "# A\n\n### B _c_"),
    ("<p>a <strong>b </strong>c<em> d</em></p>", "a **b** c _d_"),
    ("<p>x<br>y<br></p>", "x  \ny"),
    ("<p><a href='/u'>l</a> <a>n</a> <img src='i.png' alt='t'></p>", "[l](/u) n ![t](i.png)"),
    ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "*   a\n*   b\n    *   c"),
    ("<ol><li>a</li><li>b</li></ol><ol start='7'><li>c</li></ol>", "1.  a\n2.  b\n\n7.  c"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "*   a\n\n    b"),
    ("<blockquote><p>a</p><blockquote>b</blockquote></blockquote><p>c</p>", "> a\n>\n> > b\n\nc"),
    ("<pre><code class='language-js'>a  b\n\n\n*c*\n</code></pre>", "```js\na  b\n\n\n*c*\n```"),
    ("<p>run <code>a_b*</code></p>", "run `a_b*`"),
    ("<hr><p>x</p>", "* * *\n\nx"),
    ("<p># no * [x] _y_ `z` \\</p><p>1. a</p><p>- b</p>", "\\# no \\* \\[x\\] \\_y\\_ \\`z\\` \\\\\n\n1\\. a\n\n\\- b"),
    (
        "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1|2</td><td><p>x</p><p>y</p></td></tr></tbody></table>",
        "| A | B |\n| --- | --- |\n| 1\\|2 | x y |",
    ),
    ("<p><del>old</del> <s>x</s></p>", "~~old~~ ~~x~~"),
    ("<ul><li><input type='checkbox' checked> done</li><li><input type=checkbox> open</li></ul>",
     "*   [x] done\n*   [ ] open"),
    ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
    ("<p><b><b>x</b></b></p>", "**x**"),
    ("<p><b></b>x</p>", "x"),
]


def test_markdown(spark):
    for (source, expected), row in zip(MARKDOWN, run(spark, [f"<body>{h}</body>" for h, _ in MARKDOWN])):
        assert row.markdown == expected, source


def test_gfm_only_up_to_the_limit(spark):
    shell = '<html lang=""><head><title></title></head><body></body></html>'
    parts = "<table><tr><th>A</th></tr><tr><td>1</td></tr></table><p><del>x</del></p>"
    pages = [f"<body>{parts}<p>{'y' * (S.MAX_GFM_CHARS - len(shell) - len(parts) - 7 + extra)}</p></body>" for extra in (0, 1)]
    rows = run(spark, pages)
    assert [len(r.html_out) for r in rows] == [100_000, 100_001]
    assert rows[0].markdown.startswith("| A |\n| --- |\n| 1 |\n\n~~x~~\n\ny")
    assert rows[1].markdown.startswith("A\n\n1\n\nx\n\ny")
    assert all(r.markdown.endswith("yyy") and r.text.endswith("yyy") for r in rows)


def test_oversize_pages_keep_their_bare_text(spark):
    html = "<p>a</p><p>b &amp; c</p>"
    sizes = spark.createDataFrame([(html,)], "h string").select(
        content.text_or_raw(F.col("h"), len(html)), content.text_or_raw(F.col("h"), len(html) - 1)
    )
    assert tuple(sizes.first()) == ("a\n\nb & c", "ab & c")


def test_native_and_tree_text_agree(spark, root):
    pages = spark.read.parquet(f"{root}/pages.parquet")
    tags_only = S.ContentSettings(remove_selector="script, style, noscript, svg, nav, footer", output_formats=("text",))
    by_tree = content.with_content(pages, tags_only)
    both = by_tree.select("text", native.layout(content.native_body(F.col("html"))).alias("native"))
    assert both.filter("text <> native").count() == 0 and both.count() == 50


ARTICLE = (
    "<body><div class='menu'><ul>" + "".join(f"<li><a href='/{i}'>A rather long menu entry, number {i}</a></li>" for i in range(12))
    + "</ul></div><main><article><p>" + "The first paragraph, with commas, and some length. " * 4
    + "</p><p>" + "The second paragraph, just as long, and just as dull. " * 4
    + "</p></article></main><div><p>A short note at the end, nothing more.</p></div></body>"
)


def test_main_content(spark):
    settings = S.ContentSettings(output_formats=("text", "markdown"), html_transformer="readableText")
    titled = ARTICLE.replace("<body>", "<head><title>T & t</title></head><body>")
    main, fallback, empty = run(spark, [titled, "<body><p>Too short, but there.</p></body>", "<body></body>"], settings)
    assert main.text.startswith("T & t\n\nThe first paragraph") and main.text.endswith("just as dull.")
    assert "menu" not in main.text and "short note" not in main.text
    assert main.markdown.startswith("# T & t\n\nThe first paragraph")
    assert fallback.text == "Too short, but there." and empty.text == ""


def test_blocks_table_moves_nothing(spark):
    table = spark.createDataFrame([(1, ARTICLE)], "page_id bigint, html string")
    blocks = content.blocks_table(table, "page_id")
    rows = blocks.orderBy("block_no").collect()
    assert [r.tag for r in rows[:2]] == ["li", "li"] and rows[0].link_chars == len(rows[0].text)
    assert max(rows, key=lambda r: r.score).text.startswith("The ")
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()


FETCHED = (
    "response_id string, unique_key string, query string, url string, loaded_url string, status int, content_type string, "
    "error string, created_at timestamp, loaded_at timestamp, search_result " + __import__("pageflow.schemas").schemas.SEARCH_RESULT
    + ", html string"
)


def fetched(spark):
    t = datetime.datetime(2024, 1, 1)
    types = ["text/html; charset=utf-8", "application/xml", "application/json", "TEXT/HTML", None]
    rows = [("r", f"k{i}", "q", "http://a.example/", "http://b.example/", 200 + i, c, None, t, t, None, BASIC) for i, c in enumerate(types)]
    rows += [("r", "k5", "q", "http://a.example/", None, None, "text/html", "boom", t, t, None, None)]
    rows += [(None, "k6", "q", "http://a.example/", None, None, None, "boom", t, t, None, None)]
    return spark.createDataFrame(rows, FETCHED)


def test_three_outcomes_share_one_schema(spark):
    extract = lambda df: content.with_content(content.with_metadata(df), S.ContentSettings(output_formats=("text",)))
    records = content.all_records(fetched(spark), extract)
    rows = {r.unique_key: r for r in records.collect()}
    # no response waits for k6, so its failure is not recorded
    assert sorted(rows) == ["k0", "k1", "k2", "k3", "k4", "k5"]
    assert [rows[f"k{i}"].crawl.request_status for i in range(6)] == ["handled"] * 2 + ["failed"] * 4
    ok, skipped, failed = rows["k1"], rows["k2"], rows["k5"]
    assert ok.text == "Low water at noon." and ok.crawl.http_status_message == "OK" and ok.crawl.http_status_code == 201
    assert ok.metadata.redirected_url == "http://b.example/" and ok.markdown is None and ok.html is None
    assert (skipped.text, skipped.metadata.title, skipped.crawl.http_status_message) == ("", None, S.MSG_UNPARSEABLE)
    assert (failed.text, failed.metadata.title, failed.crawl.http_status_code, failed.query) == ("", "", 500, None)
    assert failed.crawl.http_status_message == "boom"


def test_unread_pages_never_reach_the_tree_walk(spark):
    plan = content.all_records(fetched(spark), lambda df: content.with_content(content.with_metadata(df), ALL))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    walk = text.index("ArrowEvalPython")
    assert "content_type" in text[walk:].split("\n")[1] or "content_type" in text[walk:].split("\n")[2]


def test_one_walk_per_page(spark):
    table = spark.createDataFrame([(1, "<p>x")], "n int, html string")
    plan = content.with_content(table, ALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_deep_and_odd_markup_ends(spark):
    odd = ["<div>" * 3000 + "x", "<b>" * 500 + "<p>x" * 200, "<table>" * 50 + "<td>x", "<li>" * 500 + "x", "<" * 5000 + "x"]
    rows = run(spark, odd, S.ContentSettings(output_formats=("text",)))
    assert all("x" in r.text for r in rows)


def test_bind_evaluates_once(spark):
    value = bind(F.rand(), lambda r: F.array(r, r, r))
    row = spark.range(1).select(value.alias("v")).first()
    assert len(set(row.v)) == 1 and len(row.v) == 3


def test_render_of_nothing(spark):
    row = spark.createDataFrame([("",)], "h string").select(html_events(F.col("h")).alias("e")).select(
        render.to_html(render.body_events(F.col("e"))).alias("h"),
        F.size(render.blocks(F.col("e"), F.col("e"), F.lit(True))).alias("n"),
    ).first()
    assert row.h in (None, "") and row.n <= 0


def _random_page(seed):
    rng = random.Random(seed)
    words = "one, two three four, five six seven eight nine ten eleven twelve".split()

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
            return f"<p>{text} <a href='/x'>{' '.join(rng.choice(words) for _ in range(rng.randrange(0, 9)))}</a></p>"
        tag = rng.choice(["div", "section", "article"])
        return f"<{tag}>{''.join(part(depth - 1) for _ in range(rng.randrange(1, 5)))}</{tag}>"

    return f"<html><body>{''.join(part(4) for _ in range(rng.randrange(1, 4)))}</body></html>"


def test_main_element_equals_brute_force(spark):
    pages = spark.createDataFrame([(k, _random_page(k)) for k in range(40)], "page_id bigint, html string")
    events = F.col("events")
    found = pages.select("page_id", html_events(F.col("html")).alias("events")).select(
        "page_id", "events", render.blocks(render.body_events(events), events, F.lit(True)).alias("blocks")
    )
    rows = found.select("*", content.main_element(F.col("blocks"), events).alias("main")).collect()
    some = 0
    for row in rows:
        votes = {}
        for b in row.blocks:
            if len(b.text) >= 25:
                score = 1.0 + b.text.count(",") + min(len(b.text) // 100, 3)
                for element, share in ((b.parent, 1.0), (b.grand, 0.5)):
                    votes[element] = votes.get(element, 0.0) + score * share
        weights = []
        for element, total in votes.items():
            if element is None or element < 0:
                continue
            below = [b for b in row.blocks if element <= b.id <= row.events[element].last]
            chars, links = sum(len(b.text) for b in below), sum(b.link_chars for b in below)
            weights.append((total * (1 - (links / chars if chars else 0.0)), -element))
        assert row.main == (-max(weights)[1] if weights else None)
        some += bool(weights)
    assert some > 30


def test_main_content_keeps_up_with_the_page(spark):
    settings = S.ContentSettings(output_formats=("text",), html_transformer="readableText")

    def seconds(n):
        html = "<html><body><div>" + "".join(f"<p>Short prose number {i}, one two three.</p>" for i in range(n)) + "</div></body></html>"
        frame = spark.createDataFrame([(1, html)], "page_id bigint, html string")
        start = time.perf_counter()
        text = content.with_content(frame, settings).first().text
        assert text.count("Short prose") == n
        return time.perf_counter() - start

    seconds(100)
    small, large = seconds(1600), seconds(16_000)
    assert large < 12 * small and large < 30
