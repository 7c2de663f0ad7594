"""Result pages, filtering, de-duplication, pagination, ranking, BM25."""

import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageflow.operators import hits, search, serp
from pageflow.settings import SearchSettings
from pageflow.sources.shared import fresh_path

WRAPPED = {
    "hlcw0c": '<div class="hlcw0c">{}</div>',
    "two classes": '<div class="x g Ww4FFb">{}</div>',
    "MjjYud": '<div class="MjjYud">{}</div>',
    "child": '<div class="g"><div class="tF2Cxc"><div class="yuRUbf">{}</div></div></div>',
    "attribute": '<div class="g"><b data-header-feature="0">{}</b></div>',
    "descendant": '<div class="g"><i><span class="rc">{}</span></i></div>',
    "sATSHe": '<div class="sATSHe">{}</div>',
}
RESULT = '<a href="https://a.example/"><h3>Title <em>one</em></h3></a><span class="VwiC3b"> About\n it </span>'


def extract(spark, html):
    return serp.organic_results(spark.createDataFrame([(1, 0, html)], "query_id bigint, page int, html string")).collect()


def extract_all(spark, pages):
    table = spark.createDataFrame([(n, 0, h) for n, h in enumerate(pages)], "query_id bigint, page int, html string")
    return serp.organic_results(table).orderBy("query_id", "pos").collect()


def test_each_kind_of_result(spark):
    rows = extract_all(spark, [f"<body>{w.format(RESULT)}</body>" for w in WRAPPED.values()])
    assert [(r.query_id, r.title, r.description, r.url, r.result_type) for r in rows] == [
        (n, "Title one", "About\n it", "https://a.example/", "ORGANIC") for n in range(len(WRAPPED))
    ]


NO_RESULT = [
    f'<div class="g">{RESULT}</div>',
    f'<div class="g"><div class="tF2Cxc"><p><div class="yuRUbf">{RESULT}</div></div></div>'.replace(
            '<p><div class="yuRUbf">', '<section><div class="yuRUbf">'
        ),
    f'<div class="Ww4FFb">{RESULT}</div>',
    '<div class="MjjYud"><a href="https://a.example/">no heading</a></div>',
    '<div class="MjjYud"><h3>No link</h3></div>',
    '<div class="MjjYud"><a href="/search?q=x"><h3>Inner search</h3></a></div>',
    '<div class="MjjYud"><a href="mailto:x@example.com"><h3>Mail</h3></a></div>',
    '<div class="MjjYud"><div class="action-menu">' + RESULT + "</div></div>",
    "",
]


def test_not_a_result(spark):
    assert extract_all(spark, NO_RESULT) == []


def test_relative_links_and_menus(spark):
    html = f'<div class="MjjYud"><div class="action-menu"><h3>Menu</h3><a href="https://m.example/"></a></div>{RESULT}</div>'
    html += '<div class="MjjYud"><a href="/about"><h3>About</h3></a></div>'
    assert [(r.title, r.url) for r in sorted(extract(spark, html), key=lambda r: r.pos)] == [
        ("Title one", "https://a.example/"),
        ("About", "/about"),
    ]


def test_nested_matches_count_once(spark):
    assert len(extract(spark, f'<div class="MjjYud"><div class="g Ww4FFb">{RESULT}</div></div>')) == 1


def test_suggestions(spark):
    page = '<div id="topstuff"><div class="fSp71d">{}</div></div><div class="MjjYud">' + RESULT + "</div>"
    rows = extract_all(spark, [page.replace("{}", inner) for inner in ("<p>none</p>", "only text", "")])
    assert [r.result_type for r in rows] == ["SUGGESTED", "ORGANIC", "ORGANIC"]


HIT = "query_id bigint, page bigint, pos bigint, title string, description string, url string, result_type string"


def frame(spark, rows):
    return spark.createDataFrame([(q, p, i, t, "d", u, "ORGANIC") for q, p, i, t, u in rows], HIT)


def test_first_of_equal_hits_stays(spark):
    rows = [(1, 0, 0, "a", "u"), (1, 1, 0, "a", "u"), (1, 0, 1, None, "u"), (1, 2, 0, None, "u"), (1, 0, 2, "a", "v")]
    once = hits.deduplicate(frame(spark, rows), "query_id")
    twice = hits.deduplicate(once, "query_id")
    kept = sorted((r.page, r.pos, r.title, r.url) for r in once.collect())
    assert kept == [(0, 0, "a", "u"), (0, 1, None, "u"), (0, 2, "a", "v")]
    assert sorted(once.collect()) == sorted(twice.collect())


def loop(pages, max_results):
    """Read page by page, as a person would."""
    total, collected, page = math.ceil(max_results / 10) + 1, [], 0
    while True:
        collected += [h for h in pages.get(page, []) if h not in collected]
        collected = list(dict.fromkeys(collected))
        if len(collected) >= max_results or page + 1 >= total or not pages.get(page):
            return collected[:max_results], page + 1
        page += 1


def test_pagination_equals_the_loop(spark):
    draw = random.Random(7)
    rows, searches, expected = [], [], {}
    for query in range(300):
        max_results = draw.choice([1, 3, 10, 11, 25, 100])
        pages = {}
        for page in range(13):
            if draw.random() < 0.85:
                pages[page] = [(f"t{draw.randrange(30)}", f"https://x.example/{draw.randrange(3)}") for _ in range(draw.randrange(11))]
        for page, found in pages.items():
            rows += [(query, page, i, t, u) for i, (t, u) in enumerate(found)]
        searches.append((query, max_results))
        expected[query] = loop(pages, max_results)
    asked = spark.createDataFrame(searches, "query_id bigint, max_results bigint")
    final, read = hits.paginate(frame(spark, rows), asked)
    got = {}
    for r in final.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.title, r.url))
    pages_read = {r.query_id: r.pages_read for r in read.collect()}
    for query, (found, n) in expected.items():
        mine = sorted(got.get(query, []))
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1))
        assert [x[1:] for x in mine] == found
        assert pages_read[query] == n


def test_empty_first_page_ends_the_search(spark):
    final, read = hits.paginate(
        frame(spark, [(1, 1, i, f"t{i}", "https://x.example/") for i in range(10)]),
        spark.createDataFrame([(1, 10)], "query_id bigint, max_results bigint"),
    )
    assert final.count() == 0 and read.first().pages_read == 1


def test_ranking_is_cut_before_the_shuffle(spark):
    plan = hits.ranked(frame(spark, [(1, 0, 0, "a", "u")]), F.lit(3))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def brute_force(phrases, docs, k1=1.2, b=0.75, top=3):
    split = lambda t: [w for w in re.split(r"[^a-z0-9\u00c0-\u00ff]+", t.lower()) if w]
    bags = {d: Counter(split(t)) for d, (_, t) in docs.items()}
    n, mean = len(docs), sum(sum(c.values()) for c in bags.values()) / len(docs)
    out = []
    for q, phrase in phrases.items():
        site = re.search(r"(?i)(?:^|\s)site:(\S+)", phrase)
        words = set(split(re.sub(r"(?i)(?:^|\s)site:(\S+)", " ", phrase)))
        scores = {}
        for d, bag in bags.items():
            host = docs[d][0]
            if site and not (host == site[1].lower() or host.endswith("." + site[1].lower())):
                continue
            total, hit = 0.0, False
            for w in words:
                df = sum(w in c for c in bags.values())
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                if bag[w]:
                    hit = True
                    total += idf * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * sum(bag.values()) / mean))
            if hit:
                scores[d] = round(total, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]
        out += [(q, d, s, i + 1) for i, (d, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1}, {"block_postings": 3, "lead_terms": 1}])
def test_search_equals_brute_force(spark, options):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["ñandú", "œuvre", "straße"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    docs = {d: (draw.choice(["a.example", "b.a.example", "ba.example"]), text(draw.randrange(1, 60)) + ". W1!") for d in range(60)}
    phrases = {q: text(draw.randrange(1, 6)) + (" site:a.example" if q % 3 == 0 else "") for q in range(30)}
    phrases[99] = "nowhere to be found"
    corpus = spark.createDataFrame([(d, h, t) for d, (h, t) in docs.items()], "doc_id bigint, host string, text string")
    asked = spark.createDataFrame(list(phrases.items()), "query_id bigint, phrase string")
    settings = SearchSettings(top_k=3, **options)
    index = search.write_postings(search.build_index(corpus), fresh_path(spark, "test-index"), settings)
    found = search.search(asked, index, settings)
    mine = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect())
    assert mine == brute_force(phrases, docs)


def _indexed(spark, docs, settings=SearchSettings()):
    corpus = spark.createDataFrame([(d, h, t) for d, (h, t) in docs.items()], "doc_id bigint, host string, text string")
    return search.write_postings(search.build_index(corpus), fresh_path(spark, "test-index"), settings)


def test_words_of_every_document_have_results(spark):
    docs = {d: ("a.example", "the sea " * (d + 1) + "x " * 20) for d in range(12)}
    asked = spark.createDataFrame([(1, "the"), (2, "the sea")], "query_id bigint, phrase string")
    settings = SearchSettings(top_k=5)
    found = search.search(asked, _indexed(spark, docs, settings), settings)
    mine = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect())
    assert mine == brute_force({1: "the", 2: "the sea"}, docs, top=5) and len(mine) == 10


def test_weak_blocks_are_not_read(spark):
    """Of a hot term only the blocks that can reach the threshold meet the phrase."""
    docs = {d: ("a.example", "hot " * (1 + 40 * (d < 8)) + "fill " * (10 + d % 7)) for d in range(400)}
    settings = SearchSettings(top_k=4, block_postings=8)
    index = _indexed(spark, docs, settings)
    read = []
    usual = search._summed

    def counting(blocks, weights, of):
        summed = usual(blocks, weights, of)
        read.append(summed.count())
        return summed

    search._summed = counting
    try:
        found = search.search(spark.createDataFrame([(1, "hot")], "query_id bigint, phrase string"), index, settings)
        mine = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect())
    finally:
        search._summed = usual
    assert mine == brute_force({1: "hot"}, docs, top=4)
    assert read[1] < 100  # of 400 documents, all of which hold the term


HOSTS = ["a.example", "b.a.example", "ba.example", "example", "a.example.org", "c.b.a.example", "", "a-b.example", "a0.example"]


def test_sites_are_intervals(spark):
    docs = {d: (HOSTS[d % len(HOSTS)], f"word w{d}") for d in range(60)}
    sites = ["a.example", "example", "b.a.example", "org", "nobody.example", "A.Example", "a-b.example"]
    phrases = {q: f"word site:{s}" for q, s in enumerate(sites)}
    asked = spark.createDataFrame(list(phrases.items()), "query_id bigint, phrase string")
    settings = SearchSettings(top_k=60, block_postings=4)
    index = _indexed(spark, docs, settings)
    found = search.search(asked, index, settings)
    mine = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect())
    assert mine == brute_force(phrases, docs, top=60)
    bounds = search.site_intervals(spark.createDataFrame([("a.example",), ("zz",)], "site string"), index.documents).collect()
    held = index.documents.collect()
    by_site = {r.site: sorted(d.doc_id for d in held if r.low <= d.doc_no < r.high) for r in bounds}
    assert by_site == {"a.example": sorted(d for d, (h, _) in docs.items() if h == "a.example" or h.endswith(".a.example")), "zz": []}


def test_only_asked_postings_move(spark):
    """Blocks are cut to the vocabulary before their exchange, hosts are not exploded, and no pair moves before the cut."""
    docs = {d: ("a.example", f"word w{d}") for d in range(30)}
    asked = spark.createDataFrame([(1, "word site:example")], "query_id bigint, phrase string")
    plan = search.search(asked, _indexed(spark, docs))._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"Exchange (?:hash|range)partitioning\((\w+)#", plan)
    assert moves == ["query_id", "shard"]
    below = plan[plan.index("rangepartitioning(shard") :]
    assert "LeftSemi" in below and "Generate" not in below and "explode(host" not in plan
    assert "WindowGroupLimit" in plan[: plan.index("hashpartitioning(query_id")]


def test_a_shard_hands_on_no_more_than_a_phrase_keeps(spark):
    """Sums are made where the shard lies: of 300 copies and 60 others no more than the best of each shard leave it."""
    docs = {d: ("a.example", "hot sea " + "fill " * (7 if d < 300 else d % 50)) for d in range(360)}
    settings = SearchSettings(top_k=5)
    index = _indexed(spark, docs, settings)
    weights = spark.createDataFrame([(1, "hot", 2.0, 0, 1 << 62, 0.0), (1, "sea", 1.0, 0, 1 << 62, 0.0)], "query_id bigint, term string, idf double, low bigint, high bigint, threshold double")
    summed = search._summed(index.blocks, weights, settings)
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and summed.count() <= 5 * index.blocks.select("shard").distinct().count()
    found = search.search(spark.createDataFrame([(1, "hot sea")], "query_id bigint, phrase string"), index, settings)
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()) == brute_force({1: "hot sea"}, docs, top=5)


def test_index_counts_terms_in_the_row(spark):
    corpus = spark.createDataFrame([(1, "h", "b a B, c-b")], "doc_id bigint, host string, text string")
    row = search.build_index(corpus).first()
    assert row.doc_length == 5 and [(p.term, p.tf) for p in row.postings] == [("a", 1), ("b", 3), ("c", 1)]
    assert "Exchange" not in search.build_index(corpus)._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_made_once(spark):
    """Ranges are found by a pass over their input, which must not be the walk of every page."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = [(i, f"h{i % 7}.example", f"word{i % 5} common text {i}") for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, host string, text string")
    corpus = corpus.withColumn("text", F.udf(counted, "string")("text"))
    stored = search.write_postings(search.build_index(corpus), fresh_path(spark, "once"), SearchSettings(block_postings=4))
    assert seen.value == len(rows)
    blocks = stored.blocks.collect()
    assert sum(b.leads for b in blocks) == len({(b.shard, b.term) for b in blocks})
    assert all([-p.impact for p in b.postings] == sorted(-p.impact for p in b.postings) for b in blocks)
    assert {r.term: r.df for r in stored.terms.collect()}["common"] == 60


def test_terms_are_counted_as_plain_python_counts_them():
    texts = ["b a b\u00fcb a", None, "", " ,. \u00d7", "\u00e0\u00e9 \u6771abc\u4eac9 \u0101x", "a" * 70 + " zz", "a"]
    lower = pa.array(texts).slice(1)
    found = search._term_counts(lower).to_pylist()
    for text, row in zip(texts[1:], found, strict=True):
        words = [w for w in re.split(r"[^a-z0-9\u00c0-\u00ff]+", text or "") if w]
        counts = sorted(Counter(words).items(), key=lambda x: x[0].encode())
        assert row["doc_length"] == (None if text is None else len(words))
        assert row["postings"] == (None if text is None else [{"term": t, "tf": n} for t, n in counts])


@pytest.mark.parametrize("options", [{"shards_a_lead": 1}, {"shards_a_lead": 3, "block_postings": 2}])
def test_best_of_each_kind_equals_brute_force(spark, options, monkeypatch):
    """Copies count once and what has no kind not at all, within the shards and across; few rows leave a shard."""
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choices([f"w{i}" for i in range(30)], [1 / (i + 1) for i in range(30)], k=n))
    bodies = [text(draw.randrange(3, 30)) for _ in range(40)]
    docs = {d: (draw.choice(["a.example", "b.example"]), bodies[d % 40] if d % 3 else "w0 w1 w2 w3") for d in range(300)}
    kind = {d: zlib.crc32(repr(docs[d]).encode()) if d % 7 else None for d in docs}
    phrases = {q: text(draw.randrange(1, 9)) + (" site:a.example" if q % 4 == 0 else "") for q in range(40)}
    settings = SearchSettings(top_k=6, shard_documents=40, **options)
    index = _indexed(spark, docs, settings)
    named = spark.createDataFrame([(d, k) for d, k in kind.items() if k is not None], "doc_id bigint, kind bigint")
    kinds = index.documents.join(named, "doc_id").select("shard", "doc_no", "kind")
    asked = spark.createDataFrame([(q, p, q % 8 + 1) for q, p in phrases.items()], "query_id bigint, phrase string, wanted bigint")
    read = []
    usual = search._summed
    monkeypatch.setattr(search, "_summed", lambda *a: read.append(usual(*a)) or read[-1])
    rows = search.search(asked, index, settings, kinds).collect()
    found = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in rows}
    expected = {}
    for q, d, score, _ in sorted(brute_force(phrases, docs, top=1000), key=lambda x: (x[0], -x[2], x[1])):
        if kind[d] is not None and kind[d] not in (seen := expected.setdefault(q, {})):
            seen[kind[d]] = (d, score)
    for q in phrases:
        best = list(expected.get(q, {}).values())[: min(q % 8 + 1, 6)]
        assert [found.get((q, k + 1)) for k in range(len(best))] == best
    shards = index.documents.select("shard").distinct().count()
    assert read[-1].count() <= sum(min(q % 8 + 1, 6) for q in phrases) * shards


def test_a_phrase_without_a_number_has_results(spark):
    docs = {d: ("a.example", f"word w{d % 5} " * (d % 3 + 1)) for d in range(30)}
    asked = spark.createDataFrame([(None, "word w1"), (1, "w1")], "query_id bigint, phrase string")
    rows = search.search(asked, _indexed(spark, docs, SearchSettings(top_k=4)), SearchSettings(top_k=4)).collect()
    found = sorted((r.doc_id, r.score, r["rank"]) for r in rows if r.query_id is None)
    assert found == sorted(x[1:] for x in brute_force({0: "word w1"}, docs, top=4))


def test_searches_hand_out_few_rows_at_a_time(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in zip(names, ("10000", "300"), strict=True):
            spark.conf.set(n, value)
        _indexed(spark, {d: ("a.example", f"word w{d}") for d in range(9)})
        assert [spark.conf.get(n) for n in names] == ["500", "300"]
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
