import random

import numpy as np
import pytest
from llm_cases import documents, groups, plain, shingles

from pageflow.llm.components import components
from pageflow.llm.jaccard import (
    JaccardSettings,
    _able_to_link,
    folded,
    jaccard_components,
    member_lists,
    one_of_each,
    parity_marks,
    set_tiles,
    shingle_sets,
)
from pageflow.sources.shared import fresh_path
from pageflow.sources.tables import read_table


def _expected(texts, words=3, percent=90):
    sets = {i: shingles(t, words) for i, t in texts}
    links = []
    items = sorted(sets.items())
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                links.append((a, b))
    root = groups(links, sets)
    return {i: (len(sets[i]), root[i]) for i in sets}


def _found(frame, settings=JaccardSettings()):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, settings).collect()}


def _near_copies():
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for n in (1, 2, 3, 5, 12, 30, 80, 200, 600):
        for _ in range(4):
            base = random.choices(vocabulary, k=n)
            texts.append(" ".join(base))
            for edits in range(6):
                copy = list(base)
                for _ in range(edits * max(1, n // 60)):
                    copy[random.randrange(len(copy))] = random.choice(vocabulary)
                if edits % 2:
                    copy += random.choices(vocabulary, k=max(1, n // 30))
                texts.append(" ".join(copy).upper() if edits == 3 else "\n".join(copy))
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_links_equal_brute_force(spark, words, percent):
    texts = _near_copies()
    settings = JaccardSettings(words=words, percent=percent)
    assert _found(plain(spark, texts), settings) == _expected(enumerate(texts), words, percent)


def test_whole_table(spark, root):
    docs = read_table(spark, root, "documents")
    assert _found(docs) == _expected([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_that_leaders_do_not_see(spark):
    base = [f"t{k}" for k in range(400)]
    texts = []
    for shift in range(0, 120, 6):
        texts.append(" ".join(base[shift : shift + 280]))
    assert _found(plain(spark, texts)) == _expected(enumerate(texts))


def test_odd_documents(spark):
    docs = documents(spark)
    rows = jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id in (0, 1)} == {0}
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and {2, 3, 4} <= set(ids)
    assert jaccard_components(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = [(5, "a b c d", "en", "s", 7, "x", "y", 1, "z")] * 3 + [(6, "other words here", "en", "s", 9, "x", "y", 1, "z")]
    assert sorted(r.doc_id for r in one_of_each(documents(spark, rows)).collect()) == [5, 6]


def test_components_of_random_links(spark):
    random.seed(9)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    links += [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == groups(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_go_by_key_and_text(spark):
    base = " ".join(f"w{k}" for k in range(40))
    texts = [(1, base), (None, base.upper()), (None, "a clean text of its own"), (None, "another clean text here")]
    texts += [(2, base), (2, "the second text of key two"), (None, None), (None, " "), (None, " "), (None, "twice alike here")]
    texts += [(None, "twice alike here")]
    rows = [(i, t, "en", "s", 1, "x", "y", 1, "z") for i, t in texts]
    kept = [(r.doc_id, r.text) for r in one_of_each(documents(spark, rows)).collect()]
    expected = [texts[k] for k in (0, 2, 3, 5, 6, 7, 8, 9)]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def test_marks_never_differ_in_more_bits_than_their_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 3, 250, 300, 520, 800, 899)]
    marks = parity_marks(np.concatenate(sets), np.array([len(x) for x in sets]), 256, 1 << 15)
    assert [8 * len(m) for m in marks] == [256, 256, 256, 512, 1024, 1024, 1024]
    rows = folded(marks, 32)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = int(np.bitwise_count(rows[i] ^ rows[j]).sum())
            assert apart <= len(np.setxor1d(x, y)) and (i != j or apart == 0)


@pytest.mark.parametrize("window", [1, 7, 1 << 20])
def test_lists_hold_every_shared_tile_at_any_window(spark, window):
    random.seed(6)
    members = {t: {random.randrange(30) for _ in range(random.choice([1, 2, 2, 5, 40]))} for t in range(60)}
    members |= {t: {100, 101, 102} for t in range(100, 140)}
    rows = [(t, n) for t, nodes in members.items() for n in nodes for _ in range(random.choice([1, 3]))]
    tiles = spark.createDataFrame(rows, "tile long, node long")
    found = {}
    for r in member_lists(tiles, JaccardSettings(list_rows=window), fresh_path(spark, "test")).collect():
        found.setdefault((r.list, r.low), []).append(r)
    lists = {frozenset(r.node for r in rows) for rows in found.values()}
    assert {x for x in lists if len(x) > 1} == {frozenset(x) for x in members.values() if len(x) > 1}
    assert all(r.rows == len(rows) == len({r.node for r in rows}) for rows in found.values() for r in rows)
    if window > 1000:
        assert len(found) == len(lists) and all(len(x) > 1 for x in lists)


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_linked_sets_share_the_tiles_that_their_cuts_need(words, percent):
    settings = JaccardSettings(words=words, percent=percent)
    texts = [t.encode() for t in _near_copies()]
    hashes, sizes = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), settings)
    keys, sets, cuts, needs = set_tiles(hashes, sizes, settings)
    tiles = {}
    for k, s, c in zip(keys.tolist(), sets.tolist(), cuts.tolist(), strict=True):
        tiles.setdefault(s, {}).setdefault(c, set()).add(k)
    members = [set(x.tolist()) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
    linked = 0
    for x in range(len(members)):
        for y in range(len(members)):
            common = len(members[x] & members[y])
            if members[x] != members[y] and 100 * common >= percent * (len(members[x]) + len(members[y]) - common):
                other = set().union(*tiles[y].values())
                assert any(len(own & other) >= needs[c] for c, own in tiles[x].items())
                linked += 1
    assert linked > 10 and needs.min() >= 1 and needs.max() > 5


def test_members_that_share_too_few_tiles_leave_their_lists(spark):
    rows = [(1, 0, n, 2, 3) for n in (1, 2, 3)] + [(2, 0, n, 3, 2) for n in (1, 2)] + [(3, 0, n, 9, 2) for n in (3, 4)]
    lists = spark.createDataFrame(rows, "list long, low long, node long, tiles long, rows long")
    sets = spark.createDataFrame([(1, 5), (2, 5), (3, 11), (4, 10)], "node long, need long")
    left = _able_to_link(lists, sets, fresh_path(spark, "test"))
    assert {(r.list, r.node, r.rows) for r in left.collect()} == {(1, 1, 3), (1, 2, 3), (1, 3, 3), (2, 1, 2), (2, 2, 2)}


@pytest.mark.parametrize("part", [2, 5])
def test_lists_in_parts_equal_whole_lists(spark, part):
    texts = _near_copies()
    settings = JaccardSettings(words=5, percent=80, list_part=part)
    assert _found(plain(spark, texts), settings) == _expected(enumerate(texts), 5, 80)


def test_texts_stay_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = one_of_each(documents(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan
