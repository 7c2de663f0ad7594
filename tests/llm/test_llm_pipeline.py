from collections import Counter, defaultdict

import corpus_pipeline
from llm_cases import documents, groups, plain, shingles, words

from pageflow.llm import quality
from pageflow.sources.shared import staged
from pageflow.sources.tables import read_table


def test_stages_equal_plain_python(spark, root):
    docs = read_table(spark, root, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "packing"]

    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    good = staged(stages["quality rules"](spark, docs, root), "test")
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns

    rows = good.collect()
    total, held = Counter(r.source for r in rows), Counter()
    for r in rows:
        held.update((r.source, x) for x in set(r.text.split("\n")) if words(x))
    bad = {(s, x) for (s, x), n in held.items() if n >= 5 and n > total[s] * 0.01}
    expected = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in bad) for r in rows}
    clean = staged(stages["line dedup"](spark, good, root), "test")
    assert {r.doc_id: r.text for r in clean.collect()} == expected and clean.columns == docs.columns

    sets = {i: shingles(t, 5) for i, t in expected.items()}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    common = Counter((a, b) for ids in by_shingle.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    root_of = groups(links, sets)
    single = staged(stages["n-gram Jaccard join"](spark, clean, root), "test")
    assert {r.doc_id for r in single.collect()} == {i for i in sets if root_of[i] == i}

    mixed = staged(stages["mixing"](spark, single, root), "test")
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    packed = stages["packing"](spark, mixed, root).collect()
    whole = Counter()
    for p in packed:
        whole[p.doc_id] += p.length
    assert whole == {i: n * next(p.doc_tokens for p in packed if p.doc_id == i) for i, n in Counter(r.doc_id for r in mixed.collect()).items()}


def test_line_stage_drops_what_stands_on_more_than_one_percent_of_a_source(spark, root):
    shared = {"on fifteen pages": 15, "on ten pages": 10, "on nine pages": 9, "on a third": 333}
    texts = ["\n".join([f"own line {i}"] + [line for line, n in shared.items() if i < n] + [f"own end {i}"]) for i in range(1000)]
    docs = plain(spark, texts)
    out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, root).collect()}
    kept = {"on ten pages", "on nine pages"}
    assert out == {i: "\n".join(x for x in t.split("\n") if x not in shared or x in kept) for i, t in enumerate(texts)}


def test_every_stage_takes_odd_and_empty_documents(spark, root):
    for frame in (documents(spark), documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, root)
            out.collect()
            if name != "packing":
                assert out.columns == frame.columns


def test_texts_go_to_python_in_small_batches(spark, root):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for stage in ("quality rules", "n-gram Jaccard join", "packing"):
            spark.conf.set(name, "10000")
            dict(corpus_pipeline.STAGES)[stage](spark, plain(spark, ["a few words"]), root)
            assert spark.conf.get(name) == "2000"
        spark.conf.set(name, "500")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(name) == "500"
    finally:
        spark.conf.set(name, before)
