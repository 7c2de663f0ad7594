from collections import Counter

from llm_cases import documents, plain, words

from pageflow.llm import mixing
from pageflow.sources.tables import read_table


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, cut at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    fixed, left = set(), share * sum(sizes.values())
    while len(fixed) < len(names):
        free = [s for s in names if s not in fixed]
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        fixed.update(over)
    return target


def test_targets_equal_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1}, {"a": 0, "b": 9}, {f"s{k}": (k * 37) % 11 for k in range(20)}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        expected = _targets(sizes)
        assert all(abs(found[s] - expected[s]) < 1e-6 for s in sizes)


def test_words_come_near_the_targets(spark, root):
    rows = mixing.with_copies(read_table(spark, root, "documents").select("doc_id", "text", "source")).collect()
    assert all(0 <= r.copies <= 2 for r in rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source_size] += r.size * r.copies
        target[r.source_size] = r.target
        largest[r.source_size] = max(largest[r.source_size], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)


def test_odd_documents(spark):
    docs = documents(spark)
    found = mixing.with_copies(docs)
    assert Counter((r.doc_id, r.size) for r in found.collect()) == Counter((r.doc_id, len(words(r.text))) for r in docs.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in found.collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.mix(docs.limit(0)).count() == 0


def test_reruns_and_order_agree(spark):
    docs = plain(spark, [f"word {'x ' * (k % 17)}" for k in range(300)])
    first = sorted(map(tuple, mixing.with_copies(docs).collect()))
    assert first == sorted(map(tuple, mixing.with_copies(docs.orderBy("text").repartition(5)).collect()))
