import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pageflow.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, ids string, depth int, path string"


def _plain(rows, rebuild):
    """Nodes as the contract words them, by plain dictionaries."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0), digest, (role, text)))
    original = {c: [t for *_, t in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - int(c - int(c / 5) * 5)
        convs[c] = original.get(base, [])[:h] + own[h:] if rebuild else own
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
            if d:
                children[tuple(path[: d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)
    out = []
    for node in members:
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
            len(children[node]), sum(not children[n] for n in below), saved, digest,
        ))
    return sorted(out, key=str)


def _found(spark, rows, settings=tries.TrieSettings(), rebuild=True):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    convs = tries.encoded(table)
    found = tries.prefix_trie(tries.rebuilt(convs) if rebuild else convs, settings).select(*tries.RESULT)
    return sorted((tuple(r) for r in found.collect()), key=str)


def _talks(n=120, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, n):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "Grüße", ""])))
    return rows


TINY = tries.TrieSettings(shard_turns=7, piece_ids=3)


@pytest.mark.parametrize("settings", [tries.TrieSettings(), TINY])
@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_plain_dictionaries(spark, settings, rebuild):
    rows = _talks()
    assert _found(spark, rows, settings, rebuild) == _plain(rows, rebuild)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "z"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (2, 1, "", "x"), (3, 1, None, "x"),
        (None, 1, "user", "a"), (None, None, None, None), (4, 5, "user:1", "b"), (6, 5, "user", ":1b"), (-4, 2, "user", "long " * 40_000),
        (11, 1, "user", "a"), (11, 1, "assistant", "b"), (11, 1, "user", "a"),
    ]
    for settings in (tries.TrieSettings(), TINY):
        assert _found(spark, rows, settings) == _plain(rows, True)
        assert _found(spark, rows, settings, False) == _plain(rows, False)


def test_many_copies_and_one_deep_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)]
    rows += [(1000, t, "user", f"deep {t}") for t in range(70)] + [(1001, t, "user", f"deep {t}") for t in range(69)]
    assert _found(spark, rows, TINY, False) == _plain(rows, False)


def test_empty_table(spark):
    assert _found(spark, []) == []


def test_tree_is_balanced_by_medians():
    rows = [{"ids": [i], "sizes": [1], "n": 1, "conv_id": i, "ends_sha256": ""} for i in range(1023)]
    tree = tries.TernaryTree()
    for i in tries._medians(len(rows)):
        r = rows[i]
        tree.insert(r["ids"], r["sizes"], r["n"], r["conv_id"], r["ends_sha256"])

    def height(node):
        return 0 if not node else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.equal[0]) == 10
    assert [tree.key[node] for node, _, depth in tree.walk() if depth] == list(range(1023))
