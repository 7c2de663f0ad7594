import random
import re
from collections import Counter

import pytest
from llm_cases import documents, odd_documents, plain

from pageflow.llm import collocations as co


def _plain(rows, settings):
    """(lang, text) rows to result rows, by plain dictionaries."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at : at + size])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= settings.least}
    held = Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                part = lang, words[at : at + size]
                held[part] = max(held[part], a)
    by_lang = {}
    for (lang, words), a in candidates.items():
        if 100 * held[lang, words] >= settings.held_percent * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((settings.scale * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in by_lang.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[: settings.top], 1)
    )


def _found(docs, settings):
    return sorted(tuple(r) for r in co.collocations(docs, settings).collect())


def _texts(n=150, seed=5):
    rng = random.Random(seed)
    common = ["the", "Of", "and", "a"]
    rare = [f"w{i}" for i in range(60)]
    fixed = ["new york city hall", "Strong TEA", "once upon a time", "über alles", "naïve bayes"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 90)):
            words += [rng.choice(common)] if rng.random() < 0.4 else [rng.choice(fixed)] if rng.random() < 0.4 else [rng.choice(rare)]
            words.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
        out.append("".join(w if w.strip() == "" or w in ". ," else w + " " for w in words))
    return out


@pytest.mark.parametrize(
    "settings",
    [co.CollocationSettings(least=5), co.CollocationSettings(least=2, top=7, range_keys=16, row_keys=1), co.CollocationSettings()],
)
def test_equals_plain_dictionaries(spark, settings):
    texts = _texts()
    rows = [(None if i % 11 == 0 else "und" if i % 7 == 0 else "en" if i % 3 else "de", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, words string, f string")
    found = _found(docs.repartition(5), settings)
    assert found and found == _plain(rows, settings)


def test_odd_documents(spark):
    rows = [(lang, text) for _, text, lang, *_ in odd_documents()]
    for settings in (co.CollocationSettings(least=2), co.CollocationSettings(least=1, held_percent=101, top=10**6), co.CollocationSettings()):
        assert _found(documents(spark), settings) == _plain(rows, settings)


def test_one_very_long_text_and_hot_phrases(spark):
    texts = ["alpha beta gamma delta epsilon " * 90_000, "alpha beta; gamma " * 500, None, ""] + ["alpha beta"] * 400
    settings = co.CollocationSettings()
    assert _found(plain(spark, texts), settings) == _plain([("en", t) for t in texts], settings)


def test_nothing_to_find(spark):
    assert _found(documents(spark, []), co.CollocationSettings()) == []
    assert _found(plain(spark, ["a b c", None, ""]), co.CollocationSettings()) == []


def test_counts_beyond_64_bits_stay_exact(spark):
    rows = [("en", ["a"], 4 * 10**18), ("en", ["b"], 4 * 10**18 + 1), ("en", ["a", "b"], 4 * 10**18)]
    table = spark.createDataFrame([(*r, [r[2]], [r[2] + 1]) for r in rows[2:]], "lang string, words array<string>, f long, heads array<long>, tails array<long>")
    cut = table.select(co._cut(co.F.lit(1), co.CollocationSettings()).alias("cut")).first().cut
    assert cut.score == 2_000_000 * 4 * 10**18 // (8 * 10**18 + 1)


def test_lockstep_over_range_borders(spark):
    words = [["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "d"], ["a", "c"], ["b"], ["b", "c"], ["b", "c", "d"], ["b", "c", "d", "e"]]
    rows = [("en", w, 100 - 10 * len(w) + i) for i, w in enumerate(words)]
    count = {tuple(w): f for _, w, f in rows}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = co.lockstep(spark.createDataFrame(rows, "lang string, words array<string>, f long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(rows)
    for r in found:
        w = tuple(r.words)
        assert r.heads == [count[w[:k]] for k in range(1, len(w))]
        assert r.longer == max((f for v, f in count.items() if len(v) == len(w) + 1 and v[: len(w)] == w), default=0)
