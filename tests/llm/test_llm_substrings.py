import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, plain

from pageflow.llm.blocks import n_ranges
from pageflow.llm.substrings import GRAM, SubstringSettings, repeated_substrings, single_windows
from pageflow.llm.suffixes import suffix_array
from pageflow.sources.tables import read_table


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    found = suffix_array(np.array(symbols, np.int64)).tolist()
    assert found == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def _expected(texts, size=50):
    """texts: (doc_id, text) in any order; ids unique."""
    first, out = {}, {}
    for i, text in sorted(texts, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            if first.setdefault(data[k : k + size], i) < i:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def _found(frame, settings=SubstringSettings()):
    rows = repeated_substrings(frame, settings).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_whole_table(spark, root):
    docs = read_table(spark, root, "documents")
    assert _found(docs) == _expected([(r.doc_id, r.text) for r in docs.collect()])


def test_overlaps_borders_and_low_entropy(spark):
    random.seed(5)
    stock = ["".join(random.choice("ab ") for _ in range(n)) for n in (49, 50, 51, 77, 120)]
    texts = []
    for _ in range(60):
        parts = [random.choice([*stock, "é" * 60, "ab" * 40, "", "x"]) for _ in range(random.randint(1, 5))]
        texts.append("".join(p[random.randint(0, 2) :] for p in parts))
    texts += [None, "", "q" * 49, "q" * 49, "q" * 50, "q" * 50, "q" * 200, "z" + "q" * 51 + "z"]
    assert _found(plain(spark, texts)) == _expected(list(enumerate(texts)))


def test_odd_documents(spark):
    docs = documents(spark)
    rows = repeated_substrings(docs).collect()
    assert len(rows) == docs.count()
    named = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert named[1].n_removed == named[1].n_bytes and named[0].n_removed == 0
    nameless = [r for r in rows if r.doc_id is None]
    assert sorted(r.n_removed for r in nameless) == [0, len(docs.where("doc_id = 0").first().text)]
    assert repeated_substrings(docs.limit(0)).count() == 0


def _hot_texts(n):
    """A 30-byte phrase in a third of the texts with ever different neighbours, a 49-byte and a 70-byte one in others."""
    rng = random.Random(11)

    def noise(size):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))

    phrase, almost, passage = noise(30), noise(49), noise(70)
    texts = []
    for i in range(n):
        middle = (phrase, almost, passage)[i % 3] if i % 6 else phrase
        texts.append(noise(rng.randint(0, 60)) + middle + rng.choice(["", "x", "y", noise(40)]) + middle[: rng.randint(0, 70)])
    return texts


def test_hot_buckets_equal_brute_force(spark):
    texts = [*_hot_texts(900), None, "", *_hot_texts(20)]
    expected = _expected(list(enumerate(texts)))
    assert any(removed for _, removed, _, _ in expected.values())
    frame = plain(spark, texts).repartition(5)
    assert _found(frame, SubstringSettings(hot_rows=20)) == expected
    assert _found(frame, SubstringSettings(hot_rows=0)) == expected
    assert _found(frame) == expected


def test_low_entropy_with_every_bucket_hot(spark):
    random.seed(6)
    texts = ["".join(random.choice(["ab" * 20, "a" * 50, "b", " ", "ab ab "]) for _ in range(6)) for _ in range(80)]
    assert _found(plain(spark, texts).repartition(3), SubstringSettings(hot_rows=0)) == _expected(list(enumerate(texts)))


def test_windows_of_a_hot_phrase_differ():
    """Windows over a phrase shorter than they are do not meet unless they are equal."""
    spread, n = SubstringSettings().spread, 500
    rng = np.random.default_rng(3)
    context = rng.integers(1, 255, (n, 2 * spread)).astype(np.uint8)
    fields = {
        "gram": np.full(n, 7, np.uint64), "text_no": np.arange(n), "doc_id": np.arange(n), "position": np.full(n, spread),
        "low": np.zeros(n, np.uint8), "high": np.full(n, spread, np.uint8),
    }
    single, bytes_of = single_windows(fields, context)
    assert len(bytes_of) == n * (spread + 1) and (single["low"] == single["high"]).all()
    assert (np.count_nonzero(bytes_of, axis=1) == spread).all()
    assert len(np.unique(np.column_stack([single["low"], bytes_of]), axis=0)) == len(bytes_of)
    assert GRAM + spread == SubstringSettings().size


def test_rows_between_blocks_and_ranges_keep_their_size():
    """From 0.1 to 30 GB a block of 2 MB sends at least 64 keys a row; no range outgrows a task."""
    for gb in (0.1, 0.5, 2, 30, 100):
        blocks = int(gb * 1e9 / 2e6)
        ranges = n_ranges(int(gb * 1e9), blocks, 0.07)
        assert 2e6 * 0.07 / ranges >= 60
        assert gb * 1e9 * 0.07 / ranges < 2**23
