import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_cases import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageflow.llm import packing, token_files, tokens
from pageflow.llm.tokens import encoded_slices
from pageflow.sources.shared import fresh_path
from pageflow.sources.tables import read_table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_parts_give_the_ids_of_the_whole_text(spark, root, whole):
    texts = [r.text for r in read_table(spark, root, "documents").select("text").collect()]
    texts += [None, "", " ", "\n\n", "a b  c\x85d\x1ce", "é ́x", "<|endoftext|>x <|startoftext|> y", "I'll 've !!. .. 12a"]
    texts += ["<|ENDOFTEXT|> Word. Word", "Ḧ H̱ ẖ W̊ K, k. É. É, x.", "A.B, c.\nD,\tE. F.", "T.", ",", ".", "ﬁ Ⅷ ª º ʰ Ǆ ǅ ß ẞ ŉ"]
    texts += ["ΣΑΣ Σ ς", "İI ı", "x" * 3000, "tab\tand\x0bmore\x0c", "한국어 東京 🎉", "naïve café Åse å", "a.b,c ...", "Z", "z."]
    random.seed(8)
    alphabet = [*"abzAZ.,!? \n\t'0É̱ßσΣé", "́", "̈", "<|", "東"]
    texts += ["".join(random.choices(alphabet, k=random.randint(0, 25))) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    found = []
    for _, ids, ends in encoded_slices(iter([batch, batch.slice(5, 0), batch.slice(3, 40)]), "text", PATH, 2):
        found += [part.tolist() for part in np.split(ids, ends[:-1])]
    assert found == [whole(t) for t in texts + texts[3:43]]


def test_closing_marks_and_latin_capitals_make_no_parts_of_their_own(whole, monkeypatch):
    monkeypatch.setattr(tokens, "_MEMOS", {})
    random.seed(9)
    words = ["".join(random.choices("abcdéüñß", k=12)) for _ in range(300)]
    ends = ["", ".", "###", "***", "!!", ".###", "?)", "'", "''", "~"]
    texts = [" ".join([w + e, w.capitalize() + e, w.replace("ß", "s").upper() + e + "\n" + w + e]) for w in words for e in ends]
    small = [" ".join(words), " ".join(w.replace("ß", "s") for w in words)]
    pieces = ["a", "Z", "é", "É", "Ê", "ß", "Þ", "×", "÷", "À", "ÿ", "e", "\u0301", "\u0338", "<", "=", "'", "'s", "...", "#", "&", "|", "…", "“", "_", "7", "ª", "Σ", " ", "\n", "\t", "\xa0"]
    odd = ["".join(random.choices(pieces, k=random.randint(0, 12))) for _ in range(20000)]
    odd += ["", "!!", "!!", "a!!", "!! a", "a", "É", "\u0301a", "a.", "\u0301", "x<|ENDOFTEXT|>É.## y"]
    found = []
    for part in (small + texts, odd):
        batch = pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["text"])
        for _, ids, stops in encoded_slices(iter([batch]), "text", PATH, 2):
            found += [x.tolist() for x in np.split(ids, stops[:-1])]
        if part is not odd:
            assert len(tokens._MEMOS[PATH]) <= 2 * len(words) + len(ends) + 1
    assert found == [whole(t) for t in small + texts + odd]


@pytest.mark.parametrize("odd", [False, True])
def test_files_hold_all_ids_in_order(spark, root, whole, odd):
    docs = documents(spark) if odd else read_table(spark, root, "documents")
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(docs, path, token_files.TokenFileSettings(PATH))
    expected = defaultdict(list)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for r in rows:
        ids = whole(r.text)
        expected[r.doc_id].append((start, len(ids), _crc(ids)))
        start += len(ids)
    found = defaultdict(list)
    for r in token_files.token_index(spark, path).orderBy("start").collect():
        found[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    assert found == expected
    one = token_files.read_token_files(spark, path).where(F.col("doc_id") == 7)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()
    assert one.first().input_ids == whole(next(r.text for r in rows if r.doc_id == 7))


def test_empty_table_writes_nothing(spark):
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(documents(spark).limit(0), path, token_files.TokenFileSettings(PATH))
    assert token_files.token_index(spark, path).count() == 0
    assert packing.pack(documents(spark).limit(0), packing.PackSettings(PATH)).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_every_id_lies_in_one_piece(spark, root, whole, odd):
    docs = documents(spark) if odd else read_table(spark, root, "documents")
    pieces = packing.pack(docs, packing.PackSettings(PATH)).collect()
    expected = defaultdict(list)
    for r in docs.collect():
        expected[r.doc_id].append(whole(r.text))
    covered, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        assert any(
            len(ids) == p.doc_tokens and _crc(ids[p.start : p.start + p.length]) == p.ids_crc32 for ids in expected[p.doc_id]
        )
        covered[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert covered == {k: sum(map(len, v)) for k, v in expected.items()}
    padding = 0
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 4096 + 0.01 * sum(covered.values())


def test_least_squares_and_greedy_use_what_there_is():
    rng = np.random.default_rng(1)
    for seed in range(5):
        histogram = np.concatenate([[0], rng.integers(0, 50 * (seed + 1), 64)])
        left = histogram.copy()
        for repeats, members in packing.solved_windows(histogram, 4):
            assert sum(b * n for b, n in members) == 64
            for b, n in members:
                left[b] -= repeats * n
        assert (left >= 0).all()
        for repeats, members in packing.greedy_windows(left, 64):
            assert sum(b * n for b, n in members) <= 64
            for b, n in members:
                left[b] -= repeats * n
        assert not left.any()
    a = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]])
    assert np.allclose(a @ packing.non_negative_least_squares(a, np.array([3.0, 5.0])), [3, 5])
    assert packing.non_negative_least_squares(-np.eye(2), np.array([1.0, 1.0])).tolist() == [0, 0]
