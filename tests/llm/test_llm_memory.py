import random
import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import plain
from tokenizers import Tokenizer

from pageflow.llm import quality, textbytes, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_scoring_holds_little_beside_its_batch(spark, monkeypatch):
    caught = []
    docs = plain(spark, ["a few words"]).select("doc_id", "text", "lang")

    def catch(self, function, schema):
        caught.append((function, self.columns))
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(type(docs), "mapInArrow", catch)

    class Model:
        value = quality.PerplexityModel({"en": (np.arange(64, dtype=np.int32), np.full(64, -1, np.float32))})

    quality.measured(docs, Model())
    quality.gram_counts(docs)
    (measure, columns), (count, _) = caught
    assert columns == ["doc_id", "text", "lang"]
    texts = pa.array(["some words of a text\n" * 100] * 3000)
    batch = pa.record_batch([pa.array(range(3000)), texts, pa.array(["en"] * 3000)], names=["doc_id", "text", "lang"])
    for function in (measure, count):
        tracemalloc.start()
        rows = sum(part.num_rows for part in function(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 64 << 20


def test_hashes_keep_no_array_as_long_as_the_text():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    starts = rng.integers(0, len(data), 500)
    ends = np.minimum(starts + rng.integers(0, 60, 500), len(data))
    found = textbytes.Hashes(data).of(starts, ends)
    alone = [textbytes.Hashes(data[a:b]).of(np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends, strict=True)]
    assert found.tolist() == alone
    assert sum(x.nbytes for x in textbytes._POWERS.values()) < 1 << 20


def test_memo_keeps_what_is_asked_for_again(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PARTS", 400)
    monkeypatch.setattr(tokens, "_MEMOS", {})
    learned = Counter()
    learn = tokens._Memo.learn
    monkeypatch.setattr(tokens._Memo, "learn", lambda memo: learned.update(memo.new) or learn(memo))
    rng = random.Random(5)
    plain_tokenizer = Tokenizer.from_file(PATH)
    for _ in range(30):
        rare = ["".join(rng.choices("abcdeéß", k=9)) for _ in range(100)]
        texts = ["every text has these " + " ".join(rare[:50]), "", "Has THESE, every " + " ".join(rare[50:])]
        data = "".join(texts).encode()
        offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
        ids, ends = tokens.encode_bytes(np.frombuffer(data, np.uint8), offsets, PATH, 2)
        expected = [plain_tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == expected
        assert len(tokens._MEMOS[PATH]) <= 400 + 110
    assert [learned[w] for w in ("every", "these", "has")] == [1, 1, 1]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_read_few_documents_at_once(spark, root, stage):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4096")
        dict(corpus_pipeline.STAGES)[stage](spark, plain(spark, ["a few words"]), root)
        assert spark.conf.get(name) == "512"
    finally:
        spark.conf.set(name, before)
