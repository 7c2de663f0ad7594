import corpus_pipeline
from llm_cases import documents, plain

from pageflow.llm.lines import LineSettings, drop_boilerplate


def test_shared_lines_go_and_others_stay(spark):
    texts = [f"Menu | Home\nown line {k}\n\nCopyright" + ("\nrare" if k < 4 else "") for k in range(50)]
    rows = drop_boilerplate(plain(spark, texts), host="source").orderBy("doc_id").collect()
    assert rows[0].text == "own line 0\n\nrare" and rows[49].text == "own line 49\n"
    high = drop_boilerplate(plain(spark, texts), LineSettings(max_ratio=1.0), host="source").orderBy("doc_id").collect()
    assert [r.text for r in high] == texts


def test_odd_documents(spark):
    docs = documents(spark)
    out = drop_boilerplate(docs, host="source")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(str(r) for r in out.collect()) == sorted(str(r) for r in docs.collect())
    low = drop_boilerplate(docs, LineSettings(max_ratio=0.0, min_pages=1), host="source").collect()
    assert all((r.text is None) == (r.doc_id == 2 or r.n_chars is None) for r in low)
    assert drop_boilerplate(docs.limit(0), host="source").count() == 0


def test_pipeline_drops_lines_of_few_pages(spark, root):
    shares = {"two": 12, "five": 30, "nine": 54}
    texts = [f"own line {k}" + "".join(f"\nline on {x}" for x, n in shares.items() if k < n) for k in range(600)]
    texts = [x + ("\nline on four pages" if k < 4 else "") for k, x in enumerate(texts)]
    rows = corpus_pipeline.line_dedup(spark, plain(spark, texts), root).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [f"own line {k}" + ("\nline on four pages" if k < 4 else "") for k in range(600)]
