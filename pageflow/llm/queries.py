"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm import (
    chat, collocations, embeddings, jaccard, lines, mixing, packing, products, quality, substrings, token_files, tries, warc,
)
from pageflow.sources.shared import fresh_path, staged
from pageflow.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Looks like control strings; the template has to carry it as text.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op4_source_mix(spark: SparkSession, root: str) -> DataFrame:
    narrow = read_table(spark, root, "documents").select("doc_id", "text", "source")
    taken = mixing.with_copies(narrow)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_query
def op5_reply_trees(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    control = control.select("conv_id", "t.turn", "t.role", "text")
    written = staged(chat.formatted_conversations(rows.unionByName(control)), "chats")
    turns = chat.read_turns(F.col("text"))
    loss = chat.read_loss(F.col("text"), F.col("loss_spans"))
    line_feed = F.lit("\n")
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], line_feed, t["text"], line_feed)), "")
    return written.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


@_query
def op9_site_lines(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").select("doc_id", "text", "source")
    cleaned = lines.drop_boilerplate(docs.withColumn("before", F.col("text")), host="source")
    count = lambda c: F.coalesce(F.size(F.split(F.col(c), "\n")), F.lit(0)).cast("long")
    return cleaned.select(
        "doc_id",
        F.when(F.col("before").isNull(), F.lit(0)).otherwise(count("before")).cast("long").alias("n_lines"),
        F.coalesce(F.length("before"), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op6_token_files(spark: SparkSession, root: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(
        read_table(spark, root, "documents"), path, token_files.TokenFileSettings(_tokenizer())
    )
    return token_files.token_index(spark, path)


@_query
def op7_warc_index(spark: SparkSession, root: str) -> DataFrame:
    index = warc.write_archives(read_table(spark, root, "pages"), fresh_path(spark, "warc"))
    return warc.read_records(index).drop("url")


@_query
def op8_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(read_table(spark, root, "documents"), packing.PackSettings(_tokenizer()))


@_query
def op1_perplexity(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").select("doc_id", "text", "lang")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "log_perplexity",
    )


@_query
def op10_jaccard(spark: SparkSession, root: str) -> DataFrame:
    found = jaccard.jaccard_components(read_table(spark, root, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@_query
def op2_vector_graph(spark: SparkSession, root: str) -> DataFrame:
    return embeddings.vector_links(read_table(spark, root, "embeddings"))


@_query
def op3_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return substrings.repeated_substrings(read_table(spark, root, "documents"))


@_query
def op11_prefix_trie(spark: SparkSession, root: str) -> DataFrame:
    return tries.prefix_trie(tries.rebuilt(tries.encoded(read_table(spark, root, "conversations"))))


@_query
def op12_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations.collocations(read_table(spark, root, "documents"))


@_query
def op13_top_products(spark: SparkSession, root: str) -> DataFrame:
    return products.top_products(read_table(spark, root, "embeddings"), F.col("id") % 20 == 0)
