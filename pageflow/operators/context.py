"""Results trimmed into bounded contexts, and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow import settings as S


def shortened(text: Column, chars: int) -> Column:
    return F.concat(F.left(F.coalesce(text, F.lit("")), F.lit(chars)), F.lit("..."))


def preview(df: DataFrame) -> DataFrame:
    """Rank, title, URL and the start of the text of each result."""
    return df.select(
        "rank",
        "title",
        "url",
        F.concat(F.left(F.coalesce("text", F.lit("N/A")), F.lit(S.PREVIEW_CHARS)), F.lit("...")).alias("preview"),
    )


def context_max_results(max_results: Column) -> Column:
    return F.least(F.coalesce(max_results, F.lit(S.CONTEXT_RESULTS)), F.lit(S.CONTEXT_RESULTS))


def context_formats(formats: Column) -> Column:
    """The asked formats plus Markdown, each once."""
    asked = F.coalesce(formats, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(asked, F.array(F.lit("markdown"))))


def pack(results: DataFrame, key: str = "query_id", max_results: int = S.CONTEXT_RESULTS) -> DataFrame:
    """One context per response: the best results' Markdown, shortened, in rank order."""
    kept = results.filter(F.col("rank") <= max_results)
    part = F.struct("rank", shortened(F.col("markdown"), S.CONTEXT_CHARS).alias("part"))
    parts = F.array_sort(F.collect_list(part))
    return kept.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("context"),
        F.count("*").alias("n_results"),
    )
