"""Drop lines that much of a host's pages share.

A line's site-relative frequency is the number of the host's pages that hold
it over all pages of the host.  Lines are counted by hash with map-side
combining; only the hashes of boilerplate lines, a few for each host, come back
to the pages.  All expressions are built in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.llm.words import WORD
from pageflow.sources.shared import staged


@dataclass(frozen=True)
class LineSettings:
    #: A line on more than this share of a host's pages is boilerplate,
    max_ratio: float = 0.1
    #: if at least so many pages of the host hold it.
    min_pages: int = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _mark(line: Column) -> Column:
    return F.xxhash64(line)


def boilerplate(pages: DataFrame, settings: LineSettings = LineSettings(), text: str = "text", host: str = "host") -> DataFrame:
    """Rows (host, marks): hashes of the host's boilerplate lines.

    Hosts without any are absent.  A list has at most (lines of a page) /
    max_ratio entries on average, whatever the number of pages.
    """
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: x.rlike(WORD)), _mark))
    held = (
        pages.select(F.col(host).alias("host"), F.explode(marks).alias("mark"))
        .groupBy("host", "mark")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= settings.min_pages)
    )
    totals = pages.groupBy(F.col(host).alias("h")).agg(F.count(F.lit(1)).alias("total"))
    return (
        held.join(totals, F.col("host").eqNullSafe(F.col("h")))
        .where(F.col("pages") > F.col("total") * settings.max_ratio)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    )


def drop_boilerplate(
    pages: DataFrame, settings: LineSettings = LineSettings(), text: str = "text", host: str = "host"
) -> DataFrame:
    """The pages with their boilerplate lines removed from the text column.

    Lines end at a line feed and are compared as they are.  Lines without a
    word always stay.  A null host is a host of its own; a null text stays
    null; a text of boilerplate only becomes empty; repeated rows count as
    pages of their own.  All columns come back, in order.
    """
    found = staged(boilerplate(pages, settings, text, host), "boilerplate")
    found = found.select(F.col("host").alias("__line_host"), F.col("marks").alias("__line_marks"))
    left = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col("__line_marks"), _mark(x)) | ~x.rlike(WORD))
    cleaned = F.when(F.col("__line_marks").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    joined = pages.join(found, F.col(host).eqNullSafe(F.col("__line_host")), "left")
    return joined.withColumn(text, cleaned).select(*pages.columns)
