"""A store of fetched pages that is joined by URL without moving a page.

Pages are bucketed and sorted by a digest of their normalised URL.  A fetch first
settles, from narrow columns alone, which stored copy of each wanted URL counts,
and then reads those rows.  Keys go to every task while they are few, and beyond
that to the buckets; the pages stay in their buckets either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import urls
from pageflow.sources.shared import BROADCAST_BYTES, fresh_path, staged, stored_bytes


def url_digest(url: Column, *within: Column) -> Column:
    """128 bits of a normalised URL, and of what else a page is known by: even over buckets, and short as a key."""
    return F.unhex(F.md5(F.concat_ws(" ", url, *[F.coalesce(c.cast("string"), F.lit("-")) for c in within])))


@dataclass(frozen=True)
class PageStore:
    """A bucketed table; ``url`` is normalised, ``loaded_at`` tells copies of a page apart.

    Pages are known by their URL and by the columns ``within``, such as a page number.
    """

    spark: SparkSession
    table: str
    within: tuple[str, ...] = ()

    def pages(self) -> DataFrame:
        return self.spark.read.table(self.table).drop("url_digest")

    def fetch(self, wanted: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Rows of ``wanted`` (url, the columns ``within`` and any others but the store's) with the last loaded copy of their page.

        A URL that is wanted by several rows is fetched for each; one that is
        not stored, or null, has no row.  A URL is known by its digest.  Of copies loaded at the same time
        the one with the smallest digest counts; a copy without a time counts least.
        """
        stored = self.spark.read.table(self.table)
        asked = staged(wanted.where("url IS NOT NULL").withColumn("url_digest", url_digest(F.col("url"), *map(F.col, self.within))), "wanted-pages")
        narrow = stored.select("url_digest", "loaded_at", "copy")
        near = F.broadcast if stored_bytes(asked) <= max_bytes else lambda df: df.hint("shuffle_hash")
        order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", -F.col("copy"))
        held = narrow.join(near(asked.select("url_digest").distinct()), "url_digest", "left_semi")
        chosen = held.groupBy("url_digest").agg(F.max_by("copy", order).alias("chosen"))
        located = staged(asked.drop("url", *self.within).join(chosen, "url_digest"), "located-pages")
        # a range, so that the digest alone is the key of the join: pages are bucketed by it
        same = F.col("copy").between(F.col("chosen"), F.col("chosen"))
        return stored.join(near(located), "url_digest").where(same).drop("url_digest", "copy", "chosen")


def write_page_store(pages: DataFrame, table: str, buckets: int = 200, path: str | None = None, within: tuple[str, ...] = ()) -> PageStore:
    """Store fetched pages (url, loaded_at, html and others) as ``table``; a page without a usable URL is left out.

    This is the one time that pages move.  ``copy`` names a row among those of
    its URL, by a digest of all that is stored, so that equal rows are one copy
    and a repeated write gives the same names.
    """
    spark = pages.sparkSession
    named = pages.withColumn("url", urls.http_url(F.col("url"))).where("url IS NOT NULL")
    whole = F.to_json(F.struct(*[F.col(c) for c in named.columns]))
    named = named.withColumns({"url_digest": url_digest(F.col("url"), *map(F.col, within)), "copy": F.xxhash64(whole)})
    placed = named.repartition(buckets, "url_digest").sortWithinPartitions("url_digest", "copy")
    placed = placed.dropDuplicates(["url_digest", "copy"])
    writer = placed.write.format("parquet").bucketBy(buckets, "url_digest").sortBy("url_digest")
    writer.option("path", path or fresh_path(spark, f"pages-{table}")).saveAsTable(table)
    return PageStore(spark, table, within)
