"""Mix sources to target weights by systematic sampling.

The expected copies of a document are its source's target over its source's
size.  Their prefix sum within the source, plus one random offset for the
source, crosses integers; a document is emitted once for each it crosses.
All expressions are built in; no task holds more than one stratum of a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.llm.words import word_count

_OWN = "__mix_"


@dataclass(frozen=True)
class MixSettings:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Words of the mix as a share of the words of all sources.
    share: float = 1.5
    #: A source gives at most so many times its words.
    most: float = 2.0
    #: Strata of equal size class are split in so many parts.
    parts: int = 64
    seed: str = "mix"


def source_targets(by_source: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """Target words of each source, from rows (source, source_size).

    Sources sorted by how soon they reach their limit; the level at which the
    rest shares what is left is largest exactly where the limits stop binding.
    """
    cycle = F.array(*[F.lit(w) for w in settings.weights])
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn(
        "weight",
        F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(settings.weights) + 1).cast("int")).cast("long"),
    )
    limit = F.col("source_size") * F.lit(settings.most)
    soonest = Window.orderBy((limit / F.col("weight")), F.col("source").asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    none = F.lit(0).cast("long")
    left = F.sum("source_size").over(everything) * F.lit(settings.share) - (
        F.coalesce(F.sum("source_size").over(before), none) * F.lit(settings.most)
    )
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none)
    level = F.max("level").over(everything)
    return weighed.withColumn("level", left / weights_left).select(
        "source", "source_size", F.least(limit, F.col("weight") * level).alias("target")
    )


def _offset(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), the same in every run."""
    name = F.concat(F.lit(seed), F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _sampled(docs: DataFrame, settings: MixSettings, key: str, text: str, source: str) -> DataFrame:
    """All columns of the documents and ``__mix_`` size, source_size, target and copies."""
    own = {c: F.col(f"{_OWN}{c}") for c in ("source", "size", "stratum", "part", "rank", "before", "source_size", "target")}
    sized = (
        docs.withColumn(f"{_OWN}source", F.col(source).cast("string"))
        .withColumn(f"{_OWN}size", word_count(F.col(text)))
        .withColumn(f"{_OWN}stratum", F.length(F.bin(own["size"])))
        .withColumn(f"{_OWN}part", F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(settings.parts)), F.lit(0)))
    )
    group = [own["source"], own["stratum"], own["part"]]
    strata = sized.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.sum(own["size"]).alias("words"))
    targets = source_targets(
        strata.groupBy(own["source"].alias("source")).agg(F.sum("words").alias("source_size")), settings
    )
    earlier = Window.partitionBy(own["source"]).orderBy(own["stratum"], own["part"])
    starts = strata.withColumn("before", F.sum("rows").over(earlier) - F.col("rows")).join(
        targets, own["source"].eqNullSafe(F.col("source"))
    )
    starts = starts.select(
        own["source"].alias(f"{_OWN}s"),
        own["stratum"].alias(f"{_OWN}t"),
        own["part"].alias(f"{_OWN}p"),
        *[F.col(c).alias(f"{_OWN}{c}") for c in ("before", "source_size", "target")],
    )
    inside = Window.partitionBy(*group).orderBy(own["size"], F.col(key).asc_nulls_first())
    expected = F.when(own["source_size"] > 0, own["target"] / own["source_size"]).otherwise(F.lit(0.0))
    shift = _offset(own["source"], settings.seed)
    crossed = F.floor(expected * own["rank"] + shift) - F.floor(expected * (own["rank"] - 1) + shift)
    same = (
        own["source"].eqNullSafe(F.col(f"{_OWN}s"))
        & (own["stratum"] == F.col(f"{_OWN}t"))
        & (own["part"] == F.col(f"{_OWN}p"))
    )
    return (
        sized.join(starts, same)
        .withColumn(f"{_OWN}rank", F.row_number().over(inside) + own["before"])
        .withColumn(f"{_OWN}copies", crossed.cast("long"))
    )


def with_copies(
    docs: DataFrame, settings: MixSettings = MixSettings(), key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Rows (key, size, source_size, target, copies): how often the mix takes each row.

    Rows are strata of equal bit length of their size, so that copies and words
    come near their targets together; a stratum is split by key.  Within a
    part, rows go by size and key.  A null source is a source of its own, a null
    text has size 0, a null key sorts first; repeated rows are sampled as
    separate documents; rows of a source without words are never taken.  No row,
    no result.
    """
    added = [F.col(f"{_OWN}{c}").alias(c) for c in ("size", "source_size", "target", "copies")]
    return _sampled(docs, settings, key, text, source).select(key, *added)


def mix(
    docs: DataFrame, settings: MixSettings = MixSettings(), key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix itself: the documents' columns, each row as often as ``with_copies`` takes it."""
    copies = F.col(f"{_OWN}copies")
    taken = _sampled(docs, settings, key, text, source).where(copies > 0)
    repeated = taken.withColumn(f"{_OWN}copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*docs.columns)
