"""Stage timings: deltas, relative times, means.

A measure is (request_id, seq, event, time_us); ``seq`` is the append order.
Times are microseconds, results milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow import schemas, settings as S

# Measures of one request are handled in runs of this many sequence numbers,
# so one request with a third of all measures still spreads over tasks.
RUN = 1_000_000


def with_deltas(measures: DataFrame, run: int = RUN) -> DataFrame:
    """Add ``delta_us``: time since the request's previous measure, first 0."""
    cut = measures.withColumn("_run", F.floor(F.col("seq") / run))
    # the last time of each run, and with it the time before the next run
    by_run = Window.partitionBy("request_id").orderBy("_run")
    before = (
        cut.groupBy("request_id", "_run")
        .agg(F.max_by("time_us", "seq").alias("_last"))
        .select("request_id", "_run", F.lag("_last").over(by_run).alias("_before"))
    )
    in_run = Window.partitionBy("request_id", "_run").orderBy("seq")
    previous = F.coalesce(F.col("_previous"), F.col("_before"), F.col("time_us"))
    return (
        cut.withColumn("_previous", F.lag("time_us").over(in_run))
        .join(before, ["request_id", "_run"])
        .withColumn("delta_us", F.col("time_us") - previous)
        .drop("_run", "_previous", "_before")
    )


def with_relative(measures: DataFrame) -> DataFrame:
    """Add ``relative_us``: time since the request's first recorded measure."""
    first = measures.groupBy("request_id").agg(F.min_by("time_us", "seq").alias("_first"))
    return (
        measures.join(first, "request_id")
        .withColumn("relative_us", F.col("time_us") - F.col("_first"))
        .drop("_first")
    )


def in_ms(column: str):
    return F.round(F.col(column) / 1000, 3)


def mean_by_event(deltas: DataFrame) -> DataFrame:
    """Mean time per stage.  The values themselves are the input's rows."""
    return deltas.groupBy("event").agg(
        F.count("*").alias("n"),
        F.sum("delta_us").alias("total_us"),
        F.round(F.avg("delta_us") / 1000, 3).alias("mean_ms"),
    )


def time_taken(measures: DataFrame, last_event: str) -> DataFrame:
    """Time until ``last_event`` per request, and its mean over all."""
    done = measures.filter(F.col("event") == last_event)
    mean = done.agg(F.round(F.avg("relative_us") / 1000, 3)).scalar()
    keys = [c for c in ("request_id", "response_id", "unique_key", "seq") if c in measures.columns]
    return done.select(*keys, in_ms("relative_us").alias("time_ms"), mean.alias("mean_ms"))


def counted() -> dict[str, Column]:
    """Finished and failed requests of a run, for an aggregate or to observe on a write."""
    status = F.col("request_status")
    return {"requests_finished": F.count_if(status == S.HANDLED), "requests_failed": F.count_if(status == S.FAILED)}


def run_stats(outcomes: DataFrame) -> DataFrame:
    """Finished and failed requests of a run."""
    return outcomes.agg(*[value.alias(name) for name, value in counted().items()])


# -- measures that travel with a request -------------------------------------


def no_measures() -> Column:
    return F.array().cast(schemas.MEASURES)


def appended(measures: Column, event: Column | str, time_us: Column) -> Column:
    """One more measure behind those of a request; the first has no delta, NULL counts as none yet.

    A measure without a time is not taken.
    """
    known = F.coalesce(measures, no_measures())
    before = F.get(known, F.size(known) - 1)["time_us"]
    name = F.lit(event) if isinstance(event, str) else event
    delta = F.coalesce(time_us - before, F.lit(0).cast("bigint"))
    more = F.array(F.struct(name.alias("event"), time_us.alias("time_us"), delta.alias("delta_us")))
    return F.when(time_us.isNull(), known).otherwise(F.concat(known, more))


def gathered(events: Column) -> Column:
    """Measures out of (event, time_us) pairs in the order they were taken."""
    return F.aggregate(events, no_measures(), lambda acc, e: appended(acc, e["event"], e["time_us"]))


def sent(measures: Column, tool: Column, time_us: Column) -> Column:
    """The measures with the moment the result left, named after the scraping tool."""
    prefix = F.coalesce(*[F.when(tool == t, F.lit(p)) for t, p in S.STAGE_PREFIXES.items()], F.lit(S.STAGE_PREFIXES[S.DEFAULT_SCRAPING_TOOL]))
    return appended(measures, F.concat(prefix, F.lit(f"-{S.STAGE_SENT}")), time_us)


def relative(measures: Column) -> Column:
    """Times since the request's first measure, in order of time; equal times stay in order."""
    first = F.get(measures, F.lit(0))["time_us"]
    placed = F.transform(
        measures, lambda m, i: F.struct((m["time_us"] - first).alias("time_us"), i.alias("i"), m["event"].alias("event"), m["delta_us"].alias("delta_us"))
    )
    return F.transform(F.array_sort(placed), lambda m: F.struct(m["event"], m["time_us"], m["delta_us"]))


def debug_of(measures: Column, wanted: Column) -> Column:
    """What a record of a request in debug mode says about its stages; else NULL."""
    shown = F.struct(relative(measures).alias("time_measures"))
    return F.when(F.coalesce(wanted, F.lit(False)) & (F.size(measures) > 0), shown).cast(schemas.DEBUG)


def recorded(results: DataFrame) -> DataFrame:
    """Rows (response_id, unique_key, seq, event, relative_us, delta_us) of the measures in stored results.

    ``mean_by_event`` and ``time_taken`` take them; ``seq`` is the place in time.
    Results without measures have no row.
    """
    rows = results.select("response_id", "unique_key", F.posexplode("crawl.debug.time_measures").alias("seq", "m"))
    return rows.select(
        "response_id", "unique_key", F.col("seq").cast("bigint").alias("seq"), "m.event",
        F.col("m.time_us").alias("relative_us"), F.col("m.delta_us").alias("delta_us"),
    )
