"""Responses: merge outcomes into requests, deadlines, status, order, JSON.

A page request is (response_id, unique_key, created_at, rank, ...); an outcome
is (response_id, unique_key, request_status, loaded_at, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow import settings as S

KEYS = ["response_id", "unique_key"]


def last_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome per request: a later delivery replaces an earlier one."""
    rest = [c for c in outcomes.columns if c not in KEYS]
    last = F.max_by(F.struct(*rest), F.struct("loaded_at", "request_status"))
    return outcomes.groupBy(*KEYS).agg(last.alias("__last")).select(*KEYS, "__last.*")


def in_time(created_at: Column, loaded_at: Column, timeout_secs: Column) -> Column:
    return loaded_at.between(created_at, created_at + F.make_dt_interval(secs=timeout_secs))


def merge(requests: DataFrame, outcomes: DataFrame, timeout_secs: Column | None = None) -> DataFrame:
    """Requests with their outcome; pending where there is none (in time).

    With a timeout only deliveries up to the request's deadline count, and none
    after the response was complete, i.e. after its last request had its first
    delivery; of those left the last counts.  Joins on response and request key, so
    that a response with very many requests spreads over tasks.  Outcomes
    nobody asked for drop out.
    """
    if timeout_secs is not None:
        outcomes = _counting(requests, outcomes, timeout_secs)
    r, o = requests.alias("r"), last_outcomes(outcomes).alias("o")
    condition = [F.col(f"r.{k}") == F.col(f"o.{k}") for k in KEYS]
    added = [F.col(f"o.{c}") for c in outcomes.columns if c not in KEYS + ["request_status"]]
    status = F.coalesce("o.request_status", F.lit(S.PENDING)).alias("request_status")
    return r.join(o, condition, "left").select("r.*", status, *added)


def _counting(requests: DataFrame, outcomes: DataFrame, timeout_secs: Column) -> DataFrame:
    """Deliveries before the answer: in time, and not after completion."""
    r, o = requests.alias("r"), outcomes.alias("o")
    condition = [F.col(f"r.{k}") == F.col(f"o.{k}") for k in KEYS]
    condition.append(in_time(F.col("r.created_at"), F.col("o.loaded_at"), timeout_secs))
    timely = r.join(o, condition).select("o.*")
    first = timely.groupBy(*KEYS).agg(F.min("loaded_at").alias("first_at"))
    done = (
        requests.select(*KEYS)
        .join(first, KEYS, "left")
        .groupBy("response_id")
        .agg(F.when(F.count("*") == F.count("first_at"), F.max("first_at")).alias("done_at"))
    )
    counting = timely.join(done, "response_id").filter("done_at IS NULL OR loaded_at <= done_at")
    return counting.select(*outcomes.columns)


def close(merged: DataFrame, message: str = S.MSG_TIMED_OUT) -> DataFrame:
    """At the deadline, whatever is pending has failed."""
    pending = F.col("request_status") == S.PENDING
    return merged.withColumns(
        {
            "http_status_code": F.when(pending, F.lit(500)).otherwise(F.col("http_status_code")),
            "http_status_message": F.when(pending, F.lit(message)).otherwise(F.col("http_status_message")),
            "title": F.when(pending, F.lit("")).otherwise(F.col("title")),
            "text": F.when(pending, F.lit("")).otherwise(F.col("text")),
            "request_status": F.when(pending, F.lit(S.FAILED)).otherwise(F.col("request_status")),
        }
    )


def completeness(merged: DataFrame) -> DataFrame:
    """A response is complete once none of its requests is pending."""
    return merged.groupBy("response_id").agg(
        F.count("*").alias("n_requests"),
        F.count_if(F.col("request_status") == S.PENDING).alias("n_pending"),
        F.every(F.col("request_status") != S.PENDING).alias("complete"),
    )


def status(merged: DataFrame) -> DataFrame:
    """HTTP status: 200 if complete or if at least one page was handled."""
    complete = F.every(F.col("request_status") != S.PENDING)
    handled = F.some(F.col("request_status") == S.HANDLED)
    return merged.groupBy("response_id").agg(
        F.when(complete | handled, 200).otherwise(500).cast("bigint").alias("http_status"),
        F.when(complete, "complete").when(handled, "partial").otherwise("rejected").alias("outcome"),
        F.count_if(F.col("request_status") == S.HANDLED).alias("n_handled"),
    )


def sort_by_rank(merged: DataFrame) -> DataFrame:
    """Place of each result in its response; results without a rank come last.

    A response holds at most as many results as one search may ask for.
    """
    order = Window.partitionBy("response_id").orderBy(F.col("rank").asc_nulls_last(), "unique_key")
    return merged.withColumn("position", F.row_number().over(order))


def gone(requests: DataFrame, outcomes: DataFrame, timeout_secs: Column, now: Column) -> DataFrame:
    """(response_id) of responses that were answered by ``now``: complete, or past all their deadlines."""
    merged = merge(requests, outcomes.filter(F.col("loaded_at") <= now), timeout_secs).alias("r")
    deadline = F.col("created_at") + F.make_dt_interval(secs=timeout_secs)
    finished = F.every(F.col("request_status") != S.PENDING)
    return merged.groupBy("response_id").agg((finished | (F.max(deadline) <= now)).alias("over")).filter("over").select("response_id")


def cancelled(requests: DataFrame, gone_responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests still wanted, and those whose response is already gone."""
    return (
        requests.join(gone_responses, "response_id", "left_anti"),
        requests.join(gone_responses, "response_id", "left_semi"),
    )


def result_message(record: Column) -> Column:
    """One result as a JSON text message."""
    return F.to_json(F.struct(F.lit("text").alias("type"), F.to_json(record).alias("text")))


def error_message(message: Column) -> Column:
    return F.to_json(F.array(F.struct(message.alias("text"))))


def response_json(
    records: DataFrame, record: Column, others: DataFrame | None = None, status: Column | None = None
) -> DataFrame:
    """(response_id, http_status, body): the ranked array, or the error object.

    ``records`` has response_id, rank and unique_key; a response has at most
    100 records, so its array stays small.  ``status`` is the HTTP status of a
    record's response, 200 by default.  ``others`` is (response_id, http_status, error)
    of responses without records: without an error they are an empty array.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("rank").isNull().alias("unranked"),
                F.col("rank").alias("rank"),
                F.col("unique_key").alias("unique_key"),
                record.alias("record"),
            )
        )
    )
    body = F.to_json(F.transform(ordered, lambda r: r["record"]))
    code = F.max(F.lit(200) if status is None else status).cast("bigint")
    ok = records.groupBy("response_id").agg(code.alias("http_status"), body.alias("body"))
    if others is None:
        return ok
    error = F.to_json(F.struct(F.col("error").alias("errorMessage")))
    return ok.unionByName(
        others.select(
            "response_id",
            F.col("http_status").cast("bigint").alias("http_status"),
            F.when(F.col("error").isNull(), F.lit("[]")).otherwise(error).alias("body"),
        )
    )
