"""Continuous jobs: extraction, and responses with deadlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageflow.settings import FAILED, HANDLED, MSG_TIMED_OUT
from pageflow.sources.shared import fresh_path


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into files, and read them back."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def extract(pages: DataFrame, content: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch transforms on a stream of pages; stateless."""
    return content(pages)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answers(requests: DataFrame, deliveries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row for each request, as soon as its response is complete or out of time.

    ``requests``: response_id, unique_key, created_at, deadline, and if known
    ``expected``, the number of the response's requests; ``deliveries``:
    response_id, unique_key, request_status, loaded_at.  A response waits for
    its distinct keys, at least ``expected`` of them, and holds, per key, its times and its
    last outcome.  Deliveries for unknown keys, outside a request's own time, or
    after the answer are ignored; a later delivery before the answer replaces an
    earlier one.  An answered response stays marked until the watermark has
    passed its last deadline.  Without ``expected`` all requests of a response
    come before or with its first outcome.

    A response is one value with a timer while it has few keys, read and written
    once a batch, and beyond that a map of its keys, of which a delivery touches
    one.  Such state needs the RocksDB store, which is set for the session.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    expected = F.col("expected") if "expected" in requests.columns else F.lit(0)
    asked = requests.select(
        "response_id",
        "unique_key",
        F.col("created_at").alias("at"),
        F.unix_micros("created_at").alias("since"),
        F.unix_micros("deadline").alias("until"),
        F.lit(None).cast("string").alias("request_status"),
        expected.cast("bigint").alias("expected"),
    )
    sent = deliveries.select(
        "response_id",
        "unique_key",
        F.col("loaded_at").alias("at"),
        F.unix_micros("loaded_at").alias("since"),
        F.lit(None).cast("bigint").alias("until"),
        "request_status",
        F.lit(None).cast("bigint").alias("expected"),
    )
    kinds = dict(requests.dtypes)
    output = (
        f"response_id {kinds['response_id']}, unique_key {kinds['unique_key']}, request_status string,"
        " http_status_message string, complete boolean"
    )
    return (
        asked.withWatermark("at", delay)
        .unionByName(sent.withWatermark("at", delay))
        .groupBy("response_id")
        .transformWithState(Answering(f"unique_key {kinds['unique_key']}"), output, "append", "EventTime")
    )


#: A response holds so many requests in its value; with more they move to a map.
VALUE_REQUESTS = 16


class Answering(StatefulProcessor):
    """The state of one response: its requests by key, how many are open, and a timer at its last deadline.

    Each access of the state is a call out of Python, so few requests are held in the response's value.
    """

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getMapState("requests", self.key, "since BIGINT, until BIGINT, status STRING")
        self.response = handle.getValueState("response", f"n BIGINT, n_open BIGINT, expected BIGINT, timer BIGINT, answered BOOLEAN, few ARRAY<STRUCT<{self.key}, since BIGINT, until BIGINT, status STRING>>")

    def _rows(self, key, held: Iterator[tuple], complete: bool) -> Iterator[Row]:
        for (unique_key,), (_, _, status) in held:
            yield Row(
                response_id=key[0], unique_key=unique_key, request_status=status or FAILED,
                http_status_message=None if status else MSG_TIMED_OUT, complete=complete,
            )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asked, outcomes = [], []
        for row in rows:
            (outcomes if row.request_status is not None else asked).append(row)
        n, n_open, expected, timer, answered, few = self.response.get() or (0, 0, 0, 0, False, [])
        in_value = few is not None
        touched: dict = {key: [*request] for key, *request in few or ()}

        def held(unique_key):
            """The request of a key as [since, until, status], read once."""
            if in_value:
                return touched.get(unique_key)
            if unique_key not in touched:
                known = self.requests.containsKey((unique_key,))
                touched[unique_key] = list(self.requests.getValue((unique_key,))) if known else None
            return touched[unique_key]

        last = timer
        for row in asked:
            if not answered and held(row.unique_key) is None:
                touched[row.unique_key] = [row.since, row.until, None]
                n, n_open = n + 1, n_open + 1
            expected = max(expected, row.expected or 0)
            last = max(last, row.until // 1000 + 1)
        outcomes.sort(key=lambda r: (r.since, r.request_status))
        for i, row in enumerate(outcomes):
            request = None if answered else held(row.unique_key)
            if request and request[0] <= row.since <= request[1]:
                n_open -= request[2] is None
                request[2] = row.request_status
            ends_instant = i + 1 == len(outcomes) or outcomes[i + 1].since != row.since
            answered = answered or (ends_instant and n > 0 and n_open == 0 and n >= expected)
        if in_value and answered:
            yield from self._rows(key, (((k,), request) for k, request in touched.items()), True)
            few = []
        elif in_value and len(touched) <= VALUE_REQUESTS:
            few = [(k, *request) for k, request in touched.items()]
        else:
            few = None
            for unique_key, request in touched.items():
                if request is not None:
                    self.requests.updateValue((unique_key,), tuple(request))
            if answered and self.requests.exists():
                yield from self._rows(key, self.requests.iterator(), True)
                self.requests.clear()
        if n or answered:
            due = max(last, timerValues.getCurrentWatermarkInMs() + 1)
            if due != timer:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.response.update((n, n_open, expected, due, answered, few))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *_, few = self.response.get()
        if few is not None:
            yield from self._rows(key, (((k,), request) for k, *request in few), False)
        elif self.requests.exists():
            yield from self._rows(key, self.requests.iterator(), False)
            self.requests.clear()
        self.response.clear()

    def close(self) -> None:
        pass


def answered_responses(rows: DataFrame) -> DataFrame:
    """Rows of ``answers`` per response, each of which is answered once."""
    return rows.groupBy("response_id").agg(
        F.count_if(F.col("request_status") == HANDLED).alias("n_handled"),
        F.count_if(F.col("request_status") == FAILED).alias("n_failed"),
        F.count_if(F.col("http_status_message") == MSG_TIMED_OUT).alias("n_timed_out"),
        F.every("complete").alias("complete"),
    )


def last_outcome(deliveries: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """The last delivery per request, once its window of request time is over.

    A queue may deliver the same outcome again and again.  Such repeats are
    known by all their columns and dropped before the aggregate, from a state
    that lets go of a delivery once the watermark has passed it.
    """
    once = deliveries.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(deliveries.columns)
    return (
        once.groupBy(F.window("created_at", width), "response_id", "unique_key")
        .agg(
            F.max_by("request_status", F.struct("loaded_at", "request_status")).alias("request_status"),
            F.count("*").alias("n_deliveries"),
        )
        .drop("window")
    )
