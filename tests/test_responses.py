"""Response assembly, JSON, timings, contexts, sources and streams."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pageflow import schemas, settings as S
from pageflow.operators import context, hits, latency, responses
from pageflow.sources import shared, tables
from pageflow.streaming import jobs

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


REQUESTS = "response_id string, unique_key string, rank bigint, created_at timestamp, timeout_secs bigint"
OUTCOMES = (
    "response_id string, unique_key string, request_status string, loaded_at timestamp, http_status_code int, "
    "http_status_message string, title string, text string"
)


def tables_of(spark):
    asked = spark.createDataFrame(
        [
            ("all", "a", 2, at(0), 40), ("all", "b", 1, at(0), 40), ("all", "c", None, at(0), 40),
            ("some", "a", 1, at(0), 40), ("some", "b", 2, at(0), 40),
            ("none", "a", 1, at(0), 40), ("bad", "a", 1, at(0), 40),
        ],
        REQUESTS,
    )
    done = spark.createDataFrame(
        [
            ("all", "a", "handled", at(1), 200, "OK", "A", "a"), ("all", "b", "failed", at(2), 500, "x", "", ""),
            # delivered twice before the response is complete: the later one counts
            ("all", "c", "failed", at(0.5), 500, "x", "", ""), ("all", "c", "handled", at(1.5), 200, "OK", "C", "c"),
            # delivered again after it is complete: too late
            ("all", "a", "failed", at(3), 500, "again", "", ""),
            ("some", "a", "handled", at(40), 200, "OK", "A", "a"),
            # in time, then again past the deadline
            ("some", "a", "failed", at(45), 500, "again", "", ""),
            ("some", "b", "handled", at(41), 200, "OK", "B", "late"),
            ("nobody", "a", "handled", at(1), 200, "OK", "", ""),
            ("bad", "a", "failed", at(1), 500, "x", "", ""),
        ],
        OUTCOMES,
    )
    return asked, done


def merged(spark):
    asked, done = tables_of(spark)
    return responses.merge(asked, done, F.col("r.timeout_secs"))


def test_outcomes_meet_their_requests(spark):
    rows = {(r.response_id, r.unique_key): r for r in merged(spark).collect()}
    assert len(rows) == 7 and ("nobody", "a") not in rows
    status = {k: r.request_status for k, r in rows.items()}
    assert status["all", "c"] == "handled" and status["all", "a"] == "handled" and status["some", "a"] == "handled"
    assert status["some", "b"] == status["none", "a"] == "pending"
    assert rows["all", "a"].created_at is not None


def test_pending_fails_at_the_deadline(spark):
    rows = {(r.response_id, r.unique_key): r for r in responses.close(merged(spark)).collect()}
    late = rows["some", "b"]
    assert (late.request_status, late.http_status_code, late.http_status_message) == ("failed", 500, "Timed out.")
    assert (late.title, late.text) == ("", "") and rows["all", "a"].title == "A"


def test_status_of_responses(spark):
    rows = {r.response_id: (r.http_status, r.outcome) for r in responses.status(merged(spark)).collect()}
    # a complete response is fine even if every page failed
    assert rows == {
        "all": (200, "complete"), "some": (200, "partial"), "none": (500, "rejected"), "bad": (200, "complete")
    }
    complete = {r.response_id: r.complete for r in responses.completeness(merged(spark)).collect()}
    assert complete == {"all": True, "some": False, "none": False, "bad": True}


def test_order_and_json(spark):
    ordered = responses.sort_by_rank(merged(spark)).filter("response_id = 'all'").orderBy("position")
    assert [r.unique_key for r in ordered.collect()] == ["b", "a", "c"]
    errors = spark.createDataFrame([("gone", 400, 'say "what"')], "response_id string, http_status int, error string")
    body = responses.response_json(merged(spark), F.struct("unique_key", "title"), errors)
    rows = {r.response_id: (r.http_status, json.loads(r.body)) for r in body.collect()}
    assert [x["unique_key"] for x in rows["all"][1]] == ["b", "a", "c"]
    assert rows["gone"] == (400, {"errorMessage": 'say "what"'})
    message = spark.range(1).select(
        responses.result_message(F.struct(F.lit("é\"x").alias("t"))).alias("m"), responses.error_message(F.lit("no")).alias("e")
    ).first()
    assert json.loads(json.loads(message.m)["text"]) == {"t": 'é"x'} and json.loads(message.e) == [{"text": "no"}]


def test_cancelled_requests(spark):
    asked, done = tables_of(spark)
    now = {}
    for seconds in (1, 2, 40):
        over = responses.gone(asked, done, F.col("r.timeout_secs"), F.lit(at(seconds)))
        live, gone = responses.cancelled(asked, over)
        now[seconds] = {r.response_id for r in gone.collect()}
        assert live.count() + gone.count() == 7
    assert now == {1: {"bad"}, 2: {"bad", "all"}, 40: {"bad", "all", "some", "none"}}


def test_deltas_equal_a_plain_walk_for_any_run_length(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, 1, 1, 2, 3]), i, draw.choice("abc"), draw.randrange(10**6)) for i in range(500)]
    table = spark.createDataFrame(rows, "request_id bigint, seq bigint, event string, time_us bigint")
    expected, last, first = {}, {}, {}
    for request, seq, _, time in rows:
        first.setdefault(request, time)
        expected[seq] = (time - last.get(request, time), time - first[request])
        last[request] = time
    for run in (7, 1000, 1):
        got = latency.with_relative(latency.with_deltas(table, run)).collect()
        assert {r.seq: (r.delta_us, r.relative_us) for r in got} == expected


def test_time_taken_and_run_stats(spark):
    table = spark.createDataFrame(
        [(1, 1, "start", 0), (1, 2, "end", 3000), (2, 3, "start", 10), (2, 4, "end", 5010)],
        "request_id bigint, seq bigint, event string, time_us bigint",
    )
    taken = latency.time_taken(latency.with_relative(table), "end").orderBy("request_id").collect()
    assert [(r.time_ms, r.mean_ms) for r in taken] == [(3.0, 4.0), (5.0, 4.0)]
    assert tuple(latency.run_stats(responses.close(merged(spark))).first()) == (3, 4)


def test_contexts(spark):
    rows = [(1, 2, "b" * 6000), (1, 1, "a"), (1, 3, None), (1, 4, "d"), (2, 1, "z")]
    packed = context.pack(spark.createDataFrame(rows, "query_id bigint, rank bigint, markdown string"))
    got = {r.query_id: (r.n_results, r.context) for r in packed.collect()}
    assert got == {1: (3, "a...\n" + "b" * 5000 + "...\n..."), 2: (1, "z...")}
    row = spark.range(1).select(
        context.context_formats(F.array(F.lit("text"), F.lit("markdown"))).alias("a"),
        context.context_formats(F.lit(None).cast("array<string>")).alias("b"),
        context.context_max_results(F.lit(9)).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (["text", "markdown"], ["markdown"], 3)


def test_page_requests_keep_only_complete_hits(spark):
    table = spark.createDataFrame(
        [(1, "t", "d", "u", 1, "ORGANIC"), (1, None, "d", "v", 2, "ORGANIC")],
        "query_id bigint, title string, description string, url string, rank int, result_type string",
    )
    rows = {r.url: r for r in hits.page_requests(table).collect()}
    assert rows["u"].search_result["rank"] == 1 and rows["v"].search_result is None
    assert rows["u"].response_id == rows["v"].response_id and rows["u"].unique_key != rows["v"].unique_key


def test_requests_from_json_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"request_id": 1, "query": "q", "output_formats": ["text"]}\n{"request_id": 2}\n')
    rows = tables.read_requests(spark, str(tmp_path)).orderBy("request_id").collect()
    assert rows[0].output_formats == ["text"] and rows[1].query is None


def test_results_are_appended_and_pruned(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.RESULTS)
    record = spark.range(1).select(
        *[
            F.struct(*[F.lit("handled" if g.name == "request_status" else None).cast(g.dataType).alias(g.name) for g in f.dataType]).alias(f.name)
            if f.name == "crawl" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in empty.schema
        ]
    )
    for _ in range(2):
        tables.append_results(record, str(tmp_path / "out"))
    back = tables.read_results(spark, str(tmp_path / "out"))
    assert back.count() == 2 and back.filter("request_status = 'failed'").count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert shared.fresh_path(spark, "x") != shared.fresh_path(spark, "x")


def test_only_wanted_with_and_without_broadcast(spark):
    wide = spark.range(100).withColumnRenamed("id", "k").withColumn("wide", F.repeat(F.lit("x"), 100))
    wanted = spark.createDataFrame([(1,), (1,), (5,), (200,)], "k bigint")
    for limit in (1 << 20, 0):
        assert sorted(r.k for r in shared.only_wanted(wide, wanted, "k", limit).collect()) == [1, 5]


def test_a_stream_answers_as_the_batch_does(spark, tmp_path):
    asked, done = tables_of(spark)
    far = spark.createDataFrame([("end", "e", 1, at(10**8), 1)], REQUESTS)
    asked.unionByName(far).withColumn("deadline", F.col("created_at") + F.make_dt_interval(secs="timeout_secs")).drop(
        "rank", "timeout_secs"
    ).write.parquet(str(tmp_path / "asked"))
    # both sides have a last row that moves the watermark past all deadlines
    last = spark.createDataFrame([("end", "f", "handled", at(10**8))], "response_id string, unique_key string, request_status string, loaded_at timestamp")
    done.select(*last.columns).unionByName(last).write.parquet(str(tmp_path / "done"))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    rows = jobs.run_to_files(jobs.answers(read("asked"), read("done")), "answer-test")
    found = {(r.response_id, r.unique_key): r for r in rows.collect() if r.response_id != "end"}
    batch = {(r.response_id, r.unique_key): r for r in responses.close(merged(spark)).collect()}
    assert {k: v.request_status for k, v in found.items()} == {k: v.request_status for k, v in batch.items()}
    assert found["some", "b"].http_status_message == S.MSG_TIMED_OUT and found["some", "a"].http_status_message is None
    counts = {r.response_id: (r.n_handled, r.n_failed, r.n_timed_out, r.complete) for r in jobs.answered_responses(rows).collect()}
    assert {k: v for k, v in counts.items() if k != "end"} == {
        "all": (2, 1, 0, True), "some": (1, 1, 1, False), "none": (0, 1, 1, False), "bad": (0, 1, 0, True)
    }


def test_ids_are_wide_and_tell_nulls_apart(spark):
    from pageflow.operators.requests import stable_id

    pairs = [(None, "x"), ("x", None), ("x", ""), ("", "x"), ("1:x", "y"), ("x", "y"), ("x|1:y", None)]
    ids = spark.createDataFrame(pairs, "a string, b string").select(stable_id(F.col("a"), F.col("b")).alias("i")).collect()
    assert len({r.i for r in ids}) == len(pairs) and all(len(r.i) == 32 for r in ids)


def test_empty_and_bad_requests_have_a_body(spark):
    others = spark.createDataFrame([("none", 200, None), ("bad", 400, "no")], "response_id string, http_status int, error string")
    none = merged(spark).filter("false")
    rows = {r.response_id: (r.http_status, r.body) for r in responses.response_json(none, F.struct("title"), others).collect()}
    assert rows == {"none": (200, "[]"), "bad": (400, '{"errorMessage":"no"}')}


def test_measures_travel_with_a_request(spark):
    first = latency.appended(F.lit(None).cast(schemas.MEASURES), "request-received", F.lit(5_000).cast("bigint"))
    rows = spark.range(1).select(first.alias("m"))
    rows = rows.withColumn("m", latency.appended(F.col("m"), "late", F.lit(9_000).cast("bigint")))
    rows = rows.withColumn("m", latency.appended(F.col("m"), "early", F.lit(2_000).cast("bigint")))
    rows = rows.withColumn("m", latency.appended(F.col("m"), "never", F.lit(None).cast("bigint")))
    rows = rows.withColumn("m", latency.sent(F.col("m"), F.lit("browser-playwright"), F.lit(9_000).cast("bigint")))
    row = rows.select("m", latency.relative(F.col("m")).alias("r")).first()
    assert [tuple(m) for m in row.m] == [
        ("request-received", 5000, 0), ("late", 9000, 4000), ("early", 2000, -7000), ("playwright-before-response-send", 9000, 7000)
    ]
    assert [(m.event, m.time_us) for m in row.r] == [
        ("early", -3000), ("request-received", 0), ("late", 4000), ("playwright-before-response-send", 4000)
    ]
    shown = rows.select(latency.debug_of(F.col("m"), F.lit(False)).alias("off"), latency.debug_of(latency.no_measures(), F.lit(True)).alias("none"))
    assert tuple(shown.first()) == (None, None)


def test_a_batch_that_is_tried_again_is_appended_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(0, 10).write.parquet(source)

    def run():
        stream = spark.readStream.schema("id bigint").parquet(source)
        tables.append_stream(stream, out, "s", str(tmp_path / "state")).awaitTermination()
        return sorted(r.id for r in tables.read_appended(spark, out, "id bigint").collect())

    assert run() == list(range(10)) and run() == list(range(10))
    spark.range(10, 15).write.mode("append").parquet(source)
    assert run() == list(range(15))
    # a batch written but not entered in the ledger is not read, and is replaced when it is tried again
    spark.range(100, 103).write.parquet(f"{out}/data/sink=s/batch=2")
    assert sorted(r.id for r in tables.read_appended(spark, out, "id bigint").collect()) == list(range(15))
    spark.range(15, 17).write.mode("append").parquet(source)
    assert run() == list(range(17))
    # the stream's own log of the last batch is lost: the batch runs again and finds itself entered
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == list(range(17))


def test_nothing_appended_yet(spark, tmp_path):
    spark.createDataFrame([], "sink string, batch bigint").write.parquet(str(tmp_path / "ledger"))
    assert tables.read_appended(spark, str(tmp_path), "id bigint").collect() == []


def test_stats_are_observed_on_the_write(spark, tmp_path):
    closed = responses.close(merged(spark))
    seen = tables.append_with_stats(closed, str(tmp_path / "out"), **latency.counted())
    assert seen == latency.run_stats(closed).first().asDict()
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(seen.values())


def test_repeated_deliveries_count_once_and_leave_the_state(spark, tmp_path):
    rows = [(1, "a", "handled", at(5), at(0)), (1, "a", "failed", at(9), at(0)), (1, "b", "failed", at(4), at(1))]
    names = "response_id bigint, unique_key string, request_status string, loaded_at timestamp, created_at timestamp"
    late = [(2, "z", "handled", at(10**6), at(10**6))]
    spark.createDataFrame(rows * 50, names).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(late, names).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(names).parquet(str(tmp_path / "in"))
    query = (
        jobs.last_outcome(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.response_id, r.unique_key, r.request_status, r.n_deliveries) for r in found) == [(1, "a", "failed", 2), (1, "b", "failed", 1)]
    # of 151 deliveries only the last, which no later one has outdated, is still held, by either operator
    assert [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]] == [1, 1]


def test_parts_of_a_response_wait_for_each_other(spark, tmp_path):
    """Requests that come in two micro-batches are one response where their number is known."""
    asked = "response_id bigint, unique_key string, created_at timestamp, deadline timestamp, expected bigint"
    done = "response_id bigint, unique_key string, request_status string, loaded_at timestamp"
    in_one, in_two = tmp_path / "asked", tmp_path / "done"

    def put(rows, outcomes):
        spark.createDataFrame(rows, asked).coalesce(1).write.mode("append").parquet(str(in_one))
        spark.createDataFrame(outcomes, done).coalesce(1).write.mode("append").parquet(str(in_two))

    def run():
        read = lambda p, s: spark.readStream.schema(s).parquet(str(p))
        query = (
            jobs.answers(read(in_one, asked), read(in_two, done)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted((r.response_id, r.unique_key, r.request_status, r.complete) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put([(1, "a", at(0), at(60), 2), (2, "x", at(0), at(60), 1)], [(1, "a", "handled", at(1)), (2, "x", "handled", at(2))])
    assert run() == [(2, "x", "handled", True)]
    put([(1, "b", at(3), at(60), 2)], [(1, "b", "failed", at(4)), (2, "x", "failed", at(5))])
    assert run() == [(1, "a", "handled", True), (1, "b", "failed", True), (2, "x", "handled", True)]
    put([(3, "c", at(6), at(66), 2)], [(3, "c", "handled", at(7))])
    put([(9, "end", at(10**6), at(10**6), 1)], [(9, "no", "handled", at(10**6))])
    assert run()[3:] == [(3, "c", "handled", False)]


def test_a_large_response_takes_linear_time(spark, tmp_path):
    took = []
    for n in (500, 2_000, 20_000):
        asked = spark.range(n).select(F.lit(1).alias("response_id"), F.col("id").alias("unique_key"), F.lit(at(0)).alias("created_at"), F.lit(at(60)).alias("deadline"))
        done = asked.select("response_id", "unique_key", F.lit("handled").alias("request_status"), F.lit(at(1)).alias("loaded_at"))
        asked.write.parquet(str(tmp_path / f"asked{n}"))
        done.write.parquet(str(tmp_path / f"done{n}"))
        read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
        start = time.perf_counter()
        rows = jobs.run_to_files(jobs.answers(read(f"asked{n}"), read(f"done{n}")), "large")
        assert rows.where("complete AND request_status = 'handled'").count() == n
        took.append(time.perf_counter() - start)
    assert took[2] <= 15 * took[1]


class CountedState:
    """Stands for the value, the map and the timers of one response, and counts the calls."""

    def __init__(self):
        self.calls, self.value, self.held = 0, None, {}

    def __getattr__(self, name):
        known = {
            "exists": lambda: self.value is not None or bool(self.held), "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "containsKey": lambda k: k in self.held, "getValue": self.held.get, "updateValue": self.held.__setitem__,
            "iterator": lambda: iter(self.held.items()), "clear": lambda: (setattr(self, "value", None), self.held.clear()),
            "registerTimer": lambda at: None, "deleteTimer": lambda at: None, "getCurrentWatermarkInMs": lambda: 0,
        }

        def call(*given):
            self.calls += 1
            return known[name](*given)

        return call


@pytest.mark.parametrize("n", [4, 40])
def test_few_requests_cost_few_calls_of_the_state(n):
    value, held, timers = CountedState(), CountedState(), CountedState()
    job = jobs.Answering("unique_key BIGINT")
    job.response, job.requests, job.handle = value, held, timers
    asked = [Row(unique_key=k, since=0, until=9_000_000, request_status=None, expected=n) for k in range(n)]
    sent = [Row(unique_key=k, since=5, until=None, request_status="handled", expected=None) for k in range(n - 1)]
    assert list(job.handleInputRows((1,), iter(asked + sent), timers)) == []
    assert value.calls + held.calls <= 2 or n > jobs.VALUE_REQUESTS
    rows = list(job.handleExpiredTimer((1,), timers, None))
    assert sorted((r.unique_key, r.request_status, r.complete) for r in rows) == [(k, "handled" if k < n - 1 else "failed", False) for k in range(n)]
    assert value.value is None and not held.held
