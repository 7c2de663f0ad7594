"""Table readers and the append-only result sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pageflow import schemas


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


#: Rows of heavy work that one task takes at most; a table with larger splits is dealt out again.
TASK_ROWS = 2_000


def spread(table: DataFrame) -> DataFrame:
    """Give a stored table at least one task per core, and one per ``TASK_ROWS`` rows, before heavy row work.

    A scan makes as many tasks as the files allow; a few large row groups of
    pages would leave most cores idle, and a task's work would grow with the
    table.  A table with enough splits is returned as it is and nothing moves.
    Only for tables read from files: of anything else the number of tasks is
    not known yet, and rows are not counted by their files' footers.
    """
    if table.isStreaming:
        return table
    wanted = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
    if table.rdd.getNumPartitions() >= wanted:
        return table
    return table.repartition(wanted)


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Request records; JSON lines by default, any Spark format otherwise."""
    return spark.read.format(fmt).schema(schemas.REQUESTS).load(path)


def read_fetched(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched pages as ``plans.retrieval.retrieve`` takes them."""
    return spark.read.format(fmt).schema(schemas.FETCHED_PAGES).load(path)


def read_request_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.format(fmt).schema(schemas.REQUESTS).load(path)


def read_stream(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table's files as a stream; the pattern takes one file or a folder."""
    return spark.readStream.schema(schema).parquet(f"{root}/{name}.parquet*")


def normalised_timestamps(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as instants, read as UTC whatever the session's zone.

    Watermarks take instants only.
    """
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            local = F.col(field.name).cast("timestamp")
            df = df.withColumn(field.name, F.from_utc_timestamp(local, F.current_timezone()))
    return df


def append_results(df: DataFrame, path: str, partition_by: str | None = "request_status") -> None:
    """Append result records; partitioned so that readers can skip outcomes."""
    if partition_by == "request_status":
        df = df.withColumn("request_status", F.col("crawl.request_status"))
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.RESULTS}, request_status STRING").parquet(path)


def append_with_stats(df: DataFrame, path: str, **stats: Column) -> dict:
    """``append_results``, and aggregates of what was written, observed on the way: no second scan."""
    seen = Observation()
    append_results(df.observe(seen, *[value.alias(name) for name, value in stats.items()]), path, None)
    return seen.get


# -- a result table that a stream appends to -----------------------------------

_LEDGER = "sink STRING, batch BIGINT"


def append_stream(stream: DataFrame, path: str, sink: str, state: str, **trigger) -> StreamingQuery:
    """Append a stream's rows to a result table, each once, whatever is retried.

    A micro-batch goes to a folder of its own, named by ``sink`` and batch, and
    is then entered in the ledger; ``read_appended`` reads what is entered.
    A batch that is tried again after a failure replaces its own folder; one
    that was entered before the failure is left as it is.  ``sink`` names the
    stream's ``state`` folder: a stream that starts with a fresh one takes another name.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], _LEDGER).write.mode("append").parquet(f"{path}/ledger")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        entered = own.read.schema(_LEDGER).parquet(f"{path}/ledger")
        if not entered.where((F.col("sink") == sink) & (F.col("batch") == number)).isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{path}/data/sink={sink}/batch={number}")
        own.createDataFrame([(sink, number)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all entered batches; a batch that is being written has no part in it."""
    entered = spark.read.schema(_LEDGER).parquet(f"{path}/ledger").distinct()
    if entered.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, {_LEDGER}").option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(entered, ["sink", "batch"], "left_semi").drop("sink", "batch")
