"""Tables a job writes for itself, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as the session names it.

    Only a local session without the setting gets a temporary folder; on a
    cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="pageflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path below ``folder``, or else the shared folder, that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{folder or f'{shared_dir(spark)}/pageflow/{app}'}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of tables that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that several later steps read: the work behind them is done
    once, column pruning works on what is read back, sizes are known exactly,
    and a lost executor costs a re-read instead of a re-run.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of pages or posting blocks that go to Python, and that a reader of Parquet holds, at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """The session hands out and reads at most ``BATCH_ROWS`` rows at a time, or fewer if it is set so.

    Spark's 10,000 rows of pages or blocks are tens of megabytes, several times over in both processes of each task.
    """
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


#: Keys of at most so many bytes are sent to every task.
BROADCAST_BYTES = 64 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a stored table's values: texts as they are, 8 for anything else, arrays by their elements."""

    def size(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.octet_length(value) + 8
        if kind.startswith("array<"):
            return F.octet_length(F.to_json(F.struct(value)))
        return F.lit(8)

    total = F.lit(0)
    for name, kind in df.dtypes:
        total = total + F.coalesce(size(name, kind), F.lit(8))
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a staged table for broadcast only when the size of its values allows."""
    if stored_bytes(df) <= max_bytes:
        return F.broadcast(df)
    return df


def only_wanted(wide: DataFrame, wanted: DataFrame, on: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of a wide table whose key is wanted, without moving the table.

    The wanted keys are written down and measured; up to ``max_bytes`` they go
    to every task.  Beyond that both sides are joined by shuffle, which a page
    store (``sources.pagestore``) avoids.
    """
    keys = staged(wanted.select(on).distinct(), f"wanted-{on}")
    return wide.join(broadcast_if_small(keys, max_bytes), on, "left_semi")
