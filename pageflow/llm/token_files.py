"""Token ids in ORC files, in order of document id.

Ids are run-length encoded integers by ORC's own writer; row indexes and Bloom
filters on the document id let a reader skip stripes and row groups, and
stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageflow.llm.tokens import encoded_slices


@dataclass(frozen=True)
class TokenFileSettings:
    tokenizer: str
    end_id: int = 2
    stripe_bytes: int = 16 << 20
    index_rows: int = 1_000


def write_token_files(
    docs: DataFrame, path: str, settings: TokenFileSettings, key: str = "doc_id", text: str = "text"
) -> None:
    """Write rows (doc_id, file_no, before, n_tokens, input_ids) as ORC, ascending by doc_id.

    ``file_no`` rises with doc_id, ``before`` counts the ids ahead of the row in
    its file.  A null or empty text has the end id only.  Null keys come
    first, rows with equal keys in order of their text.  Only the two named
    columns are read; an empty table writes files without rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, seen = TaskContext.get().partitionId(), 0
        for part, ids, ends in encoded_slices(batches, "text", settings.tokenizer, settings.end_id):
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.full(len(part), file_no, np.int64)),
                    pa.array(seen + offsets[:-1].astype(np.int64)),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                ],
                names=["doc_id", "file_no", "before", "n_tokens", "input_ids"],
            )
            seen += int(ends[-1])

    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    (
        ordered.mapInArrow(rows, "doc_id long, file_no long, before long, n_tokens long, input_ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", settings.index_rows)
        .option("orc.stripe.size", settings.stripe_bytes)
        .option("compression", "snappy")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_token_files``; filters on doc_id skip files, stripes and row groups."""
    return spark.read.schema("doc_id long, file_no long, before long, n_tokens long, input_ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) as read from the files.

    ``start`` is the number of ids of all rows before; files are added up
    first, so the running sum has one row for each file.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = lists.values.to_numpy().astype("<u4")
            offsets = lists.offsets.to_numpy()
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(np.array(crcs, np.int64)),
                ],
                names=["doc_id", "file_no", "before", "n_tokens", "ids_crc32"],
            )

    files = read_token_files(spark, path)
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.groupBy("file_no")
        .agg(F.sum("n_tokens").alias("ids"))
        .select("file_no", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ahead"))
    )
    rows = files.select("doc_id", "file_no", "before", "input_ids").mapInArrow(
        checked, "doc_id long, file_no long, before long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, "file_no").select(
        "doc_id", (F.col("before") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32"
    )
