"""Texts in blocks, and which of a block's hashes other documents have too.

Searches for repeated content first ask which of billions of hashes occur in
more than one document.  A block sends each hash once, as 32 bits within a
range, to the task that owns the range; back comes one bit for each.  Only
content behind the set bits moves on.  Two hashes of a range rarely agree in
their 32 bits by chance; that adds content to look at and loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.textbytes import slices
from pageflow.sources.shared import fresh_path

#: Hashes of one range, about, at least and at most; hashes are even, so no range is much larger.
RANGE_KEYS = (1 << 18, 1 << 22)
#: Within these bounds ranges grow with the number of blocks, so that a block sends about as many keys a row.
ROW_KEYS = 64

#: (bytes, offsets) of a block -> its ascending distinct hashes, and which of them two of its documents have.
KeyFinder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

def pack(data: np.ndarray) -> bytes:
    return pa.Codec("zstd", 3).compress(data, asbytes=True)


def unpack(data: pa.Buffer, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, size), np.uint8)


BLOCK = "block long, n_bytes long, doc_ids array<long>, ends array<long>, data binary"


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Store the texts as blocks of some megabytes; a null text is empty, a null key stays null."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for first, last, data, offsets in slices(batch, "text"):
                ids = pa.array([batch.column(0).slice(first, last - first).to_pylist()], pa.list_(pa.int64()))
                ends = pa.array([offsets[1:]], pa.list_(pa.int64()))
                columns = [pa.array([number]), pa.array([len(data)]), ids, ends, pa.array([pack(data)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "n_bytes", "doc_ids", "ends", "data"])
                number += 1

    spark = docs.sparkSession
    path = fresh_path(spark, "blocks", folder)
    kind = "binary" if dict(docs.dtypes)[text] == "binary" else "string"
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast(kind).alias("text"))
    narrow.mapInArrow(blocks, BLOCK).write.parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, document ids, bytes, offsets) of each block in a batch that has a block's columns."""
    for i in range(len(batch)):
        ids = batch.column("doc_ids")[i].values
        ends = batch.column("ends")[i].values.to_numpy()
        data = unpack(batch.column("data")[i].as_buffer(), int(ends[-1]))
        yield i, ids, data, np.concatenate([[0], ends])


def n_ranges(n_bytes: int, n_blocks: int, keys_per_byte: float) -> int:
    """Into how many ranges the hashes of the blocks are dealt."""
    least, most = RANGE_KEYS
    return max(1, int(n_bytes * keys_per_byte) // min(max(least, ROW_KEYS * n_blocks), most))


def shared_masks(blocks: DataFrame, find: KeyFinder, keys_per_byte: float) -> DataFrame:
    """Rows (block, masks, shared): for each of the block's hashes, one bit if another document has it.

    ``masks`` is an array of (range, bits, n) in order of the hashes, ``shared``
    the number of bits set.
    """
    n_bytes, n_blocks = blocks.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    ranges = n_ranges(n_bytes or 0, n_blocks, keys_per_byte)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in opened(batch):
                keys, many = find(data, offsets)
                owner = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.searchsorted(owner, np.arange(ranges + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(cuts))
                parts = [(cuts[r], cuts[r + 1]) for r in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int64)),
                        pa.array(np.full(len(used), batch.column("block")[i].as_py())),
                        pa.array([keys[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary()),
                        pa.array([np.packbits(many[a:b]).tobytes() for a, b in parts], pa.binary()),
                    ],
                    names=["range", "block", "keys", "many"],
                )

    def compare(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        sizes = np.array([len(b) // 4 for b in blobs], np.int64)
        keys = np.frombuffer(b"".join(blobs), np.uint32)
        many = np.concatenate(
            [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(table.column("many").to_pylist(), sizes, strict=True)]
        ).astype(bool)
        order = np.argsort(keys, kind="stable")
        run = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
        often = (np.bincount(run) > 1) | (np.bincount(run, weights=many[order]) > 0)
        shared = np.empty(len(keys), bool)
        shared[order] = often[run]
        ends = np.cumsum(sizes)
        masks = [np.packbits(shared[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        found = [int(shared[e - n : e].sum()) for e, n in zip(ends, sizes, strict=True)]
        return pa.table(
            {
                "block": table.column("block"),
                "range": table.column("range"),
                "bits": pa.array(masks, pa.binary()),
                "n": pa.array(sizes),
                "shared": pa.array(found, pa.int64()),
            }
        )

    sent = blocks.select("block", "doc_ids", "ends", "data").mapInArrow(split, "range long, block long, keys binary, many binary")
    answers = sent.groupBy("range").applyInArrow(compare, "block long, range long, bits binary, n long, shared long")
    return answers.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("range", "bits", "n"))).alias("masks"), F.sum("shared").alias("shared")
    )


def with_masks(blocks: DataFrame, masks: DataFrame) -> DataFrame:
    """The blocks with their ``masks``; a block without hashes has none."""
    return blocks.join(masks, "block", "left")


def mask_of(masks: pa.Scalar) -> np.ndarray:
    """The masks of a block as one boolean array."""
    parts = masks.as_py() or []
    if not parts:
        return np.zeros(0, bool)
    return np.concatenate(
        [np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]) for p in parts]
    ).astype(bool)
