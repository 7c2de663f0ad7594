"""Exact top-k search by inner product, by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets.  A query's k-th best product
so far, divided by its own length and a bucket's longest vector, is the cosine
that a vector of the bucket must reach: above one, the bucket and all shorter
ones are out.  Else each query takes from the bucket either its vectors of
enough length, or those whose coordinate lies where such a cosine allows it,
whichever are fewer, and verifies them by exact integer products.

Queries lie in blocks.  The longest bucket gives each query a first threshold;
with it, buckets that no query of a block can use are dropped before they move.
A block meets its buckets in a few runs, each a stream of buckets from long to
short, so that a task holds one block and one batch of buckets whatever the
size of the table.  Copies of vectors need no care: a bucket has a fixed number
of rows and ties are cut by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.sources.shared import staged


@dataclass(frozen=True)
class ProductSettings:
    k: int = 20
    #: Components become floor(scale * x).
    scale: int = 64
    #: Vectors of a bucket, and of a block of queries at least and at most.
    bucket_rows: int = 512
    block_rows: tuple[int, int] = (256, 16_384)
    #: Blocks that a small set of queries is dealt to.
    blocks: int = 4
    #: Streams of buckets that a block meets side by side.
    runs: int = 16
    #: Largest coordinates of a query that are looked up.
    focus: int = 4
    #: A coordinate decides where it leaves at most this share of what length leaves.
    coordinate_share: float = 0.125


#: Bounds give way by this much, so that rounding loses nothing.
_SLACK = 1e-9
_NONE = np.iinfo(np.int64).min
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53


def quantised(vectors: DataFrame, settings: ProductSettings, key: str, vector: str) -> DataFrame:
    """Stored rows (row, id, vector, dim, n2) of the vectors that take part, with a number for each row."""
    x = F.col("vector")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floors = F.transform(x, lambda c: F.floor(F.lit(float(settings.scale)) * c.cast("double")))
    taken = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where(
        x.isNotNull() & F.coalesce(sound, F.lit(False))
    )
    square = F.aggregate("vector", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    return staged(
        taken.select(F.monotonically_increasing_id().alias("row"), "id", floors.alias("vector"))
        .withColumn("dim", F.size("vector"))
        .withColumn("n2", square),
        "quantised",
    )


_PACKED = "bucket long, dim int, longest double, n int, kind string, rows array<long>, ids array<long>, vectors binary"


def _packed(sorted_rows: DataFrame, most: int) -> DataFrame:
    """Consecutive rows of one (dim, part) as one row, at most ``most`` of them; numbers follow the order."""

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, n
            table = pa.Table.from_batches(held).combine_chunks()
            dim = table.column("dim")[0].as_py()
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            values = np.asarray(flat, np.int64)
            kind = np.result_type(*(np.min_scalar_type(int(v)) for v in (values.min(), -values.max() - 1)), np.int8) if len(values) else np.dtype(np.int8)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([dim], pa.int32()),
                    pa.array([math.sqrt(table.column("n2").to_numpy().max())]),
                    pa.array([n], pa.int32()),
                    pa.array([kind.str]),
                    pa.array([table.column("row").to_pylist()], pa.list_(pa.int64())),
                    pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([values.astype(kind).tobytes()], pa.binary()),
                ],
                names=[f.split()[0] for f in _PACKED.split(", ")],
            )
            number, held, n = number + 1, [], 0
            return batch

        last = None
        for batch in batches:
            dims, parts = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "part"))
            at = 0
            while at < len(batch):
                key = dims[at], parts[at]
                if n and (key != last or n == most):
                    yield flush()
                last = key
                same = np.flatnonzero((dims[at:] != key[0]) | (parts[at:] != key[1]))
                end = min(at + (int(same[0]) if len(same) else len(batch) - at), at + most - n)
                held.append(batch.slice(at, end - at))
                n += end - at
                at = end
        if n:
            yield flush()

    return sorted_rows.select("row", "id", "vector", "dim", "n2", "part").mapInArrow(packing, _PACKED)


class _Vectors:
    """The vectors of one packed row."""

    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.values = np.frombuffer(row["vectors"], np.dtype(row["kind"])).reshape(n, dim)
        self.exact = self.values.astype(np.float64)
        self.length = np.sqrt((self.exact**2).sum(axis=1))
        self.rows = np.array(row["rows"], np.int64)
        self.missing = np.array([i is None for i in row["ids"]])
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)

    def unit(self) -> np.ndarray:
        return self.exact / np.maximum(self.length, 1e-300)[:, None]


def _products(a: _Vectors, rows: np.ndarray, b: _Vectors, columns: np.ndarray | slice) -> np.ndarray:
    """Exact integer products; beyond 64 bits they stay at the end of the range."""
    if a.length[rows].max(initial=0) * b.length[columns].max(initial=0) < _EXACT:
        return (a.exact[rows] @ b.exact[columns].T).astype(np.int64)
    exact = a.values[rows].astype(object) @ b.values[columns].astype(object).T
    bounds = np.iinfo(np.int64)
    return np.clip(exact, bounds.min, bounds.max).astype(np.int64)


class _Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, n: int, k: int, theta: list[int | None] | None) -> None:
        self.k = k
        #: Product of the k-th best, from here or from an earlier search; _NONE while fewer are known.
        self.theta = np.array([_NONE if t is None else t for t in theta or [None] * n], np.int64)
        self.held = np.zeros((0, 5), np.int64)

    def offer(self, query: np.ndarray, score: np.ndarray, of: _Vectors, at: np.ndarray) -> None:
        if not len(query):
            return
        fresh = np.stack([query, score, of.missing[at].astype(np.int64), of.ids[at], of.rows[at]], axis=1)
        rows = np.concatenate([self.held, fresh])
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], ~rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        self.held = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.theta[last[:, 0]] = np.maximum(self.theta[last[:, 0]], last[:, 1])


class _Block:
    """A block of queries with its best candidates."""

    def __init__(self, row: dict, settings: ProductSettings) -> None:
        self.row, self.settings = row, settings
        self.queries = _Vectors(row)
        self.best = _Best(row["n"], settings.k, row["theta"])
        self.units = self.queries.unit()
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, : settings.focus]

    def meet(self, bucket: _Vectors) -> None:
        """Take what a bucket, sorted from long to short, has for the queries."""
        q, best = self.queries, self.best
        theta = np.where(best.theta == _NONE, -np.inf, best.theta.astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(q.length > 0, theta / q.length, np.where(theta > 0, np.inf, -np.inf))
            local = np.where(bucket.length[0] > 0, need / bucket.length[0], np.where(need > 0, np.inf, -np.inf))
        active = np.flatnonzero(local <= 1 + _SLACK)
        if not len(active):
            return
        reach = np.searchsorted(-bucket.length, -(need[active] - np.abs(need[active]) * _SLACK), "right")
        ranges, begin, coordinate, order = self._by_coordinate(bucket, active, local[active])
        narrow = ranges < reach * self.settings.coordinate_share
        self._verify(active[~narrow], int(reach[~narrow].max(initial=0)), bucket)
        for i in np.flatnonzero(narrow):
            query = active[i : i + 1]
            at = order[begin[i] : begin[i] + ranges[i], coordinate[i]]
            score = _products(q, query, bucket, at)[0] if len(at) else np.zeros(0, np.int64)
            kept = (score >= best.theta[query[0]]) & (bucket.rows[at] != q.rows[query[0]])
            best.offer(np.repeat(query, int(kept.sum())), score[kept], bucket, at[kept])

    def _by_coordinate(self, bucket: _Vectors, active: np.ndarray, local: np.ndarray) -> tuple:
        """For each active query the focus coordinate that leaves fewest vectors.

        A vector within the angle of a cosine has each unit coordinate between
        the cosines of the sum and of the difference of the two angles.
        """
        n = len(bucket.length)
        best = np.full(len(active), n), np.zeros(len(active), np.int64), np.zeros(len(active), np.int64)
        near = np.flatnonzero(local > 0)
        units = bucket.unit()
        order = np.argsort(units, axis=0, kind="stable")
        if not len(near) or not units.shape[1]:
            return *best, order
        columns = np.take_along_axis(units, order, axis=0)
        cone = np.arccos(np.clip(local[near], 0, 1))
        for f in self.focus[active[near]].T:
            angle = np.arccos(np.clip(self.units[active[near], f], -1, 1))
            low = np.cos(np.minimum(angle + cone, np.pi)) - _SLACK
            high = np.cos(np.maximum(angle - cone, 0)) + _SLACK
            for c in np.unique(f):
                of = np.flatnonzero(f == c)
                first = np.searchsorted(columns[:, c], low[of], "left")
                size = np.searchsorted(columns[:, c], high[of], "right") - first
                better = size < best[0][near[of]]
                for slot, value in zip(best, (size, first, np.full(len(of), c)), strict=True):
                    slot[near[of[better]]] = value[better]
        return *best, order

    def _verify(self, queries: np.ndarray, longest: int, bucket: _Vectors) -> None:
        """Products of the queries with the first ``longest`` vectors."""
        if not len(queries) or not longest:
            return
        score = _products(self.queries, queries, bucket, slice(0, longest))
        bound = self.best.theta[queries]
        own = self.queries.rows[queries][:, None] == bucket.rows[:longest][None, :]
        ranked = np.where(own, _NONE, score)
        if longest > self.best.k:
            bound = np.maximum(bound, np.partition(ranked, longest - self.best.k, axis=1)[:, longest - self.best.k])
        row, at = np.nonzero((ranked >= bound[:, None]) & ~own)
        self.best.offer(queries[row], score[row, at], bucket, at)

    def needed_length(self) -> float:
        """Length that a vector must have to be of use to any query of the block."""
        theta = np.where(self.best.theta == _NONE, 0.0, self.best.theta.astype(np.float64))
        return float((np.maximum(theta, 0) / np.maximum(self.queries.length, 1e-300)).min() * (1 - _SLACK))


_MET = f"block long, run int, rank long, theta array<long>, {_PACKED.removeprefix('bucket long, ')}"


def _streams(blocks: DataFrame, pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each block, then its buckets from long to short, for each of its runs; sorted within tasks."""
    names = [f.split()[0] for f in _MET.split(", ")]
    parts = pairs.select("block", "run").distinct().join(blocks.drop("dim"), "block")
    asked = parts.join(blocks.select("block", "dim"), "block").withColumn("rank", F.lit(-1).cast("long"))
    met = pairs.join(buckets, "bucket").withColumn("rank", F.col("bucket")).withColumn("theta", F.lit(None).cast("array<long>"))
    both = asked.select(*names).unionByName(met.select(*names))
    return both.repartition("block", "run").sortWithinPartitions("block", "run", "rank")


def _met(batches: Iterator[pa.RecordBatch], settings: ProductSettings) -> Iterator[_Block]:
    """Blocks that have met all buckets of their run."""
    block = None
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["rank"] < 0:
                if block is not None:
                    yield block
                block = _Block(row, settings)
            else:
                block.meet(_Vectors(row))
    if block is not None:
        yield block


def _with_thresholds(streams: DataFrame, settings: ProductSettings) -> DataFrame:
    """Blocks with the k-th best product of each query so far, and the length a vector needs."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _met(batches, settings):
            row = dict(block.row)
            row["theta"] = [None if t == _NONE else t for t in block.best.theta.tolist()]
            row["need"] = block.needed_length()
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    packed = [
        ("longest", pa.float64()), ("n", pa.int32()), ("kind", pa.string()), ("rows", pa.list_(pa.int64())),
        ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()),
    ]
    first = [("block", pa.int64()), ("run", pa.int32()), ("rank", pa.int64()), ("theta", pa.list_(pa.int64())), ("dim", pa.int32())]
    schema = pa.schema([*first, *packed, ("need", pa.float64())])
    return streams.mapInArrow(search, f"{_MET}, need double").drop("run", "rank")


def _found(streams: DataFrame, settings: ProductSettings) -> DataFrame:
    """Rows (query_row, query_id, missing, vec_id, score) that a run found for its queries."""
    names = ["query_row", "query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _met(batches, settings):
            query, score, missing, ids, _ = block.best.held.T
            of = block.queries
            columns = [pa.array(of.rows[query]), pa.array(of.ids[query]), pa.array(ids, mask=missing.astype(bool)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return streams.mapInArrow(search, "query_row long, query_id long, vec_id long, score long")


def top_products(
    vectors: DataFrame,
    queries: Column,
    settings: ProductSettings = ProductSettings(),
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its ``k`` best other rows, by integer inner product.

    ``queries`` is a condition on the column ``id``, the key as a long.  Every
    row but the query's own is a candidate, so a copy of the query is one, also
    under the same id; repeated query rows get their results each.  Equal
    scores are ranked by id, a null id last.  Rows without a vector, or with a
    null or non-finite component, take no part; vectors of different lengths do
    not meet; a vector of zeros scores 0.  Components and scores beyond 64 bits
    stay at the end of the range.  Fewer candidates than ``k`` are all returned;
    an empty table gives no row.
    """
    rows = quantised(vectors, settings, key, vector)
    order = ["dim", "part", F.desc("n2"), "row"]
    whole = rows.withColumn("part", F.lit(0).cast("long"))
    buckets = staged(_packed(whole.repartitionByRange(*order).sortWithinPartitions(*order), settings.bucket_rows), "buckets")

    asked = rows.where(queries & F.col("id").isNotNull())
    least, most = settings.block_rows
    size = min(most, max(least, math.ceil(asked.count() / settings.blocks)))
    n_blocks = max(1, math.ceil(asked.count() / size))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("long"))
    placed = dealt.repartition("dim", "part").sortWithinPartitions("dim", "part", "row")
    none = F.lit(None).cast("array<long>")
    blocks = staged(_packed(placed, 2 * most).withColumnRenamed("bucket", "block").withColumn("theta", none), "query-blocks")

    sizes = buckets.select("bucket", "dim", "longest")
    longest = sizes.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    first = blocks.select("block", "dim").join(longest, "dim").select("block", "bucket", F.lit(0).alias("run"))
    blocks = staged(_with_thresholds(_streams(blocks, first, buckets), settings), "thresholds")

    # every bucket is told to each deal of blocks, of its dimension and with a use for its length
    needs = blocks.select("block", "dim", "need", F.pmod("block", F.lit(n_blocks)).alias("deal"))
    told = sizes.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    pairs = told.join(needs, ["dim", "deal"]).where(F.col("longest") >= F.col("need"))
    run = F.pmod(F.xxhash64("bucket"), F.lit(settings.runs)).cast("int")
    pairs = staged(pairs.select("block", "bucket", run.alias("run")), "bucket-pairs")

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = _found(_streams(blocks.drop("need"), pairs, buckets), settings)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
