"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one class.  Classes within half the linking angle of a leader
form a cell, whose members are then all linked, so a dense group costs one
graph node.  Leaders are put into overlapping cluster shards; each shard builds
a robust-pruned graph, the adjacency lists of all shards are united, and a
greedy search from the shard's medoid expands over everything in range.  A shard
too large for one task is split, and all its splits are compared with each
other; such a pair counts in one shard only and never leaves the task.  Recall
is audited against brute force; links are verified in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.llm.components import components
from pageflow.sources.shared import staged


@dataclass(frozen=True)
class VectorSettings:
    cosine: float = 0.9
    #: Vectors for each cluster; centroids are a sample of the vectors,
    shard_rows: int = 150
    #: at most so many of them, which also bounds what every task gets.
    max_centroids: int = 65_536
    #: Shards that a leader is put into.
    overlap: int = 4
    degree: int = 16
    prune: float = 1.2
    beam: int = 32
    #: Rows of a shard beyond which it is split by hash.
    max_shard_rows: int = 4_000
    #: Vectors whose true links are found by brute force, and the share that must have been found.
    audited: int = 256
    recall: float = 0.95
    #: Members of a cell compared at once.
    block: int = 512


#: Angles closer than this are settled by exact cosines.
_SLACK = 1e-6


def valid(vector: Column) -> Column:
    """Whether a vector can link: no null or non-finite component, and not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Unit vectors in double precision; lengths may differ."""
    out = []
    for x in column.to_pylist():
        x = np.array(x, np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt(x @ x))
    return out


class Clusters:
    """Centroids by dimension; the nearest ones of a vector are its shards."""

    def __init__(self, vectors: list[np.ndarray], max_rows: int) -> None:
        self.max_rows = max_rows
        self.by_size: dict[int, np.ndarray] = {}
        for size in {len(v) for v in vectors}:
            self.by_size[size] = np.array([v for v in vectors if len(v) == size])

    def shards(self, units: list[np.ndarray], n: int) -> list[list[int]]:
        """For each vector the numbers of its ``n`` nearest clusters; a dimension has its own numbers."""
        out: list[list[int]] = [[] for _ in units]
        for size in {len(u) for u in units}:
            rows = [i for i, u in enumerate(units) if len(u) == size]
            centroids = self.by_size.get(size)
            if centroids is None:
                for i in rows:
                    out[i] = [size << 32]
                continue
            sims = np.array([units[i] for i in rows]) @ centroids.T
            near = np.argsort(-sims, axis=1, kind="stable")[:, :n]
            for i, of in zip(rows, near.tolist(), strict=True):
                out[i] = [(size << 32) + 1 + c for c in of]
        return out


def _sharded(vectors: DataFrame, clusters: Clusters, n: int) -> DataFrame:
    """Add ``shard``, one row for each of the vector's ``n`` shards; rows node, vector and others."""
    schema = vectors.schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def assign(batches):
        for batch in batches:
            of = clusters.shards(_units(batch.column("vector")), n)
            take = pa.array(np.repeat(np.arange(len(batch)), [len(x) for x in of]))
            shard = pa.array([s for x in of for s in x], pa.int64())
            moved = batch.take(take)
            yield pa.RecordBatch.from_arrays([*moved.columns, shard], names=[*batch.schema.names, "shard"])

    placed = staged(vectors.mapInArrow(assign, f"{fields}, shard long"), "sharded")
    sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    splits = F.ceil(F.col("rows") / clusters.max_rows)
    placed = placed.join(sizes, "shard").withColumn("splits", splits).drop("rows")
    return placed.withColumn("split", F.pmod(F.xxhash64("node"), F.col("splits")))


def _clusters(vectors: DataFrame, settings: VectorSettings) -> Clusters:
    """Sample centroids: at most ``max_centroids`` vectors, of linked ones the first.

    So a group whose vectors all link has one centroid and shares that shard.
    """
    n = min(settings.max_centroids, max(1, math.ceil(vectors.count() / settings.shard_rows)))
    sample = vectors.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(n).toArrow()
    units = _units(sample.column("vector"))
    apart: list[np.ndarray] = []
    for size in sorted({len(u) for u in units}):
        of = np.array([u for u in units if len(u) == size])
        apart += list(of[leader_cells(of, settings.cosine) == np.arange(len(of))])
    return Clusters(apart, settings.max_shard_rows)


def leader_cells(units: np.ndarray, cosine: float) -> np.ndarray:
    """Row of each vector's leader: the first earlier leader within ``cosine``, else itself."""
    leader = np.arange(len(units))
    leaders: list[int] = []
    for begin in range(0, len(units), 256):
        block = units[begin : begin + 256]
        known = np.array(leaders, np.int64)
        free = np.ones(len(block), bool)
        if len(known):
            near = block @ units[known].T >= cosine
            free = ~near.any(axis=1)
            leader[begin : begin + 256][~free] = known[near.argmax(axis=1)][~free]
        own = block @ block.T >= cosine
        for i in np.flatnonzero(free):
            if free[i]:
                leaders.append(begin + i)
                mine = own[i] & free
                leader[begin : begin + 256][mine] = begin + i
                free &= ~own[i]
    return leader


def cells(classes: DataFrame, settings: VectorSettings) -> DataFrame:
    """Rows (node, vector, copies, cell, angle): the cell's leader node and the angle to it."""
    half = math.cos(math.acos(settings.cosine) / 2 - _SLACK)

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes = table.column("node").to_numpy()
        units = np.array(_units(table.column("vector")))
        leader = leader_cells(units, half)
        cosines = np.clip(np.einsum("ij,ij->i", units, units[leader]), -1, 1)
        angle = np.where(leader == np.arange(len(units)), 0.0, np.arccos(cosines))
        return table.select(["node", "vector", "copies"]).append_column("cell", pa.array(nodes[leader])).append_column(
            "angle", pa.array(angle)
        )

    sharded = _sharded(classes.select("node", "vector", "copies"), _clusters(classes, settings), 1)
    return sharded.groupBy("shard", "split").applyInArrow(
        gather, "node long, vector array<double>, copies long, cell long, angle double"
    )


def pruned_graph(units: np.ndarray, degree: int, prune: float) -> list[list[int]]:
    """Robust pruning: a neighbour is dropped if a kept one is clearly closer to it than the vector is."""
    out = []
    pool = min(4 * degree, len(units) - 1)
    for begin in range(0, len(units), 512):
        sims = units[begin : begin + 512] @ units.T
        for i, row in enumerate(sims):
            row[begin + i] = -np.inf
            if not pool:
                out.append([])
                continue
            left = np.argpartition(-row, pool - 1)[:pool]
            left = left[np.lexsort((left, -row[left]))]
            kept: list[int] = []
            while len(left) and len(kept) < degree:
                best, left = left[0], left[1:]
                kept.append(int(best))
                between = np.sqrt(np.maximum(0, 2 - 2 * (units[left] @ units[best])))
                own = np.sqrt(np.maximum(0, 2 - 2 * row[left]))
                left = left[prune * between > own]
            out.append(kept)
    return out


def range_search(units: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, least: np.ndarray, beam: int) -> list[np.ndarray]:
    """Rows with a cosine of at least ``least`` to each query row, found along the graph.

    ``graph``: neighbours of each row, filled up with -1.  A greedy beam from
    ``start`` comes first; then every row in range is expanded until no new one is.
    """
    n, many = len(units), len(queries)
    sims = np.full((many, n), -np.inf)
    done = np.zeros((many, n), bool)
    sims[:, start] = units[queries] @ units[start]

    def expand(who: np.ndarray, node: np.ndarray) -> None:
        done[who, node] = True
        near = graph[node]
        rows = np.repeat(who, near.shape[1])
        near = near.ravel()
        fresh = near >= 0
        fresh[fresh] = sims[rows[fresh], near[fresh]] == -np.inf
        rows, near = rows[fresh], near[fresh]
        sims[rows, near] = np.einsum("ij,ij->i", units[queries[rows]], units[near])

    width = min(beam, n)
    while True:
        best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        values = np.take_along_axis(sims, best, 1)
        values[np.take_along_axis(done, best, 1)] = -np.inf
        first = values.argmax(axis=1)
        active = np.flatnonzero(values[np.arange(many), first] > -np.inf)
        if not len(active):
            break
        expand(active, best[active, first[active]])
    while True:
        who, node = np.nonzero((sims >= least[:, None]) & ~done)
        if not len(who):
            break
        expand(who, node)
    return [np.flatnonzero(row >= bound) for row, bound in zip(sims, least, strict=True)]


def _reach(settings: VectorSettings, own: np.ndarray, widest: float) -> np.ndarray:
    """Cosine down to which leaders may have linked members."""
    return np.cos(np.minimum(np.pi, math.acos(settings.cosine) + own + widest + _SLACK))


def _common(x: list[list[int]], y: list[list[int]], below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is positive where entries of x and y share a number (below ``below``)."""
    numbers = {v for of in x for v in of} & {v for of in y for v in of}
    place = {v: i for i, v in enumerate(sorted(v for v in numbers if below is None or v < below))}
    out = []
    for side in (x, y):
        held = np.zeros((len(side), len(place)), np.float32)
        for i, of in enumerate(side):
            held[i, [place[v] for v in of if v in place]] = 1
        out.append(held)
    return out[0], out[1].T


def _groups(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column the row that names its component; columns without a link have -1."""
    of_row, of_column = (np.full(n, -1) for n in linked.shape)
    for first in range(len(linked)):
        rows = np.array([first]) if of_row[first] < 0 else np.zeros(0, np.int64)
        while len(rows):
            of_row[rows] = first
            columns = np.flatnonzero(linked[rows].any(axis=0) & (of_column < 0))
            of_column[columns] = first
            left = np.flatnonzero(of_row < 0)
            rows = left[linked[np.ix_(left, columns)].any(axis=1)] if len(columns) else columns
    return of_row, of_column


def _split_pairs(sharded: DataFrame, settings: VectorSettings) -> DataFrame:
    """Rows (kind, a, b, links) of the pairs of leaders that share a shard of several splits.

    Kind 0: a pair that may have linked members; kind 1: cells that link, enough
    to connect all of the task; kind 2: how many members of other cells every
    member of cell a links with.  A pair counts in the first such shard it shares.
    """
    angle = math.acos(settings.cosine)

    def compare(table: pa.Table) -> pa.Table:
        this, p, q = (table.column(c)[0].as_py() for c in ("shard", "p", "q"))
        split = table.column("split").to_numpy()
        x, y = (table.filter(pa.array(split == k)) for k in (p, q))
        if not len(x) or not len(y):
            return pa.table([pa.array([], pa.int64())] * 4, names=["kind", "a", "b", "links"])
        (nodes_x, angles_x, sizes_x), (nodes_y, angles_y, sizes_y) = (
            [t.column(c).to_numpy() for c in ("node", "angle", "size")] for t in (x, y)
        )
        units_x, units_y = (np.array(_units(t.column("vector"))) for t in (x, y))
        held_x, held_y = _common(*(t.column("large").to_pylist() for t in (x, y)), below=this)
        sure = np.zeros((len(x), len(y)), bool)
        unsure: list[tuple[np.ndarray, np.ndarray]] = []
        for begin in range(0, len(x), 512):
            rows = slice(begin, begin + 512)
            apart = np.arccos(np.clip(units_x[rows] @ units_y.T, -1, 1))
            wide = angles_x[rows, None] + angles_y[None]
            mine = nodes_x[rows, None] < nodes_y[None] if p == q else nodes_x[rows, None] != nodes_y[None]
            if held_x.shape[1]:
                mine &= held_x[rows] @ held_y == 0
            sure[rows] = mine & (apart + wide < angle - _SLACK)
            i, j = np.nonzero(mine & ~sure[rows] & (apart - wide <= angle + _SLACK))
            unsure.append((nodes_x[rows][i], nodes_y[j]))
        of_row, of_column = _groups(sure)
        tied = [(nodes_x[of_row], nodes_x), (nodes_x[of_column[of_column >= 0]], nodes_y[of_column >= 0])]
        a, b = (np.concatenate(c) for c in zip(*tied, strict=True))
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        links_x, links_y = sure @ sizes_y, sizes_x @ sure
        near_x, near_y = (np.concatenate(c) for c in zip(*unsure, strict=True))
        near_x, near_y = np.minimum(near_x, near_y), np.maximum(near_x, near_y)
        counts = [(nodes_x[links_x > 0], links_x[links_x > 0]), (nodes_y[links_y > 0], links_y[links_y > 0])]
        cells, links = (np.concatenate(c) for c in zip(*counts, strict=True))
        kind = np.repeat([0, 1, 2], [len(near_x), len(a), len(cells)])
        none = np.zeros(len(near_x) + len(a), np.int64)
        return pa.table(
            {
                "kind": kind,
                "a": np.concatenate([near_x, a, cells]),
                "b": np.concatenate([near_y, b, np.zeros(len(cells), np.int64)]),
                "links": np.concatenate([none, links]),
            }
        )

    large = sharded.where("splits > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
    blocks = large.select("*", F.least("split", "other").alias("p"), F.greatest("split", "other").alias("q"))
    return blocks.groupBy("shard", "p", "q").applyInArrow(compare, "kind long, a long, b long, links long")


def leader_pairs(leaders: DataFrame, widest: float, settings: VectorSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaders (node, vector, angle, size) that may have linked members.

    Rows (a, b), a < b, still to be verified; rows (kind, a, b, links) of ``_split_pairs``,
    none of them among the former; and rows (node, large): the node's shards of several splits.
    """

    def build(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        lists = pruned_graph(np.array(_units(table.column("vector"))), settings.degree, settings.prune)
        return pa.table({"node": table.column("node"), "near": pa.array([nodes[x] for x in lists], pa.list_(pa.int64()))})

    def search(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        units = np.array(_units(table.column("vector")))
        row = {node: i for i, node in enumerate(nodes.tolist())}
        lists = [[row[x] for x in near if x in row] for near in table.column("near").to_pylist()]
        graph = np.full((len(nodes), max(1, max(map(len, lists)))), -1, np.int64)
        for i, near in enumerate(lists):
            graph[i, : len(near)] = near
        medoid = int((units @ units.sum(axis=0)).argmax())
        angles = table.column("angle").to_numpy()
        large = table.column("large").to_pylist()
        held, across = _common(large, large)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for begin in range(0, len(nodes), 256):
            queries = np.arange(begin, min(begin + 256, len(nodes)))
            least = _reach(settings, angles[queries], widest)
            for q, found in zip(queries, range_search(units, graph, medoid, queries, least, settings.beam), strict=True):
                found = found[(found != q) & (held[q] @ across[:, found] == 0)]
                pairs.append((np.minimum(nodes[q], nodes[found]), np.maximum(nodes[q], nodes[found])))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return pa.table({"a": a, "b": b})

    sharded = staged(_sharded(leaders, _clusters(leaders, settings), settings.overlap), "shards")
    large = sharded.groupBy("node").agg(F.sort_array(F.collect_list(F.when(F.col("splits") > 1, F.col("shard")))).alias("large"))
    large = staged(large, "large-shards")
    sharded = staged(sharded.join(large, "node"), "shards")
    small = sharded.where("splits = 1")
    built = small.groupBy("shard").applyInArrow(build, "node long, near array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = small.join(staged(united, "graph"), "node")
    found = ready.groupBy("shard").applyInArrow(search, "a long, b long")
    direct = staged(_split_pairs(sharded, settings), "split-pairs")
    pairs = found.unionByName(direct.where("kind = 0").select("a", "b")).distinct()
    return staged(pairs, "leader-pairs"), direct.where("kind > 0"), large


def _audited(members: DataFrame, settings: VectorSettings) -> DataFrame:
    """Rows (node, vector): half drawn evenly from the leaders, half from all vectors by their copies."""
    half = settings.audited // 2
    leaders = members.where("node = cell").orderBy(F.xxhash64("node", F.lit(1)), "node").limit(settings.audited - half)
    chance = (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    by_copies = members.orderBy(F.log(chance) / F.col("copies") * -1, "node").limit(half)
    return leaders.select("node", "vector").unionByName(by_copies.select("node", "vector")).dropDuplicates(["node"])


def audited_recall(members: DataFrame, counted: DataFrame, settings: VectorSettings) -> float:
    """Share of the links of drawn vectors that were found, of all their links or for each vector, whichever is less.

    ``members``: node, vector, copies, cell; ``counted``: node, n_links.  Dense groups
    are drawn as often as they have vectors, and hold most of all links; the mean
    over the vectors keeps them from hiding what others miss.
    """
    sample = staged(_audited(members, settings), "audited")
    drawn = sample.toArrow()
    nodes, units = drawn.column("node").to_numpy(), _units(drawn.column("vector"))

    def compare(batches):
        for batch in batches:
            others, copies = _units(batch.column("vector")), batch.column("copies").to_numpy()
            true = np.zeros(len(units), np.int64)
            for size in {len(u) for u in units}:
                mine = [i for i, u in enumerate(units) if len(u) == size]
                rows = [i for i, u in enumerate(others) if len(u) == size]
                if rows:
                    near = np.array([units[i] for i in mine]) @ np.array([others[i] for i in rows]).T >= settings.cosine
                    true[mine] = near @ copies[rows]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(true)], names=["node", "wanted"])

    true = members.select("vector", "copies").mapInArrow(compare, "node long, wanted long")
    true = true.groupBy("node").agg((F.sum("wanted") - 1).alias("wanted"))
    found = counted.join(sample.select("node"), "node", "left_semi").join(true, "node").select("wanted", "n_links").toArrow()
    wanted, links = (found.column(c).to_numpy() for c in ("wanted", "n_links"))
    linked = wanted > 0
    return float(min(links.sum() / wanted.sum(), (links[linked] / wanted[linked]).mean())) if linked.any() else 1.0


def vector_links(rows: DataFrame, settings: VectorSettings = VectorSettings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, n_links, component_id, kept) of all vectors.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing; vectors of different lengths do not link.  Repeated rows
    and equal vectors link with each other.  ``kept``: the row's key is the
    smallest of its component; a row with a null key counts for the others'
    links and is kept only if it links with nothing.  An empty table gives no row.

    Links found are exact; if the audit finds less than ``recall``, the search
    is repeated with twice the overlap, and at last fails.
    """
    values = F.col(vector).cast("array<double>")
    read = rows.select(F.col(key).alias("vec_id"), values.alias("vector")).withColumn("valid", valid(F.col("vector")))
    classes = read.where("valid").groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = staged(staged(classes, "vectors").withColumn("node", F.monotonically_increasing_id()), "classes")
    members = staged(cells(classes, settings), "cells")
    sizes = members.groupBy("cell").agg(F.max("angle").alias("angle"), F.sum("copies").alias("size"))
    leaders = members.where("node = cell").select("node", "vector").join(sizes.withColumnRenamed("cell", "node"), "node")
    leaders = staged(leaders, "leaders")
    widest = leaders.agg(F.max("angle")).first()[0] or 0.0
    whole = sizes.select("cell", (F.col("size") - 1).alias("own"))
    trial = settings
    pairs, direct, _ = leader_pairs(leaders, widest, trial)
    while True:
        cell_links, member_links = _verified(pairs, direct, leaders, members, settings)
        links = member_links.groupBy("node").agg(F.sum("links").alias("links"))
        counted = members.select("node", "cell").join(whole, "cell").join(links, "node", "left")
        counted = staged(
            counted.select("node", "cell", (F.col("own") + F.coalesce("links", F.lit(0))).alias("n_links")), "counted"
        )
        if audited_recall(members, counted, settings) >= settings.recall:
            break
        if trial.overlap > 64:
            raise RuntimeError("the audit finds too few neighbours; raise degree, beam or overlap")
        trial = replace(trial, overlap=2 * trial.overlap, beam=2 * trial.beam)
        more, direct, large = leader_pairs(leaders, widest, trial)
        # shards only grow with the overlap; what shares one of several splits by now is among the direct ones
        earlier = pairs.join(large.toDF("a", "large_a"), "a").join(large.toDF("b", "large_b"), "b")
        earlier = earlier.where(~F.arrays_overlap("large_a", "large_b")).select("a", "b")
        pairs = staged(more.unionByName(earlier).distinct(), "leader-pairs")

    roots = components(cell_links)
    linked = counted.join(roots.withColumnRenamed("node", "cell"), "cell", "left").select(
        "node", "n_links", F.coalesce("root", "cell").alias("root")
    )
    known = staged(classes.select("node", "vector", "first_id").join(linked, "node"), "linked")
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "root").select("vector", "n_links", "component_id")
    joined = read.join(known.withColumn("valid", F.lit(True)), ["vector", "valid"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        F.col("vec_id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.when(F.col("vec_id").isNull(), F.coalesce("n_links", F.lit(0)) == 0).otherwise(F.col("vec_id") == component).alias("kept"),
    )


def _verified(
    pairs: DataFrame, direct: DataFrame, leaders: DataFrame, members: DataFrame, settings: VectorSettings
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between cells, and rows (node, links): how many vectors of other cells each links with.

    Where the angles leave no doubt a cell counts as a whole; else its members
    are compared in blocks, and only counts leave the task.  ``direct`` holds
    the links and counts of ``_split_pairs``.
    """
    angle = math.acos(settings.cosine)

    def between(batches):
        for batch in batches:
            x, y = (_units(batch.column(c)) for c in ("vector_a", "vector_b"))
            cosines = np.array([u @ v if len(u) == len(v) else -1.0 for u, v in zip(x, y, strict=True)])
            apart = np.arccos(np.clip(cosines, -1, 1))
            wide = batch.column("angle_a").to_numpy() + batch.column("angle_b").to_numpy()
            kind = np.where(apart + wide < angle - _SLACK, 1, np.where(apart - wide > angle + _SLACK, 0, 2))
            keep = batch.select(["a", "b", "size_a", "size_b"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(kind)], names=["a", "b", "size_a", "size_b", "kind"])

    def side(name: str) -> DataFrame:
        return leaders.select(*[F.col(c).alias(f"{c}_{name}") for c in ("vector", "angle", "size")], F.col("node").alias(name))

    judged = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(
        between, "a long, b long, size_a long, size_b long, kind long"
    )
    judged = staged(judged.where("kind > 0"), "judged")
    sure = judged.where("kind = 1")
    by_cell = sure.select(F.col("a").alias("cell"), F.col("size_b").alias("links")).unionByName(
        sure.select(F.col("b").alias("cell"), F.col("size_a").alias("links"))
    )
    by_cell = by_cell.unionByName(direct.where("kind = 2").select(F.col("a").alias("cell"), "links"))
    whole = members.select("node", "cell").join(by_cell.groupBy("cell").agg(F.sum("links").alias("links")), "cell")

    unsure = judged.where("kind = 2").select("a", "b")
    touched = unsure.select(F.col("a").alias("cell")).unionByName(unsure.select(F.col("b").alias("cell"))).distinct()
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / settings.block))
    parts = (
        members.join(touched, "cell", "left_semi").join(sizes, "cell").withColumn("part", part)
        .groupBy("cell", "part")
        .agg(F.collect_list(F.struct("node", "vector", "copies")).alias("members"))
    )
    parts = staged(parts, "cell-parts")

    def compare(batches):
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row in batch.to_pylist():
                x, y = row["x"], row["y"]
                near = np.array(_units(pa.array([m["vector"] for m in x]))) @ np.array(_units(pa.array([m["vector"] for m in y]))).T
                near = near >= settings.cosine
                if near.any():
                    for these, links in ((x, near @ [m["copies"] for m in y]), (y, near.T @ [m["copies"] for m in x])):
                        out += [(row["a"], row["b"], m["node"], int(n)) for m, n in zip(these, links, strict=True) if n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["a", "b", "node", "links"]
            )

    blocks = unsure.join(parts.select(F.col("cell").alias("a"), F.col("members").alias("x")), "a").join(
        parts.select(F.col("cell").alias("b"), F.col("members").alias("y")), "b"
    )
    found = staged(blocks.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, node long, links long"), "compared")
    cell_links = sure.select("a", "b").unionByName(found.select("a", "b"))
    cell_links = cell_links.unionByName(direct.where("kind = 1").select("a", "b")).distinct()
    return cell_links, whole.select("node", "links").unionByName(found.select("node", "links"))
