"""Prefix tries of conversations: who shares which first turns, and what sharing saves.

Turns are dictionary-encoded: distinct (role, text) pairs are sorted by digest
and numbered in that order.  A conversation is then a row of numbers.  Equal
rows are one sequence, with a count, its smallest conversation and the digest
of all of them.  The sequences are sorted by range; each range shard is a
ternary search tree, filled in median order so that it is balanced, and walked
without recursion to add up members, leaves and savings.  Nodes on the paths of
a shard's first and last sequence may go on in the next shard.  They are merged
by key, and their sums rise along the merged paths by doubling steps.

Texts are read once and never move.  One conversation is one row: 16 bytes a turn
must fit a task.  Everything else is spread by sorted ranges, also copies of one
conversation and conversations with the same first turns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.sources.shared import staged


@dataclass(frozen=True)
class TrieSettings:
    #: Turns of one shard; a longer sequence is a shard of its own.
    shard_turns: int = 100_000
    #: Conversation ids that are written into one piece of the members' list.
    piece_ids: int = 4_096


_COMMA = b","


def encoded(rows: DataFrame) -> DataFrame:
    """Stored rows (conv_id, ids, sizes): each conversation's turns as dictionary numbers and text bytes.

    ``rows`` has conv_id, turn, role, text.  Turns are in order, a null turn
    first; rows with the same turn follow in order of the MD5 of their role
    and text.  A null role or text is empty; rows without conv_id do not count.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    narrow = staged(
        rows.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
        ),
        "turns",
    )
    kinds = narrow.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"))
    ordered = kinds.repartitionByRange("digest").sortWithinPartitions("digest")
    dictionary = staged(ordered.select("digest", F.monotonically_increasing_id().alias("id")), "turn-dictionary")
    spelled = narrow.join(dictionary, "digest")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "id", "n_bytes")
    turns = F.sort_array(F.collect_list(place))
    return staged(
        spelled.groupBy("conv_id").agg(turns.alias("turns")).select(
            "conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes")
        ),
        "encoded",
    )


def sequences(conversations: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """Rows (ids, sizes, n, conv_id, ends_sha256) of (conv_id, ids, sizes): one for each distinct sequence.

    Ids are sorted over all tasks, written down in pieces, and each sequence's
    pieces run through one digest, so a sequence that a third of all
    conversations share costs a task its pieces and no list.
    """
    kind = [("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("piece", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys as rows; a run ends at a batch's end, too."""
        for batch in batches:
            keys, convs = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            at, starts = 0, []
            while at < len(keys):
                end = at + 1
                while end < len(keys) and end - at < settings.piece_ids and keys[end] == keys[at]:
                    end += 1
                starts.append((at, end))
                at = end
            heads = batch.take(pa.array([a for a, _ in starts], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    heads.column("key"), heads.column("conv_id"), pa.array([b - a for a, b in starts], pa.int64()),
                    pa.array([_COMMA.join(b"%d" % c for c in convs[a:b]) for a, b in starts], pa.binary()),
                    heads.column("ids"), heads.column("sizes"),
                ],
                names=[n for n, _ in kind],
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = digest = None

        def out() -> pa.RecordBatch:
            held["ends_sha256"] = digest.hexdigest()
            return pa.RecordBatch.from_pylist([held], schema=pa.schema([*rest, ("ends_sha256", pa.string())]))

        rest = [c for c in kind if c[0] not in ("key", "piece")]
        last = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key, piece = row.pop("key"), row.pop("piece")
                if key == last:
                    digest.update(_COMMA + piece)
                    held["n"] += row["n"]
                    continue
                if held is not None:
                    done.append(held | {"ends_sha256": digest.hexdigest()})
                held, digest, last = row, hashlib.sha256(piece), key
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema([*rest, ("ends_sha256", pa.string())]))
        if held is not None:
            yield out()

    key = F.unhex(F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")))
    sorted_rows = conversations.select(key.alias("key"), "conv_id", "ids", "sizes")
    sorted_rows = sorted_rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    written = sorted_rows.mapInArrow(pieces, "key binary, conv_id long, n long, piece binary, ids array<long>, sizes array<long>")
    dealt = written.repartition("key").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(joined, "conv_id long, n long, ids array<long>, sizes array<long>, ends_sha256 string")


_EMPTY = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """A ternary search tree over rows of numbers, as parallel lists; node 0 is the root above all first numbers."""

    def __init__(self) -> None:
        self.key: list[int] = [0]
        self.low, self.equal, self.high = [0], [0], [0]
        self.n, self.first = [0], [None]
        self.size = [0]
        self.end: list[str | None] = [None]

    def _child(self, node: int, key: int, size: int) -> int:
        """The node for ``key`` right below ``node``, made if missing."""
        at = self.equal[node]
        links, holder = self.equal, node
        while at:
            if key == self.key[at]:
                return at
            links, holder = (self.low, at) if key < self.key[at] else (self.high, at)
            at = links[holder]
        made = len(self.key)
        links[holder] = made
        for column, value in zip(
            (self.key, self.low, self.equal, self.high, self.n, self.first, self.size, self.end),
            (key, 0, 0, 0, 0, None, size, None),
            strict=True,
        ):
            column.append(value)
        return made

    def insert(self, ids: list[int], sizes: list[int], n: int, first: int, end: str) -> None:
        node = 0
        for depth in range(len(ids) + 1):
            if depth:
                node = self._child(node, ids[depth - 1], sizes[depth - 1])
            self.n[node] += n
            if self.first[node] is None or first < self.first[node]:
                self.first[node] = first
        self.end[node] = end

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth) in order of the sequences, each parent before its children."""
        out = [(0, -1, 0)]
        # what is still to do: a subtree of siblings, or a node whose smaller siblings are done
        todo = [(self.equal[0], 0, 1, False)] if self.equal[0] else []
        while todo:
            node, parent, depth, ready = todo.pop()
            if not ready:
                if self.high[node]:
                    todo.append((self.high[node], parent, depth, False))
                todo.append((node, parent, depth, True))
                if self.low[node]:
                    todo.append((self.low[node], parent, depth, False))
                continue
            out.append((node, parent, depth))
            if self.equal[node]:
                todo.append((self.equal[node], node, depth + 1, False))
        return out


def _medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every stretch before its halves."""
    todo = [(0, n)]
    for begin, end in todo:
        if begin < end:
            middle = (begin + end) // 2
            yield middle
            todo += [(begin, middle), (middle + 1, end)]


_NODE = (
    "shard long, path binary, parent_path binary, edge boolean, depth long, conv_id long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, n_bytes long, ends_sha256 string"
)
_NODE_SCHEMA = pa.schema(
    [
        ("shard", pa.int64()), ("path", pa.binary()), ("parent_path", pa.binary()), ("edge", pa.bool_()), ("depth", pa.int64()),
        ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ends_sha256", pa.string()),
    ]
)


def _paths(ids: list[int]) -> list[bytes]:
    """A name of 128 bits for each prefix, the empty one first."""
    digest = hashlib.blake2b(digest_size=16)
    out = [digest.digest()]
    for i in ids:
        digest.update(i.to_bytes(8, "big"))
        out.append(digest.digest())
    return out


def shard_nodes(shard: int, rows: list[dict]) -> pa.RecordBatch:
    """The nodes of one shard of sorted sequences.

    Nodes on an edge path carry what their inner children add up to; other
    nodes are final, but for a parent on an edge.
    """
    tree = TernaryTree()
    for i in _medians(len(rows)):
        r = rows[i]
        tree.insert(r["ids"], r["sizes"], r["n"], r["conv_id"], r["ends_sha256"])
    order = tree.walk()

    names: dict[int, bytes] = {}
    for r in (rows[0], rows[-1]):
        node = 0
        for depth, name in enumerate(_paths(r["ids"])):
            if depth:
                node = tree._child(node, r["ids"][depth - 1], 0)
            names[node] = name

    children, leaves, saved = ([0] * len(order) for _ in range(3))
    for node, parent, _ in reversed(order):
        edge = node in names
        if not edge:
            leaves[node] = leaves[node] or 1
            saved[node] += (tree.n[node] - 1) * tree.size[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    columns: list[list] = [[] for _ in _NODE_SCHEMA]
    for node, parent, depth in order:
        edge, above = node in names, names.get(parent)
        row = (
            shard, names.get(node), above, edge, depth, tree.first[node],
            tree.first[parent] if parent >= 0 and above is None else None,
            tree.n[node], children[node], leaves[node], saved[node], tree.size[node],
            tree.end[node] if edge else tree.end[node] or _EMPTY,
        )
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)


def _shards(sorted_sequences: DataFrame, settings: TrieSettings) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        turns = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and turns + len(row["ids"]) > settings.shard_turns:
                    yield shard_nodes(number, held)
                    number, held, turns = number + 1, [], 0
                held.append(row)
                turns += len(row["ids"]) + 1
        if held:
            yield shard_nodes(number, held)

    return sorted_sequences.mapInArrow(build, _NODE)


def _risen(edges: DataFrame) -> DataFrame:
    """Edge nodes with their subtrees' sums of ``n_leaves`` and ``saved_tokens``.

    In each round a node adds the sums of the nodes that point to it and then
    points twice as far up, so rounds grow with the logarithm of the depth.
    """
    rows = staged(edges.withColumn("up", F.col("parent_path")), "edge-nodes")
    while not rows.where("up IS NOT NULL").isEmpty():
        pointing = rows.where("up IS NOT NULL")
        added = pointing.groupBy(F.col("up").alias("path")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
        )
        farther = pointing.select("path", "up").join(
            rows.select(F.col("path").alias("up"), F.col("up").alias("up_up")), "up"
        ).select("path", "up_up")
        rows = staged(
            rows.join(added, "path", "left").join(farther, "path", "left").select(
                *[c for c in edges.columns if c not in ("n_leaves", "saved_tokens")],
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
                F.col("up_up").alias("up"),
            ),
            "edge-nodes",
        )
    return rows.drop("up")


RESULT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def prefix_trie(conversations: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """The nodes of the trie of (conv_id, ids, sizes), one row each with the columns RESULT.

    A node is a sequence of first turns and has the smallest conversation that
    starts with it; the root has no turn.  ``sizes`` are the text bytes of the
    turns.  ``n_leaves`` counts childless nodes and ``saved_tokens`` adds up
    bytes that members after the first need not repeat, both over the node's
    subtree with itself.  ``ends_sha256`` is of the ids of the conversations
    that end here, in order.  A conversation without turns ends at the root; no
    conversation, no row.
    """
    found = sequences(conversations, settings)
    distinct = staged(found, "sequences")
    nodes = staged(_shards(distinct.repartitionByRange("ids").sortWithinPartitions("ids"), settings), "shard-nodes")

    parts = nodes.where("edge")
    merged = parts.groupBy("path").agg(
        F.first("parent_path", ignorenulls=True).alias("parent_path"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"),
        F.max("n_bytes").alias("n_bytes"),
        F.coalesce(F.max("ends_sha256"), F.lit(_EMPTY)).alias("ends_sha256"),
    )
    merged = staged(merged, "edges")
    below = merged.where("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("edge_children"))
    n_children = F.col("inner_children") + F.coalesce("edge_children", F.lit(0))
    counted = merged.join(below, "path", "left").select(
        "path", "parent_path", "depth", "conv_id", "n_convs", n_children.alias("n_children"), "ends_sha256",
        F.when(n_children == 0, F.lit(1)).otherwise(F.col("inner_leaves")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes") + F.col("inner_saved")).alias("saved_tokens"),
    )
    edges = _risen(counted)
    above = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    on_edge = edges.join(above, "parent_path", "left").select(*RESULT)
    # a shard's nodes below an edge meet that shard's copy of the edge, so a common root is no hot key
    local = parts.select("shard", F.col("path").alias("parent_path")).join(above, "parent_path")
    under = nodes.where("NOT edge AND parent_path IS NOT NULL").drop("parent_conv_id")
    under = under.join(local, ["shard", "parent_path"]).select(*RESULT)
    inner = nodes.where("NOT edge AND parent_path IS NULL").select(*RESULT)
    return on_edge.unionByName(under).unionByName(inner)


def crc32(text: Column) -> Column:
    """Unsigned CRC-32 of a string's bytes, by Spark's own function."""
    return F.crc32(text.cast("string"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns are those of conversation c - c % 5, h = crc32(c) % 9.

    Only the first eight turns of every fifth conversation are joined, to at
    most nine others each.
    """
    heads = F.pmod(crc32(F.col("conv_id")), F.lit(9)).cast("int")
    base = conversations.where("conv_id % 5 = 0").select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, 8).alias("base_ids"), F.slice("sizes", 1, 8).alias("base_sizes")
    )
    joined = conversations.withColumn("base", F.expr("conv_id - conv_id % 5")).withColumn("h", heads).join(base, "base", "left")

    def spliced(own: str, first: str) -> Column:
        none = F.array().cast("array<long>")
        taken = F.slice(F.coalesce(F.col(first), none), F.lit(1), F.col("h"))
        rest = F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own), F.lit(1)))
        return F.concat(taken, rest).alias(own)

    return staged(joined.select("conv_id", spliced("ids", "base_ids"), spliced("sizes", "base_sizes")), "rebuilt")
