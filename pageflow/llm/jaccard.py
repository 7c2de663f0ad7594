"""Documents whose n-gram sets overlap: size-banded tiles, bitmap bounds, exact intersection.

Sets of one size band are cut into more tiles than two sets of the band can
differ in elements if they are similar enough; so similar sets agree on whole
tiles, and nothing is lost.  Tiles with the same members are one list.  Members of
a list are compared with one leader first, the one that shares most.  Those that
still are in different components are then compared part by part, so no pair
within a component is looked at and no link is lost.  The number of bits in which
two hashed bitmaps differ is a lower bound of the sets' difference, hence an upper
bound of their overlap, and dismisses most pairs; intersecting the sorted hashes
decides the rest.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.blocks import mask_of, opened, shared_masks, text_blocks, with_masks
from pageflow.llm.components import components
from pageflow.llm.textbytes import Hashes, mixed
from pageflow.sources.shared import broadcast_if_small, fresh_path, remove, staged

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of marks compared at once.
_COMPARE_BYTES = 16 << 20


@dataclass(frozen=True)
class JaccardSettings:
    words: int = 3
    #: Documents link when 100 * intersection >= percent * union.
    percent: int = 90
    #: Largest size of a band over its smallest.
    band_ratio: float = 1.4
    bitmap_bits: int = 4096
    #: Bits of the smallest and largest bitmap that goes along with a list's members.
    mark_bits: tuple[int, int] = (256, 1 << 15)
    #: Members of a list compared at once.
    list_part: int = 512
    #: Rows (tile, node) looked at together; a tile with more members keeps its own list.
    list_rows: int = 1 << 20
    #: Lower-case A-Z before anything else.
    fold_ascii: bool = True


def allowed_difference(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Most elements by which two linked sets with this sum of sizes may differ."""
    return sizes * (100 - percent) // (100 + percent)


def bands(largest: int, settings: JaccardSettings) -> np.ndarray:
    """Smallest size of each band, up to one beyond ``largest``."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * settings.band_ratio) + 1))
    return np.array(starts, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, settings: JaccardSettings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a block, ascending within each, and the size of each set.

    A text with fewer words than a shingle has its whole word sequence as one;
    a text without words has the empty set.
    """
    n = len(offsets) - 1
    if settings.fold_ascii:
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | first[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | first[1:])) + 1
    words = Hashes(data).of(starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(owner, minlength=n)
    width = settings.words
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams = grams * _STEP + words[k : k + len(grams)]
    whole = owner[: len(grams)] == owner[width - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, of = [mixed(grams[whole])], [owner[: len(grams)][whole]]
    word_begin = np.concatenate([[0], np.cumsum(counts)])
    for size in range(1, width):
        texts = np.flatnonzero(counts == size)
        sequence = np.full(len(texts), size, np.uint64)
        for k in range(size):
            sequence = mixed(sequence) * _STEP + words[word_begin[texts] + k]
        hashes.append(mixed(sequence))
        of.append(texts)
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.bincount(of[new], minlength=n)


def set_nodes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 63-bit name for each set, equal for equal sets; -1 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes))])
    ends = np.cumsum(sizes)
    total = sums[ends] - sums[ends - sizes]
    names = (mixed(total ^ mixed(sizes.astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
    return np.where(sizes > 0, names, -1)


def set_tiles(
    hashes: np.ndarray, sizes: np.ndarray, settings: JaccardSettings
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tiles of all sets, the set and the cut each belongs to, and how many tiles each cut must share.

    A set is cut for its own band, and for the next if a set there can link
    with it.  Tiles are ranges of the hash values, so they are contiguous in the
    sorted hashes and a running sum gives their content.  Bands in which linked
    sets are equal need no tiles.  A cut that agrees with other sets on fewer
    tiles than it must has no link in its band.
    """
    starts = bands(int(sizes.max(initial=1)), settings)
    own = np.searchsorted(starts, sizes, "right") - 1
    begin = np.cumsum(sizes) - sizes
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes))])
    keys, sets, cuts, needs = [], [], [], []
    for step in (0, 1):
        band = own + step
        inside = (sizes > 0) & (band + 1 <= len(starts))
        top = np.zeros(len(sizes), np.int64)
        edge = np.append(starts, max(starts[-1] + 1, int(starts[-1] * settings.band_ratio) + 1))
        top[inside] = edge[band[inside] + 1] - 1
        differ = allowed_difference(2 * top, settings.percent)
        slack = differ // 10 + 1
        parts = differ + 1 + slack
        reaches = 100 * sizes >= settings.percent * edge[np.minimum(band, len(edge) - 1)] if step else inside
        chosen = np.flatnonzero(inside & reaches & (differ > 0))
        if not len(chosen):
            continue
        cells = parts[chosen]
        cell_begin = np.cumsum(cells) - cells
        members = np.repeat(np.arange(len(chosen)), sizes[chosen])
        at = np.arange(len(members)) - np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen])
        values = hashes[begin[chosen][members] + at]
        part = ((values >> np.uint64(32)) * cells[members].astype(np.uint64)) >> np.uint64(32)
        filled = np.bincount(cell_begin[members] + part.astype(np.int64), minlength=int(cells.sum()))
        owner = np.repeat(np.arange(len(chosen)), cells)
        before = np.cumsum(filled) - filled
        first = before - before[cell_begin][owner] + begin[chosen][owner]
        content = sums[first + filled] - sums[first]
        # sets agree on more tiles than ``slack``, so empty ones matter only to sets with more of them
        empty = np.bincount(owner[filled == 0], minlength=len(chosen))
        sent = (filled > 0) | (empty > slack[chosen])[owner]
        # linked sets agree on more tiles than ``slack``, of which the other may leave out the empty ones
        needs.append(np.where(empty > slack[chosen], 1, slack[chosen] + 1 - empty))
        cuts.append(owner[sent] + sum(map(len, needs[:-1])))
        place = (band[chosen][owner] << 32) + np.arange(len(owner)) - cell_begin[owner]
        keys.append(mixed(content ^ mixed(place.astype(np.uint64) + np.uint64(1)))[sent])
        sets.append(chosen[owner][sent])
    if not keys:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in (keys, sets, cuts, needs))


def bitmaps(hashes: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """One row of packed bits for each set, with the bit of every member set."""
    out = np.zeros((len(sizes), bits), bool)
    out[np.repeat(np.arange(len(sizes)), sizes), (mixed(hashes) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1)


def parity_marks(hashes: np.ndarray, sizes: np.ndarray, least: int, most: int) -> list[bytes]:
    """For each set the parity of its members at each bit, with about a bit for each member.

    Two sets differ in at least as many members as their marks in bits; marks of
    twice the width become those of half the width by xor of the halves.
    """
    width = np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), least, most)
    begin = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = begin[owner] + (mixed(hashes) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(bool))
    return [bits[b // 8 : (b + w) // 8].tobytes() for b, w in zip(begin, width, strict=True)]


def folded(marks: list[bytes], n_bytes: int) -> np.ndarray:
    """Marks of this width or more as rows of this width."""
    out = np.empty((len(marks), n_bytes), np.uint8)
    lengths = np.array([len(m) for m in marks], np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        wide = np.frombuffer(b"".join(marks[r] for r in rows), np.uint8).reshape(len(rows), length // n_bytes, n_bytes)
        out[rows] = np.bitwise_xor.reduce(wide, axis=1)
    return out


def _distinct_sets(data: np.ndarray, offsets: np.ndarray, settings: JaccardSettings):
    """The block's sets, each kept once: hashes, sizes, nodes; and the node of each text."""
    hashes, sizes = shingle_sets(data, offsets, settings)
    nodes = set_nodes(hashes, sizes)
    _, kept = np.unique(nodes, return_index=True)
    keep = np.zeros(len(sizes), bool)
    keep[kept] = True
    return hashes[np.repeat(keep, sizes)], sizes[keep], nodes[keep], nodes, sizes


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _listed(tile: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """The distinct lists of whole tiles with two members or more; rows in order of tile and node."""
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(tile)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(node.view(np.uint64)))])
    names = mixed((sums[starts + sizes] - sums[starts]) ^ mixed(sizes.astype(np.uint64))).view(np.int64)
    many = sizes > 1
    starts, sizes, names = starts[many], sizes[many], names[many]
    _, first, tiles = np.unique(np.stack([names, node[starts]]), axis=1, return_index=True, return_counts=True)
    starts, sizes, names = starts[first], sizes[first], names[first]
    rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    columns = [np.repeat(names, sizes), np.repeat(node[starts], sizes), node[rows], np.repeat(tiles, sizes)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["list", "low", "node", "tiles"])


def member_lists(tiles: DataFrame, settings: JaccardSettings, folder: str) -> DataFrame:
    """Rows (list, low, node, tiles, rows): the distinct lists of nodes that share a tile.

    ``list`` and ``low`` (its smallest node) name a list, ``tiles`` counts the tiles with it,
    ``rows`` its nodes.  Rows (tile, node) may repeat.  Tiles are read in order, so
    nothing but a window of rows is held; a tile beyond the window is a list of its own.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        own = None  # the tile that is beyond the window
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                if sum(len(t) for t, _ in held) < settings.list_rows:
                    continue
            if not held:
                continue
            tile, node = (np.concatenate(c) for c in zip(*held, strict=True))
            new = np.ones(len(tile), bool)
            new[1:] = (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])
            tile, node = tile[new], node[new]
            cut = len(tile) if batch is None else int(np.searchsorted(tile, tile[-1]))
            if own is not None or cut == 0:
                own = tile[0] if own is None else own
                rest = int(np.searchsorted(tile, own, "right"))
                columns = [tile[:rest], np.zeros(rest, np.int64), node[:rest], np.ones(rest, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "low", "node", "tiles"])
                own = own if rest == len(tile) else None
                tile, node, cut = tile[rest:], node[rest:], max(0, cut - rest)
            yield _listed(tile[:cut], node[:cut])
            held = [(tile[cut:], node[cut:])] if cut < len(tile) else []

    # one exchange deals the tiles; what follows it is narrow and has each list once
    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "node")
    found = dealt.mapInArrow(lists, "list long, low long, node long, tiles long")
    found = staged(found.groupBy("list", "low", "node").agg(F.sum("tiles").alias("tiles")), "lists", folder)
    sizes = found.groupBy("list", "low").agg(F.count(F.lit(1)).alias("rows"))
    return staged(found.join(sizes, ["list", "low"]), "member-lists", folder)


def _able_to_link(lists: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """The lists without members that share too few tiles with others to link with any; ``need`` of ``sets`` is the least."""
    shared = lists.where("rows > 1").groupBy("node").agg(F.sum("tiles").alias("shared"))
    able = shared.join(sets.select("node", "need"), "node").where("shared >= need").select("node")
    left = staged(lists.drop("rows").join(able, "node", "left_semi"), "able-lists", folder)
    sizes = left.groupBy("list", "low").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return staged(left.join(sizes, ["list", "low"]), "able-member-lists", folder)


def _linked_pairs(
    pairs: DataFrame, sets: DataFrame, hashes: DataFrame, settings: JaccardSettings, folder: str
) -> DataFrame:
    """The pairs (a, b) of nodes that link: bitmaps first, then the sorted hashes.

    ``sets``: node, n, bits, a row for each node; ``hashes``: node, hashes, a row or more.
    """
    percent = settings.percent

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in (4, 5)]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            yield batch.filter(pa.array(apart <= allowed_difference(total, percent))).select([0, 1])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.filter(pa.array(keep)).select([0, 1])

    def side(node: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(node), *[F.col(c).alias(f"{c}_{node}") for c in columns])

    near = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    near = near.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = staged(near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bounded, "a long, b long"), "near", folder)
    # the hashes of a set may stand in several blocks; one copy of those that are asked for moves on
    asked = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    asked = broadcast_if_small(staged(asked, "asked", folder))
    held = staged(hashes.join(asked, "node", "left_semi").dropDuplicates(["node"]), "hashes", folder)
    full = near.join(held.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(
        held.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b"
    )
    return full.select("a", "b", "hashes_a", "hashes_b").mapInArrow(decided, "a long, b long")


def jaccard_components(
    docs: DataFrame, settings: JaccardSettings = JaccardSettings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_shingles, node, component_id, digest), one for each row of ``docs``.

    ``digest`` is the MD5 of the text's bytes; a null text is empty.
    ``component_id`` is the smallest doc_id reachable by links, itself
    included.  Documents with equal sets are one ``node`` and always linked; empty
    sets (no word, null) link with nothing.  A null key is ignored for the
    smallest id and keeps its row.  Extra columns are not read; an empty table
    gives no row.
    """

    def tile_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, sizes, *_ = _distinct_sets(data, offsets, settings)
        keys, counts = np.unique(set_tiles(hashes, sizes, settings)[0], return_counts=True)
        return keys, counts > 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids, data, offsets in opened(batch):
                hashes, sizes, nodes, of_text, text_sizes = _distinct_sets(data, offsets, settings)
                keys, owner, cut, need = set_tiles(hashes, sizes, settings)
                shared = np.zeros(0, bool)
                if len(keys):
                    shared = mask_of(batch.column("masks")[i])[np.searchsorted(np.unique(keys), keys)]
                    shared &= (np.bincount(cut[shared], minlength=len(need)) >= need)[cut]
                keys, owner, cut = keys[shared], owner[shared], cut[shared]
                least = np.full(len(sizes), len(hashes))
                np.minimum.at(least, owner, need[cut])
                ends = np.cumsum(sizes)
                wanted = np.unique(owner)
                inside = np.repeat(np.isin(np.arange(len(sizes)), wanted), sizes)
                marks = bitmaps(hashes[inside], sizes[wanted], settings.bitmap_bits)
                parities = parity_marks(hashes[inside], sizes[wanted], *settings.mark_bits)
                n, w, t = len(of_text), len(wanted), len(keys)
                blobs = [hashes[ends[s] - sizes[s] : ends[s]].tobytes() for s in wanted]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([0, 1, 2], [n, w, t]).astype(np.int32)),
                        pa.concat_arrays([ids.cast(pa.int64()), pa.array(least[wanted]), pa.array(keys.view(np.int64))]),
                        pa.array(np.concatenate([of_text, nodes[wanted], nodes[owner]])),
                        pa.array(np.concatenate([text_sizes, sizes[wanted], np.zeros(t, np.int64)])),
                        pa.array([None] * n + [m.tobytes() for m in marks] + [None] * t, pa.binary()),
                        pa.array([None] * n + parities + [None] * t, pa.binary()),
                        pa.array([None] * n + blobs + [None] * t, pa.binary()),
                        pa.array(_digests(data, offsets) + [None] * (w + t), pa.binary()),
                    ],
                    names=["kind", "value", "node", "n", "bits", "marks", "hashes", "digest"],
                )

    # Tiles of a set of n: its allowed difference and more, in one band or two; words have about six bytes.
    keys_per_byte = 1.6 * allowed_difference(np.int64(2_000), settings.percent) / 1_000 / 6
    spark = docs.sparkSession
    folder, block_folder = fresh_path(spark, "jaccard"), fresh_path(spark, "jaccard")
    blocks = text_blocks(docs, key, text, block_folder)
    masked = with_masks(blocks, shared_masks(blocks, tile_keys, keys_per_byte))
    layout = "kind int, value long, node long, n long, bits binary, marks binary, hashes binary, digest binary"
    found = staged(masked.mapInArrow(rows, layout), "sets", folder)
    remove(spark, block_folder)
    texts = found.where("kind = 0").select(F.col("value").alias("doc_id"), F.col("n").alias("n_shingles"), "node", "digest")
    texts = staged(texts, "texts")
    sets = found.where("kind = 1").select("node", "n", F.col("value").alias("need"), "bits", "marks").dropDuplicates(["node"])
    sets = staged(sets, "node-sets", folder)
    hashes = found.where("kind = 1").select("node", "hashes")

    lists = member_lists(found.where("kind = 2").select(F.col("value").alias("tile"), "node"), settings, folder)
    lists = _able_to_link(lists, sets, folder)
    weights = lists.groupBy("node").agg(F.sum(F.col("rows") * F.col("tiles")).alias("weight"))
    leaders = lists.join(weights, "node").groupBy("list", "low").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    first = lists.join(leaders, ["list", "low"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = staged(first, "first-pairs", folder)
    links = staged(_linked_pairs(first, sets, hashes, settings, folder), "links", folder)

    open_ = _open_pairs(lists, components(links), first, sets, settings, folder)
    more = _linked_pairs(open_, sets, hashes, settings, folder)
    roots = components(staged(links.unionByName(more), "links", folder))

    nodes = texts.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = staged(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    remove(spark, folder)
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(smallest, "root").select("node", "component_id")
    return texts.join(named, "node", "left").select(
        "doc_id",
        "n_shingles",
        "node",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "digest",
    )


def _open_pairs(
    lists: DataFrame, roots: DataFrame, tested: DataFrame, sets: DataFrame, settings: JaccardSettings, folder: str
) -> DataFrame:
    """Pairs (a, b) of one list but different components that sizes and bitmaps do not rule out.

    Members of a list are compared within a task, those of a large one in parts
    of bounded size; pairs that were ruled out or tested before never leave it.
    Lists stream through their task row by row, as lists with marks in one cell
    would fill Arrow batches of tens of megabytes.  In a list of two the leader
    has met the other.
    """

    def near_pairs(x: _Members, y: _Members) -> np.ndarray:
        low, high = np.minimum(x.n[:, None], y.n[None]), np.maximum(x.n[:, None], y.n[None])
        open_ = (x.root[:, None] != y.root[None]) & (100 * low >= settings.percent * high)
        if y is x:
            open_ = np.triu(open_, 1)
        p, q = np.nonzero(open_)
        width = min(len(m) for m in x.marks + y.marks)
        of_x, of_y = folded(x.marks, width), folded(y.marks, width)
        step = max(1, _COMPARE_BYTES // width)
        out = [np.zeros((2, 0), np.int64)]
        for k in range(0, len(p), step):
            a, b = p[k : k + step], q[k : k + step]
            apart = np.bitwise_count(of_x[a] ^ of_y[b]).sum(axis=1, dtype=np.int64)
            near = apart <= allowed_difference(x.n[a] + y.n[b], settings.percent)
            out.append(np.stack([x.node[a[near]], y.node[b[near]]]))
        return np.concatenate(out, axis=1)

    def paired(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (list, low, node, root, n, marks) in order of lists: a list is held, and no more."""
        held: list[pa.RecordBatch] = []
        of = None
        for batch in batches:
            found: list[np.ndarray] = []
            names = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
            for start, end in itertools.pairwise([0, *cuts.tolist(), len(batch)] if len(batch) else []):
                if held and of != tuple(names[:, start].tolist()):
                    own = _Members(held)
                    found.append(near_pairs(own, own))
                    held = []
                of = tuple(names[:, start].tolist())
                held.append(batch.slice(start, end - start))
            yield paired(found)
        if held:
            own = _Members(held)
            yield paired([near_pairs(own, own)])

    def compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x, y = ([pa.RecordBatch.from_struct_array(batch.column(c)[i].values)] if batch.column(c)[i].is_valid else [] for c in (0, 1))
                x = _Members(x)
                yield paired([near_pairs(x, _Members(y) if y else x)])

    name = ["list", "low"]
    rooted = lists.where("rows > 2").join(roots, "node", "left")
    rooted = staged(rooted.select(*name, "rows", "node", F.coalesce("root", "node").alias("root")), "rooted-lists", folder)
    ends = rooted.groupBy(*name).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select(*name)
    members = rooted.join(ends, name, "left_semi").join(sets.select("node", "n", "marks"), "node")
    columns = ["node", "root", "n", "marks"]
    small = members.where(F.col("rows") <= settings.list_part).select(*name, *columns)
    small = small.repartition(*name).sortWithinPartitions(*name).mapInArrow(compare, "a long, b long")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / settings.list_part))
    large = members.where(F.col("rows") > settings.list_part).groupBy(*name, part.alias("part"))
    large = staged(large.agg(F.collect_list(F.struct(*columns)).alias("x")), "list-parts", folder)
    other = large.select(*name, F.col("part").alias("with"), F.col("x").alias("y"))
    # a part that meets itself goes to its task once
    met = large.join(other, name).where("part <= with").select("x", F.when(F.col("part") < F.col("with"), F.col("y")).alias("y"))
    pairs = small.unionByName(met.mapInArrow(compare_parts, "a long, b long")).distinct()
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return staged(pairs.join(known, ["a", "b"], "left_anti"), "open-pairs", folder)


class _Members:
    """Columns of a list or of a part of one."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(rows)
        self.node, self.root, self.n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
        self.marks = table.column("marks").to_pylist()


def one_of_each(
    docs: DataFrame, settings: JaccardSettings = JaccardSettings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without those that another of their component stands for, all columns.

    The row with the smallest key of each component stays; of rows equal in key
    and text one stays.  Documents without words all stay, and so do rows
    with a null key unless their component has a row with a key.
    """
    found = jaccard_components(docs, settings, key, text)
    row = [F.col("doc_id").alias("__id"), F.col("digest").alias("__md5")]
    gone = found.where("n_shingles > 0 AND (doc_id <> component_id OR doc_id IS NULL AND component_id IS NOT NULL)")
    gone = staged(gone.select(*row).distinct(), "gone")
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    left = docs.withColumn("__digest", F.unhex(F.md5(content)))
    same = F.col(key).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__md5"))
    left = left.join(broadcast_if_small(gone), same, "left_anti")
    twice = found.where("n_shingles > 0").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    twice = staged(twice.select(*row), "twice")
    if twice.isEmpty():
        return left.drop("__digest")
    twice = broadcast_if_small(twice)
    once = left.join(twice, same, "left_semi").dropDuplicates([key, "__digest"])
    return left.join(twice, same, "left_anti").unionByName(once).drop("__digest")
