"""Pack documents into windows by non-negative least squares.

Document lengths meet the planner only as histograms, whose size does not
depend on the number of documents.  Shallow combinations of length bins that
fill a window are enumerated, their repeat counts are solved against the
histogram, rounded down, and what is left is packed greedily.  Documents find
their place by their rank within their bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.llm.tokens import encoded_slices
from pageflow.sources.shared import staged


@dataclass(frozen=True)
class PackSettings:
    tokenizer: str
    end_id: int = 2
    window: int = 4096
    #: Bins of the least squares hold lengths of so many tokens; must divide the window.
    bin_tokens: int = 64
    #: Documents in a combination.
    depth: int = 4
    #: Parts in which documents of one bin are counted and ranked.
    parts: int = 256


# ---------------------------------------------------------------------------
# Planning, on histograms
# ---------------------------------------------------------------------------
def combinations(bins: int, depth: int) -> np.ndarray:
    """All sums of up to ``depth`` bins that fill ``bins``: rows of counts for bins 1..bins."""
    out = []
    for shallow in range(depth):
        for head in combinations_with_replacement(range(1, bins), shallow):
            last = bins - sum(head)
            if last >= (head[-1] if head else 1):
                row = np.zeros(bins + 1, np.int32)
                for b in (*head, last):
                    row[b] += 1
                out.append(row)
    return np.array(out)


def non_negative_least_squares(a: np.ndarray, h: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - h|, by active sets; few of its entries are not 0.

    ``rounds`` bounds the steps, by default three for each row of ``a``; an
    earlier stop gives a feasible answer, and greedy packing takes the rest.
    """
    x = np.zeros(a.shape[1])
    active: list[int] = []
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ h).max(initial=0.0)))
    for _ in range(3 * a.shape[0] if rounds is None else rounds):
        gain = a.T @ (h - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        active.append(best)
        while active:
            solved = np.linalg.lstsq(a[:, active], h, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[active] = solved
                break
            now = x[active]
            low = solved <= 0
            step = np.min(now[low] / np.maximum(now[low] - solved[low], 1e-300))
            now = now + step * (solved - now)
            keep = now > 1e-12
            keep[low & (now <= now[low].min() + 1e-12)] = False
            x[:] = 0
            active = [c for c, k in zip(active, keep, strict=True) if k]
            x[active] = now[keep]
    return x


def solved_windows(histogram: np.ndarray, depth: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations as (windows, [(bin, documents in a window)]), never more than the bins hold.

    ``histogram[b]``: documents of bin b; a window holds len(histogram) - 1 bins.
    """
    left = histogram.astype(np.int64).copy()
    combos = combinations(len(histogram) - 1, depth)
    possible = combos[(combos <= left).all(axis=1)]
    if not len(possible):
        return []
    solved = non_negative_least_squares(possible.T.astype(float), left.astype(float))
    out = []
    for i in np.argsort(-solved, kind="stable"):
        used = np.flatnonzero(possible[i])
        repeats = int(min(np.floor(solved[i] + 1e-6), (left[used] // possible[i][used]).min()))
        if repeats > 0:
            left[used] -= repeats * possible[i][used]
            out.append((repeats, [(int(b), int(possible[i][b])) for b in used]))
    return out


def greedy_windows(histogram: np.ndarray, window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Windows filled longest first, as ``solved_windows`` gives them; takes all documents."""
    left = histogram.astype(np.int64).copy()
    out = []
    while (lengths := np.flatnonzero(left)).size:
        room, members = window, []
        at = lengths.size - 1
        while at >= 0 and room > 0:
            length = int(lengths[at])
            if length <= room:
                fit = int(min(left[length], room // length))
                members.append((length, fit))
                room -= fit * length
            at = min(at - 1, int(np.searchsorted(lengths, room, "right")) - 1)
        repeats = min(int(left[length]) // fit for length, fit in members)
        for length, fit in members:
            left[length] -= repeats * fit
        out.append((repeats, members))
    return out


class Places:
    """Where the document of a given rank in its bin goes: sequence and order in it."""

    def __init__(self, windows: list[tuple[int, list[tuple[int, int]]]], bins: int, first: int = 0) -> None:
        taken = np.zeros(bins, np.int64)
        rows = []
        sequence = first
        for repeats, members in windows:
            slot = 0
            for b, count in members:
                rows.append((b, taken[b], sequence, slot, count))
                taken[b] += repeats * count
                slot += count
            sequence += repeats
        rows.sort()
        self.bin, self.rank, self.sequence, self.slot, self.count = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.taken = taken
        self.next_sequence = sequence

    def of(self, bins: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot, -1 for ranks that no window takes."""
        sequence = np.full(len(bins), -1, np.int64)
        slot = np.full(len(bins), -1, np.int64)
        inside = np.flatnonzero(ranks < self.taken[bins])
        for b in np.unique(bins[inside]):
            rows = inside[bins[inside] == b]
            lo, hi = np.searchsorted(self.bin, [b, b + 1])
            at = lo + np.searchsorted(self.rank[lo:hi], ranks[rows], "right") - 1
            turn = ranks[rows] - self.rank[at]
            sequence[rows] = self.sequence[at] + turn // self.count[at]
            slot[rows] = self.slot[at] + turn % self.count[at]
        return sequence, slot


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
_MEASURED = "doc_id long, doc_tokens long, start long, length long, bin long, crc long, cut_crc long, rest_crc long"


def measured_pieces(docs: DataFrame, settings: PackSettings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Full windows and remainders of all documents, with checksums for every way they may be cut.

    A remainder may be cut once, at the last whole bin: ``crc`` is of the
    whole piece, ``cut_crc`` and ``rest_crc`` of its two parts.  ``bin`` is the
    number of whole bins.
    """
    window, unit = settings.window, settings.bin_tokens

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, ends in encoded_slices(batches, "text", settings.tokenizer, settings.end_id):
            ids = ids.astype("<u4")
            starts = np.concatenate([[0], ends[:-1]])
            sizes = ends - starts
            pieces = -(-sizes // window)
            doc = np.repeat(np.arange(len(part)), pieces)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = no * window
            length = np.minimum(window, sizes[doc] - begin)
            absolute = starts[doc] + begin
            cut = length // unit * unit
            crc = np.zeros((3, len(doc)), np.int64)
            for i, (a, c, n) in enumerate(zip(absolute.tolist(), cut.tolist(), length.tolist(), strict=True)):
                crc[1, i] = first = zlib.crc32(ids[a : a + c])
                crc[0, i] = zlib.crc32(ids[a + c : a + n], first)
                crc[2, i] = zlib.crc32(ids[a + c : a + n])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), *map(pa.array, (sizes[doc], begin, length, length // unit, *crc))],
                names=[c.split()[0] for c in _MEASURED.split(", ")],
            )

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(measure, _MEASURED)


def _ranked(items: DataFrame, bin_: Column, parts: int) -> DataFrame:
    """Add ``rank``, 0 and up within the bin: counted in parts of the bin first."""
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts))
    items = items.withColumn("__bin", bin_).withColumn("__part", part)
    sizes = items.groupBy("__bin", "__part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__bin").orderBy("__part")
    ahead = sizes.select("__bin", "__part", (F.sum("n").over(earlier) - F.col("n")).alias("__ahead"))
    inside = Window.partitionBy("__bin", "__part").orderBy("doc_id", "start", "length", "crc")
    return (
        items.join(ahead, ["__bin", "__part"])
        .withColumn("rank", F.row_number().over(inside) - 1 + F.col("__ahead"))
        .drop("__part", "__ahead")
    )


def _histogram(items: DataFrame, bin_: Column, bins: int) -> np.ndarray:
    """Documents of each bin; at most ``bins`` rows reach the driver."""
    out = np.zeros(bins, np.int64)
    for b, n in items.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        out[b] = n
    return out


def _placed(items: DataFrame, places: Places) -> DataFrame:
    """Add ``sequence_id`` and ``slot`` for the ranked items."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["sequence_id"], frame["slot"] = places.of(frame["__bin"].to_numpy(), frame["rank"].to_numpy())
            yield frame

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields]
    return items.mapInPandas(place, ", ".join([*fields, "sequence_id long", "slot long"]))


def pack(docs: DataFrame, settings: PackSettings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    Sequences hold at most ``window`` tokens.  Combined windows are filled to
    the last token: their documents are cut at a whole bin, and the few tokens
    behind the cut join the documents that no combination takes.  A null or
    empty text is its end id alone; repeated rows are packed each; a null key is
    passed on; an empty table gives no row.
    """
    window, unit = settings.window, settings.bin_tokens
    bins = window // unit + 1
    in_bin = F.col("bin")
    pieces = staged(measured_pieces(docs, settings, key, text), "pieces")
    combined = Places(solved_windows(_histogram(pieces.where("bin > 0"), in_bin, bins), settings.depth), bins)
    first = staged(_placed(_ranked(pieces, in_bin, settings.parts), combined), "placed")
    whole = first.where("slot >= 0").withColumn("length", F.col("bin") * unit).withColumn("crc", F.col("cut_crc"))
    rest = first.where(f"slot >= 0 AND length > bin * {unit}").select(
        "doc_id",
        "doc_tokens",
        (F.col("start") + F.col("bin") * unit).alias("start"),
        (F.col("length") - F.col("bin") * unit).alias("length"),
        F.col("rest_crc").alias("crc"),
    )
    columns = ["doc_id", "doc_tokens", "start", "length", "crc"]
    others = first.where("slot < 0").select(*columns).unionByName(rest)
    by_length = F.col("length")
    greedy = Places(
        greedy_windows(_histogram(others, by_length, window + 1), window), window + 1, combined.next_sequence
    )
    placed = [*columns, "sequence_id", "slot"]
    everything = whole.select(*placed).unionByName(
        _placed(_ranked(others, by_length, settings.parts), greedy).select(*placed)
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return everything.select(
        "doc_id",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )
