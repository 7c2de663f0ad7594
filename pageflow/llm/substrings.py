"""Remove byte strings that also stand in an earlier document.

Equal texts are settled by digest.  Every window of ``size`` bytes has an
anchor, its 24-byte string with the least hash, so equal windows have equal
anchors at equal offsets.  Only anchors that another document has too
are looked at: their left and right contexts are ordered by suffix arrays, and
common prefixes of neighbours in that order say which windows are equal.  The smallest
document of each set of equal windows keeps them.

An anchor that very many documents have, with ever different neighbours, would be
the work of one task.  Buckets beyond ``hot_rows`` are therefore parted by whole
windows: only equal windows meet, and a task sends each window once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.blocks import mask_of, opened, pack, shared_masks, text_blocks, unpack, with_masks
from pageflow.llm.suffixes import suffix_array
from pageflow.llm.textbytes import mixed
from pageflow.sources.shared import staged

#: Bytes of an anchor.
GRAM = 24
#: Stands for a null document id: not smaller than any other.
NO_ID = 2**63 - 1
#: Fragments that one task compares at once, about.
BUCKET_ROWS = 1 << 16
#: Fragments of hot buckets that a task takes apart at once.
_PARTED_ROWS = 1 << 15
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class SubstringSettings:
    #: Bytes of a repeated string; at least the anchor's and at most 32 more.
    size: int = 50
    #: Fragments beyond which a bucket is parted by windows.
    hot_rows: int = 4 * BUCKET_ROWS

    @property
    def spread(self) -> int:
        """Bytes of a window besides its anchor, which is also the largest offset of the anchor."""
        return self.size - GRAM


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling the length."""
    value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[data]
    out, length, done = None, 1, 0
    while length <= GRAM:
        factor = np.uint64(pow(_BASE, length, 2**64))
        if GRAM & length:
            out = value.copy() if out is None else out[: len(value) - done] * factor + value[done:]
            done += length
        if len(value) <= length:
            break
        value = value[:-length] * factor + value[length:]
        length *= 2
    n = len(data) - GRAM + 1
    return mixed(out[:n]) if n > 0 else np.zeros(0, np.uint64)


def anchors(data: np.ndarray, offsets: np.ndarray, settings: SubstringSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor position, first window, last window, gram hash) of every anchor of a block.

    The leftmost least hash of a window is its anchor; the windows of an anchor
    are consecutive.
    """
    hashes = gram_hashes(data)
    n = len(data) - settings.size + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    least, at = hashes, np.arange(len(hashes), dtype=np.int32)
    reach, wanted = 1, settings.spread + 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
        reach += step
    ends = offsets[1:]
    inside = np.zeros(len(data) + 1, np.int32)
    lengths = np.diff(offsets)
    long = lengths >= settings.size
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, ends[long] - settings.size + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    if not len(windows):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    position = at[windows].astype(np.int64)
    cut = np.flatnonzero((np.diff(position) != 0) | (np.diff(windows) != 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(windows)]]) - 1
    position = position[first]
    text = np.searchsorted(offsets, windows[first], "right") - 1
    return text, position, windows[first], windows[last], hashes[position]


def contexts(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, position: np.ndarray, spread: int) -> np.ndarray:
    """For each anchor the bytes to its left, nearest first, then those to its right; 0 beyond the text."""
    out = np.zeros((len(position), 2 * spread), np.uint8)
    if not len(position):
        return out
    begin, end = offsets[text], offsets[text + 1]
    for k in range(spread):
        left, right = position - 1 - k, position + GRAM + k
        out[:, k] = np.where(left >= begin, data[np.maximum(left, 0)], 0)
        out[:, spread + k] = np.where(right < end, data[np.minimum(right, len(data) - 1)], 0)
    return out


def _context_order(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (group, context), by a suffix array; and the bytes each has in common with the row before.

    Rows of another group have -1 in common.  The text is, for each row, its
    group and its context in symbols of 7 bytes; only suffixes that begin with
    a group are rows.
    """
    m, spread = side.shape
    words = -(-spread // 7)
    padded = np.zeros((m, words * 7), np.uint8)
    padded[:, :spread] = side
    digits = padded.reshape(m, words, 7).astype(np.int64)
    symbols = np.zeros((m, words), np.int64)
    for k in range(7):
        symbols = (symbols << 8) | digits[:, :, k]
    known, ranks = np.unique(symbols, return_inverse=True)
    text = np.concatenate([group[:, None] + len(known), ranks.reshape(m, words)], axis=1).ravel()
    suffixes = suffix_array(text)
    order = suffixes[suffixes % (words + 1) == 0] // (words + 1)
    equal = side[order[1:]] == side[order[:-1]]
    common = np.where(equal.all(axis=1), spread, equal.argmin(axis=1))
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def _kinds(gram: np.ndarray, low: np.ndarray, high: np.ndarray, context: np.ndarray) -> np.ndarray:
    """A hash of each fragment, equal for equal fragments."""
    padded = np.zeros((len(gram), -(-context.shape[1] // 8) * 8), np.uint8)
    padded[:, : context.shape[1]] = context
    kind = mixed(gram ^ mixed((low * 64 + high).astype(np.uint64)))
    for word in padded.view(np.uint64).T:
        kind = mixed(kind * np.uint64(_BASE) + word)
    return kind


def _beaten(gram: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Which fragments have an equal one of a smaller document."""
    _, of = np.unique(_kinds(gram, low, high, context), return_inverse=True)
    least = np.full(of.max(initial=-1) + 1, NO_ID, np.int64)
    np.minimum.at(least, of, doc)
    return doc > least[of]


def _all_windows(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (np.int64(2) << high) - (np.int64(1) << low)


def window_owners(gram: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, context: np.ndarray) -> np.ndarray:
    """For each fragment a bit mask: bit k set if its window k bytes left of the anchor has an earlier document.

    ``low`` and ``high``: the fragment's windows begin low..high bytes left of
    its anchor.
    """
    spread = context.shape[1] // 2
    _, row, of = np.unique(_kinds(gram, low, high, context), return_index=True, return_inverse=True)
    first = np.full(len(row), NO_ID, np.int64)
    np.minimum.at(first, of, doc)
    names, group = np.unique(gram[row], return_inverse=True)
    size = np.bincount(group)
    mask = np.zeros(len(gram), np.int64)

    alone = size[group] == 1
    every = _all_windows(low, high)
    mask[alone[of]] = np.where(doc > first[of], every, 0)[alone[of]]

    several = np.flatnonzero(~alone)
    if not len(several):
        return mask
    _, own = np.unique(group[several], return_inverse=True)
    side = context[row[several]]
    place, common = [], []
    for part in (side[:, :spread], side[:, spread:]):
        order, shared = _context_order(own, part)
        place.append(np.argsort(order))
        common.append(shared)
    number = np.full(len(row), -1, np.int64)
    number[several] = np.arange(len(several))
    theirs = np.flatnonzero(number[of] >= 0)
    member = number[of[theirs]]
    for k in range(spread + 1):
        takes = (low[row[several]] <= k) & (k <= high[row[several]])
        if not takes.any():
            continue
        left = np.cumsum(common[0] < k)[place[0]]
        right = np.cumsum(common[1] < spread - k)[place[1]]
        _, same = np.unique(left[takes] * (len(several) + 1) + right[takes], return_inverse=True)
        least = np.full(same.max() + 1, NO_ID, np.int64)
        np.minimum.at(least, same, first[several][takes])
        owner = np.full(len(several), NO_ID, np.int64)
        owner[takes] = least[same]
        mask[theirs] |= (doc[theirs] > owner[member]).astype(np.int64) << k
    return mask


def _removed(n: int, position: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` bytes the masked windows cover."""
    cover = np.zeros(n + 1, np.int32)
    for k in range(int(mask.max(initial=0)).bit_length()):
        start = position[(mask >> k) & 1 == 1] - k
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
    return np.cumsum(cover[:-1]) > 0


_FIELDS = (("gram", np.uint64), ("text_no", np.int64), ("doc_id", np.int64), ("position", np.int32), ("low", np.uint8), ("high", np.uint8))
_ROWS = "kind int, name long, doc_id long, n long, data binary"


def _packed(fields: dict[str, np.ndarray], context: np.ndarray) -> bytes:
    """Fragments as one compressed string: the fields column by column, then the contexts."""
    columns = [fields[name].astype(kind).tobytes() for name, kind in _FIELDS]
    return pack(np.frombuffer(b"".join([*columns, context.tobytes()]), np.uint8))


def _unpacked(data: pa.Buffer, n: int, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    each = sum(np.dtype(kind).itemsize for _, kind in _FIELDS) + width
    raw = unpack(data, n * each)
    out, at = {}, 0
    for name, kind in _FIELDS:
        size = n * np.dtype(kind).itemsize
        out[name] = np.frombuffer(raw[at : at + size].tobytes(), kind)
        at += size
    return out, raw[at:].reshape(n, width)


def _windows(position: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Position of an anchor and mask of its windows as one number."""
    return (position.astype(np.int64) << 28) | mask


def _fragments(masked: DataFrame, buckets: int, settings: SubstringSettings) -> DataFrame:
    """Rows (kind, name, doc_id, n, data) of three kinds.

    0: texts with shared anchors, under their number, with their size; 1:
    fragments to compare, under their bucket, with their count; 2: windows
    already known as repeated, under their text's number.

    Of equal fragments in a block only those of its smallest document are
    compared; the others lose all their windows whatever comes out.  So a
    fragment that very many documents have is sent once a block.
    """
    spread = settings.spread

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids, data, offsets in opened(batch):
                shared = mask_of(batch.column("masks")[i])
                if not shared.any():
                    continue
                text, position, first, last, gram = anchors(data, offsets, settings)
                keep = shared[np.searchsorted(np.unique(gram), gram)]
                text, position, first, last, gram = (x[keep] for x in (text, position, first, last, gram))
                doc = ids.to_numpy()[text]
                low, high = position - last, position - first
                context = contexts(data, offsets, text, position, spread)
                for k in range(spread):
                    context[k >= high, k] = 0
                    context[k >= spread - low, spread + k] = 0
                later = _beaten(gram, doc, low, high, context)
                number = (batch.column("block")[i].as_py() << 22) + text
                fields = {
                    "gram": gram, "text_no": number, "doc_id": doc, "position": position - offsets[text], "low": low, "high": high,
                }
                texts = np.unique(text)
                blobs = [pack(data[offsets[x] : offsets[x + 1]]) for x in texts]
                sizes = np.diff(offsets)[texts]

                bucket = ((gram >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
                sent = np.flatnonzero(~later)
                sent = sent[np.lexsort((position[sent], bucket[sent]))]
                names, begins = np.unique(bucket[sent], return_index=True)
                parts = np.split(sent, begins[1:]) if len(sent) else []
                known = _windows(fields["position"][later], _all_windows(low[later], high[later]))
                known_texts, known_begins = np.unique(number[later], return_index=True)
                lists = np.split(known, known_begins[1:]) if len(known) else []
                columns = [
                    np.repeat([0, 1, 2], [len(texts), len(parts), len(lists)]).astype(np.int32),
                    np.concatenate([number[np.unique(text, return_index=True)[1]], names, known_texts]),
                    np.concatenate([ids.to_numpy()[texts], np.zeros(len(parts) + len(lists), np.int64)]),
                    np.concatenate([sizes, [len(x) for x in parts], [len(x) for x in lists]]).astype(np.int64),
                ]
                blobs += [_packed({k: v[x] for k, v in fields.items()}, context[x]) for x in parts]
                blobs += [x.tobytes() for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(blobs, pa.binary())], names=["kind", "name", "doc_id", "n", "data"]
                )
                pa.default_memory_pool().release_unused()

    return masked.mapInArrow(rows, _ROWS)


def single_windows(fields: dict[str, np.ndarray], context: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fragments as one fragment a window, each with the bytes of its window alone."""
    low, high = fields["low"].astype(np.int64), fields["high"].astype(np.int64)
    each = high - low + 1
    of = np.repeat(np.arange(len(low)), each)
    k = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    spread = context.shape[1] // 2
    byte = np.arange(spread)
    inside = np.concatenate([byte < k[:, None], byte < spread - k[:, None]], axis=1)
    single = {name: values[of] for name, values in fields.items()} | {"low": k, "high": k}
    return single, np.where(inside, context[of], 0).astype(np.uint8)


_PARTS = "bucket long, part long, known boolean, n long, data binary"


def parted(fragments: DataFrame, hot: DataFrame, settings: SubstringSettings) -> DataFrame:
    """Rows (bucket, part, known, n, data): the fragments in groups that a task can take.

    Buckets not in ``hot`` stay whole.  Windows of the others go to a part by their
    bytes.  Of equal windows that a task has at once those of the smallest
    document are sent; the others are already decided, ``known``: pairs (text number,
    window), in a group for each task.
    """
    width = 2 * settings.spread

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[tuple[int, int], list] = {}
        rows = 0
        for batch in batches:
            for bucket, total, n, data in zip(*(batch.column(c) for c in ("bucket", "total", "n", "data")), strict=True):
                name = bucket.as_py(), total.as_py()
                held.setdefault(name, []).append(_unpacked(data.as_buffer(), n.as_py(), width))
                rows += n.as_py()
                if rows >= _PARTED_ROWS:
                    yield from (_parts(*name, pieces, task, settings) for name, pieces in held.items())
                    held, rows = {}, 0
        yield from (_parts(*name, pieces, task, settings) for name, pieces in held.items())

    whole = fragments.join(hot, "bucket", "left_anti")
    whole = whole.select("bucket", F.lit(0).cast("long").alias("part"), F.lit(False).alias("known"), "n", "data")
    return whole.union(fragments.join(hot, "bucket").select("bucket", "total", "n", "data").mapInArrow(parts, _PARTS))


def _parts(bucket: int, total: int, pieces: list, task: int, settings: SubstringSettings) -> pa.RecordBatch:
    """The rows of ``parted`` for pieces of one hot bucket, which has ``total`` fragments."""
    together = {name: np.concatenate([f[name] for f, _ in pieces]) for name, _ in _FIELDS}
    fields, context = single_windows(together, np.concatenate([c for _, c in pieces]))
    later = _beaten(fields["gram"], fields["doc_id"], fields["low"], fields["high"], context)
    known = np.stack([fields["text_no"][later], _windows(fields["position"][later], np.int64(1) << fields["low"][later])])
    n_parts = -(-total * max(1, settings.spread // 2) // BUCKET_ROWS)
    kind = _kinds(fields["gram"], fields["low"], fields["high"], context)
    part = ((kind >> np.uint64(8)) % np.uint64(n_parts)).astype(np.int64)
    sent = np.flatnonzero(~later)
    sent = sent[np.argsort(part[sent], kind="stable")]
    names, begins = np.unique(part[sent], return_index=True)
    groups = np.split(sent, begins[1:])
    blobs = [_packed({k: v[x] for k, v in fields.items()}, context[x]) for x in groups]
    sizes = [len(x) for x in groups]
    flags = [False] * len(groups)
    if later.any():
        names, flags = np.append(names, task), [*flags, True]
        sizes, blobs = [*sizes, known.shape[1]], [*blobs, known.astype(np.int64).tobytes()]
    columns = [pa.array(np.full(len(names), bucket)), pa.array(names), pa.array(flags), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())]
    pa.default_memory_pool().release_unused()
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "known", "n", "data"])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [pack(np.frombuffer(t.as_buffer(), np.uint8)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], names=batch.schema.names)


def _unpacked_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n").to_pylist()
        texts = [unpack(t.as_buffer(), n).tobytes() for t, n in zip(batch.column("text"), sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])


def repeated_substrings(
    docs: DataFrame, settings: SubstringSettings = SubstringSettings(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of ``docs``.

    A byte goes if a string of ``size`` bytes that covers it also starts in a
    document with a smaller key.  A null text is empty; texts shorter than
    ``size`` stay whole; rows with equal keys never count against each
    other; a null key is not smaller than any.  Extra columns are not read; an
    empty table gives no row.
    """
    size = settings.size
    payload = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), payload.alias("text"))
    named = named.withColumn("digest", F.sha2("text", 256))
    digests = staged(named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    several = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = digests.join(several, "digest").where("doc_id > first").select("doc_id", "digest").distinct()
    copies = staged(copies, "copies")

    def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of, _, _, _, gram = anchors(data, offsets, settings)
        order = np.lexsort((of, gram))
        gram, of = gram[order], of[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(gram)) - 1
        return gram[starts], of[starts] != of[ends] if len(starts) else np.zeros(0, bool)

    # texts move as packed bytes, by a plain shuffle at every size
    packed = named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n"), "text").mapInArrow(
        _packed_texts, "doc_id long, digest string, n long, text binary"
    )
    single = packed.join(copies.hint("merge"), ["doc_id", "digest"], "left_anti")
    single = single.select("doc_id", "n", "text").mapInArrow(_unpacked_texts, "doc_id long, text binary")
    blocks = text_blocks(single, "doc_id", "text")
    masks = staged(shared_masks(blocks, grams, 0.07), "masks")
    buckets = max(1, (masks.agg(F.sum("shared")).first()[0] or 0) // BUCKET_ROWS)
    found = staged(_fragments(with_masks(blocks, masks), buckets, settings), "fragments")

    def compare(table: pa.Table) -> pa.Table:
        if table.column("known")[0].as_py():
            pairs = np.concatenate([np.frombuffer(b.as_buffer(), np.int64).reshape(2, -1) for b in table.column("data")], axis=1)
            return pa.table({"text_no": pa.array(pairs[0]), "window": pa.array(pairs[1])})
        parts = [
            _unpacked(data.as_buffer(), n.as_py(), 2 * settings.spread)
            for n, data in zip(table.column("n"), table.column("data"), strict=True)
        ]
        fields = {name: np.concatenate([f[name] for f, _ in parts]) for name, _ in _FIELDS}
        low, high = fields["low"].astype(np.int64), fields["high"].astype(np.int64)
        mask = window_owners(fields["gram"], fields["doc_id"], low, high, np.concatenate([c for _, c in parts]))
        hit = np.flatnonzero(mask)
        windows = _windows(fields["position"][hit], mask[hit])
        pa.default_memory_pool().release_unused()
        return pa.table({"text_no": pa.array(fields["text_no"][hit]), "window": pa.array(windows)})

    fragments = found.where("kind = 1").select(F.col("name").alias("bucket"), "n", "data")
    hot = fragments.groupBy("bucket").agg(F.sum("n").alias("total")).where(F.col("total") > settings.hot_rows)
    groups = parted(fragments, staged(hot, "hot-buckets"), settings).groupBy("bucket", "known", "part")
    judged = groups.applyInArrow(compare, "text_no long, window long")
    judged = judged.groupBy("text_no").agg(F.collect_list("window").alias("windows"))
    known = found.where("kind = 2").select(F.col("name").alias("text_no"), F.col("data").alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, data, windows, known_here in zip(*batch.columns, strict=True):
                body = unpack(data.as_buffer(), n.as_py())
                numbers = np.frombuffer(known_here.as_py() or b"", np.int64)
                if windows.is_valid:
                    numbers = np.concatenate([numbers, windows.values.to_numpy()])
                gone = _removed(len(body), numbers >> 28, numbers & ((1 << 28) - 1), size)
                spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                digest = hashlib.sha256(body.tobytes()).hexdigest()
                kept = hashlib.sha256(body[~gone].tobytes()).hexdigest()
                out.append((doc_id.as_py(), digest, int(gone.sum()), spans, kept))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "digest", "removed", "spans", "kept"],
            )

    texts = found.where("kind = 0").select(F.col("name").alias("text_no"), "doc_id", "n", "data")
    changed = (
        texts.join(judged, "text_no", "left")
        .join(known, "text_no", "left")
        .where("windows IS NOT NULL OR known IS NOT NULL")
        .select("doc_id", "n", "data", "windows", "known")
        .mapInArrow(cut, "doc_id long, digest string, removed long, spans long, kept string")
        .dropDuplicates(["doc_id", "digest"])
    )
    copied = copies.withColumn("copied", F.lit(True))
    nothing = F.sha2(F.lit(""), 256)
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= size)
    return (
        digests.join(copied, ["doc_id", "digest"], "left")
        .join(changed, ["doc_id", "digest"], "left")
        .select(
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
            "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, nothing).otherwise(F.coalesce("kept", "digest")).alias("kept_sha256"),
        )
    )
