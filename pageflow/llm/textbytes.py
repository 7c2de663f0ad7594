"""Texts of an Arrow batch as one byte array, and hashes of its stretches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Batches are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
#: A power is the product of two from short tables, so no worker keeps 8 bytes for each byte of its longest text.
LOW_POWERS = 2048
_POWERS: dict[str, np.ndarray] = {}


def slices(
    batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of the column, null as empty; ``size`` stands for SLICE_BYTES."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        own = offsets[begin : end + 1]
        yield begin, end, data[own[0] : own[-1]], own - own[0]
        begin = end


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` below LOW_POWERS, and those of its LOW_POWERS-th power that exponents up to ``n`` need."""
    for name, step, size in ((f"{base} low", base, LOW_POWERS), (f"{base} high", pow(base, LOW_POWERS, 2**64), n // LOW_POWERS + 1)):
        if name not in _POWERS or len(_POWERS[name]) < size:
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS[f"{base} low"], _POWERS[f"{base} high"]


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers."""
    low, high = _tables(base, n)
    return np.multiply.outer(high[: n // LOW_POWERS + 1], low).ravel()[:n]


def _powers_at(base: int, exponents: np.ndarray, n: int) -> np.ndarray:
    """Powers with exponents from 0 to ``n``."""
    low, high = _tables(base, n)
    return high[exponents // LOW_POWERS] * low[exponents % LOW_POWERS]


def _byte_values() -> np.ndarray:
    values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed(values)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Hashes:
    """64-bit hashes of any stretches of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _powers(_BASE, len(data))
        values *= _byte_values()[data]
        np.cumsum(values, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _powers_at(_INVERSE, starts, len(self.sums))
        return mixed(raw + (ends - starts).astype(np.uint64))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a byte-wise array within each text."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
