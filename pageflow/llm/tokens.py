"""Texts to token ids inside a task, with a bounded memo of words.

The tokenizer splits at blanks and drops them before it merges anything, so the
ids of a text are the ids of its blank-separated parts in order.  Parts repeat
a lot: each worker encodes a part once and looks it up from then on.  Two
changes make more parts equal and no id different: capitals become small unless
a character follows that might combine with them, and the ASCII marks between a
letter and a blank become a part of their own.  Both go for the letters of ASCII
and Latin-1.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pageflow.llm.textbytes import slices

#: Parts a worker remembers, in some 250 bytes each; beyond that the less asked for half goes, which only costs time.
MEMO_PARTS = 600_000
#: Bytes of text encoded at once.
ENCODED_BYTES = 512 << 10

_MEMOS: dict[str, _Memo] = {}


class _Memo(dict):
    """Part -> number; a part asked for the first time is noted as new."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new: list[str] = []
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)
        #: Slices that asked for a part.
        self.asked = np.zeros(1 << 16, np.int32)

    def shrink(self, parts: int) -> None:
        """Keep the ``parts`` most asked for, in their order; what they were asked for before counts half."""
        n = len(self)
        kept = np.sort(np.argpartition(-self.asked[:n], parts)[:parts])
        names = list(self)
        self.clear()
        self.update((names[k], number) for number, k in enumerate(kept.tolist()))
        starts = self.ends[kept]
        lengths = self.ends[kept + 1] - starts
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.ids = self.ids[np.arange(int(self.ends[-1])) - np.repeat(self.ends[:-1] - starts, lengths)]
        self.asked = self.asked[kept] // 2

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.new.append(part)
        return number

    def learn(self) -> None:
        """Encode the new parts and append their ids."""
        if not self.new:
            return
        encoded: list[list[int]] = [[]] * len(self.new)
        others = []
        for k, part in enumerate(self.new):
            # the empty part between two blanks has no ids
            if not part:
                continue
            if part.isalpha() and part == part.lower() and unicodedata.is_normalized("NFC", part):
                encoded[k] = [t.id for t in self.model.tokenize(_byte_symbols(part))]
            else:
                others.append(k)
        rest = self.tokenizer.encode_batch_fast([self.new[k] for k in others], add_special_tokens=False)
        for k, e in zip(others, rest, strict=True):
            encoded[k] = e.ids
        first = len(self) - len(self.new)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        start = self.ends[first]
        ends = start + np.cumsum(lengths)
        self.ids = _room(self.ids, int(ends[-1]))
        self.ends = _room(self.ends, len(self) + 1)
        self.asked = _room(self.asked, len(self))
        self.ids[start : ends[-1]] = np.fromiter(chain.from_iterable(encoded), np.int32, int(ends[-1] - start))
        self.ends[first + 1 : len(self) + 1] = ends
        self.new = []


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


#: Characters that stand for single bytes: printable Latin-1 itself, the others from 256 on in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def _byte_symbols(word: str) -> str:
    """A normalised word of letters as the byte-level model reads it."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)


#: First byte of the characters from U+00C0 to U+00FF: letters, but for two signs, that combine with nothing before them.
_LATIN_1 = 0xC3
#: By byte: ASCII capitals, small letters and marks, and the second bytes of Latin-1 capitals and letters.
_CAPITALS, _LETTERS, _MARKS, _LATIN_1_CAPITALS, _LATIN_1_LETTERS = np.zeros((5, 256), bool)
_CAPITALS[65:91] = _LETTERS[97:123] = _LATIN_1_CAPITALS[0x80:0x9F] = _LATIN_1_LETTERS[0x80:0xC0] = True
_LATIN_1_CAPITALS[0x97] = _LATIN_1_LETTERS[[0x97, 0xB7]] = False
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _separated(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts with more parts alike; a text that may hold a special token stays as it is."""
    begins, ends = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    following = np.append(data[1:], 32)
    following[ends] = 32
    plain = np.ones(len(data), bool)
    specials = np.flatnonzero((data == 60) & (following == 124))
    for text in np.unique(np.searchsorted(offsets, specials, "right") - 1):
        plain[offsets[text] : offsets[text + 1]] = False
    latin = np.append(False, data[:-1] == _LATIN_1)
    small = (_CAPITALS[data] | (latin & _LATIN_1_CAPITALS[data])) & ((following < 128) | (following == _LATIN_1)) & plain
    data = data + 32 * small.astype(np.uint8)
    before = np.append(False, (_LETTERS[data] | (latin & _LATIN_1_LETTERS[data]))[:-1])
    before[begins] = False
    marks = _MARKS[data]
    starts = np.append(True, ~marks[:-1])
    starts[begins] = True
    stops = ~_MARKS[following]
    starts, stops = np.flatnonzero(marks & starts), np.flatnonzero(marks & stops)
    at = starts[before[starts] & plain[starts] & np.isin(following[stops], (10, 32))]
    return np.insert(data, at, 32), offsets + np.searchsorted(at, offsets)


def encode_bytes(data: np.ndarray, offsets: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text's followed by ``end_id``, and where each text ends.

    An empty text is the end id alone.
    """
    memo = _MEMOS.get(path)
    if memo is None:
        memo = _MEMOS[path] = _Memo(path)
    if len(memo) > MEMO_PARTS:
        memo.shrink(MEMO_PARTS // 2)
    n = len(offsets) - 1
    if len(data):
        data, offsets = _separated(data, offsets)
    spaced = np.where(data == 10, 32, data).astype(np.uint8)
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(spaced))
    split = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(split).to_numpy()
    parts = split.flatten().dictionary_encode()
    known = parts.dictionary.to_numpy(zero_copy_only=False)
    asked = np.fromiter(map(memo.__getitem__, known), np.int64, len(known))
    memo.learn()
    memo.asked[asked] += 1
    numbers = asked[parts.indices.to_numpy()]
    starts = memo.ends[numbers]
    lengths = memo.ends[numbers + 1] - starts
    part_ends = np.concatenate([[0], np.cumsum(lengths)])
    ids = memo.ids[np.arange(int(part_ends[-1])) - np.repeat(part_ends[:-1] - starts, lengths)]
    text_ends = part_ends[np.cumsum(counts)]
    return np.insert(ids, text_ends, end_id), text_ends + np.arange(1, n + 1)


def encoded_slices(
    batches: Iterator[pa.RecordBatch], text: str, path: str, end_id: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with ids and ends as ``encode_bytes`` gives them; null texts are empty."""
    for batch in batches:
        for first, last, data, offsets in slices(batch, text, ENCODED_BYTES):
            yield batch.slice(first, last - first), *encode_bytes(data, offsets, path, end_id)
