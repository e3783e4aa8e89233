"""Words of whole texts, found and hashed over Arrow buffers with numpy.

The text of a batch is one run of UTF-8 bytes with offsets, as Arrow keeps it. Both word rules used here name ASCII
characters only, and bytes of other characters are all 0x80 and above, so words can be found byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[48:58] = _LETTERS[97:123] = _LETTERS[65:91] = _LETTERS[128:] = True

#: Words are runs of bytes other than ASCII white space.
SPACED = ~_SPACES
#: Words are runs of digits, ASCII letters and all characters beyond ASCII.
ALPHANUMERIC = _LETTERS

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_POWERS = np.cumprod(np.full(1 << 12, _STEP, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _STEP, dtype=np.uint64))


@dataclass
class Words:
    """The words of a run of texts, in order: byte range, text (by its place in the run) and 64-bit hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    def spelled(self, first: int, count: int) -> bytes:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, first + count))


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, begins, data = column.buffers()
    if begins is None or not begins.size:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(begins, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``size`` bytes together, or of one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Words of the texts between ``offsets``; A-Z are lower-cased. No word goes over a text's end."""
    base = int(offsets[0])
    data = _LOWER[data[base : int(offsets[-1])]]
    offsets = offsets - base
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(start):
        return Words(data, start, end, start, start.astype(np.uint64))
    text = np.searchsorted(offsets, start, "right") - 1
    length = end - start
    place = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(place, length)
    value = _BYTE_VALUE[data[inside]] * _powers(int(length.max()))[within]
    return Words(data, start, end, text, mix(np.add.reduceat(value, place)))


def gram_hashes(words: Words, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places with fewer words to the end of the run are left out."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = total * _STEP + words.hash[i : i + count]
    return mix(total + np.uint64(n))
