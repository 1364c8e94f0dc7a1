"""Words of many texts at once as numpy arrays: positions, document numbers and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: The bytes that part words.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    data: np.ndarray  # uint8, all texts one after the other
    offsets: np.ndarray  # where each text starts; one more than texts
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    docs: np.ndarray  # number of the text of each word
    word_offsets: np.ndarray  # first word of each text; one more than texts


def slices(batch: pa.RecordBatch, column: str, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about `target` bytes of text, to bound the arrays made from them."""
    if batch.num_rows:
        yield from parts(batch, flat(batch.column(column))[1], target)


def parts(batch: pa.RecordBatch, offsets: np.ndarray, target: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about `target` items; `offsets` say where the items of each row start."""
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + target, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts. A null is an empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, lower: bool = False, letters: np.ndarray | None = None) -> Words:
    """Words between blanks; with `letters` (256 flags), words are runs of flagged bytes instead."""
    data, offsets = flat(column)
    if lower:
        data = _LOWER[data]
    part = _BLANK[data] if letters is None else ~letters[data]
    first, last = ~part, ~part
    first[1:] &= part[:-1]
    last[:-1] &= part[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ~part[inner]
    last[inner - 1] = ~part[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    word_offsets = np.searchsorted(starts, offsets)
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(word_offsets))
    return Words(data, offsets, starts, ends, docs, word_offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and their inverses, for positions below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
            steps = np.full((2, size), 1, np.uint64)
            steps[0, 1:], steps[1, 1:] = base, inverse
            _powers[:] = [np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])]
    return _powers[0], _powers[1]


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial modulo 2^64 from prefix sums, then mixed with the length."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(words.data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words.data) + 1, np.uint64)
        np.cumsum((words.data.astype(np.uint64) + np.uint64(0x1F3)) * powers[: len(words.data)], out=sums[1:])
        raw = (sums[words.ends] - sums[words.starts]) * inverses[words.starts]
        return mix(raw ^ ((words.ends - words.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
