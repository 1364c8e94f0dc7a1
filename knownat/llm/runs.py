"""Runs: stretches of words that repeat with a period, found by a sparse diagonal dynamic program.

A diagonal is a lag: word i lies on lag q if it equals word i - q. Going from left to right, each position's earlier
occurrence either lengthens the match of its lag or starts a new one, and a lag that is not lengthened ends; if its match is
long enough, the run is given out. Single words occur far too often for that in a text of many repeats (the matches grow
with the square), so positions are those of blocks of words: a run of period q and at least max(24, 3 q) words matches
itself at lag q over at least max(24 - q, 2 q) words, hence over blocks of K words for K = 16 if q <= 16, and for
the power of two K with K / 2 < q <= K beyond.

Then the nearest earlier occurrence is enough. Let the block at i recur within the run at a smaller lag d < q <= K. The words
from i - d to i + K have the periods d and q and are at least d + q, so they have the period gcd(d, q), and with them the
whole run, whose smallest period would be less than q. So inside a run every nearest lag is q, and only there;
each size K needs one pass in n log n, and there are log n sizes. A size whose blocks never recur ends the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from knownat.llm import words

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Words of the smallest blocks.
SMALLEST = 16
#: Columns that are added.
MADE = ("n_words", "runs", "collapsed")


def nearest_lags(blocks: np.ndarray) -> np.ndarray:
    """How far back the same value occurred last; 0 where it did not."""
    order = np.argsort(blocks, kind="stable")
    same = blocks[order[1:]] == blocks[order[:-1]]
    lags = np.zeros(len(blocks), np.int64)
    lags[order[1:][same]] = order[1:][same] - order[:-1][same]
    return lags


def doubled(blocks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of twice as many words, from those of `size` words."""
    with np.errstate(over="ignore"):
        return words.mix(blocks[:-size] * np.uint64(0x9E3779B97F4A7C15) + words.mix(blocks[size:] + np.uint64(0x632BE59BD9B4E019)))


def find(hashed: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs among word hashes, by start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    blocks, size = hashed, 1
    while len(blocks) > size and size < SMALLEST:
        blocks, size = doubled(blocks, size), size * 2
    while size >= SMALLEST and len(blocks) > 1 and 2 * len(hashed) > 3 * size - 2 * SMALLEST:
        lags = nearest_lags(blocks)
        if not lags.any():
            break
        on = (lags > 0) & (lags <= size) & ((lags > size // 2) | (size == SMALLEST))
        edge = np.flatnonzero(np.diff(lags)) + 1
        starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(lags)]])
        keep = on[starts]
        starts, stops = starts[keep], stops[keep]
        period = lags[starts]
        length = stops - starts + size - 1 + period  # matched words, and the first period
        ended = length >= np.maximum(LEAST, TIMES * period)
        found.append(np.column_stack([starts - period, length, period])[ended])
        if len(blocks) <= size:
            break
        blocks, size = doubled(blocks, size), size * 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words that some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _verified(runs: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """The runs whose words, not only their hashes, repeat."""
    good = [tokens[s + q : s + n] == tokens[s : s + n - q] for s, n, q in runs.tolist()]
    return runs[np.array(good, bool)] if len(runs) else runs


def _found(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, text):
                split = words.split(part.column(text))
                hashed, data = words.hashes(split), split.data.tobytes()
                counts, runs, collapsed = [], [], []
                for first, last, start, stop in zip(split.word_offsets[:-1], split.word_offsets[1:], split.offsets[:-1], split.offsets[1:]):
                    tokens = data[start:stop].split()
                    own = find(hashed[first:last]) if last - first >= LEAST else np.zeros((0, 3), np.int64)
                    if len(own):
                        own = _verified(own, tokens)
                        gone = dropped(own, len(tokens)).tolist()
                        tokens = [x for x, away in zip(tokens, gone) if not away]
                    counts.append(last - first)
                    runs.append([dict(zip(("start", "length", "period"), x)) for x in own.tolist()])
                    collapsed.append(b" ".join(tokens))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                arrays = [pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *MADE])

    return run


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs with n_words, runs (array of start, length, period) and collapsed.

    A run is a stretch of consecutive words with smallest period q, of at least max(24, 3 q) words, that no neighbouring word
    extends. Words lie between blanks (space, and the control signs 9 to 13) and are numbered from 0. `collapsed` is the text
    without the words that a run holds after its first period, joined by single spaces. A null or empty text has no words
    and no runs. Rows are independent: repeated ones get equal results. Columns of these three names are replaced.
    """
    kept = docs.drop(*MADE)
    new = StructType.fromDDL("n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return kept.mapInArrow(_found(text), StructType(kept.schema.fields + new.fields))
