"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch become one array of code points. A table maps each code point to a symbol (letter, number, other
sign, blank, apostrophe before a contraction, end of text ...), and a small automaton over the symbols says where a
pre-token starts. Its transition functions compose associatively, so the scan runs over all blocks of the array at
once: every block yields a function from entry state to exit state, the functions are composed by doubling, and a
second pass marks the starts. No regular expression runs. The slices between starts are merged by rank through a
bounded cache, and where each slice starts in the ids and in the text is kept, so any span of ids can be decoded.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from knownat.llm import words

# Code points of white space, and the letters of one- and two-letter contractions after an apostrophe.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE_LETTER = "stmd"
CONTRACTED = frozenset(ONE_LETTER)
TWO_LETTERS = ("re", "ve", "ll")

# Symbols: letter, number, other sign, apostrophe before one or two letters of a contraction, space that the next sign
# joins, other blank before a sign, blank before a blank or the end, end of text.
L, N, O, A1, A2, SPACE, BLANK, RUN, END = range(9)
# States: the next sign starts a slice; in letters; in numbers; in other signs; after a joining space; in a run of
# blanks; one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, SIGNS, JOIN, BLANKS, ONE, TWO = range(8)
_SENTINEL = 0x110000
BLOCK = 256
#: Texts up to this many bytes are cut sign by sign: below it the cost of array calls outweighs that of the text.
SHORT = 512
#: Slices longer than this are merged with a heap, as their length has no bound.
LONG = 48
#: Slices that each worker remembers before it starts anew.
CACHE = 300_000
#: Ids that are decoded at once.
DECODED = 1 << 18


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a slice starts, for each symbol and state."""
    goes = {L: LETTERS, N: NUMBERS, O: SIGNS, A1: ONE, A2: TWO, SPACE: JOIN, BLANK: FRESH, RUN: BLANKS, END: FRESH}
    step = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    for symbol, state in goes.items():
        step[symbol] = state
    stays = [(L, LETTERS, LETTERS), (L, JOIN, LETTERS), (L, TWO, ONE), (L, ONE, FRESH), (N, NUMBERS, NUMBERS), (N, JOIN, NUMBERS), (RUN, BLANKS, BLANKS)]
    stays += [(s, before, SIGNS) for s in (O, A1, A2) for before in (SIGNS, JOIN)]
    for symbol, before, after in stays:
        step[symbol, before], starts[symbol, before] = after, False
    return step, starts


STEP, STARTS = _automaton()
_STEP, _STARTS = STEP.tolist(), STARTS.tolist()
_tables: dict[str, np.ndarray | bytes] = {}


def _classes() -> np.ndarray:
    """L, N, O or RUN (white space) of each code point, END of the sentinel."""
    if "classes" not in _tables:
        table = np.full(_SENTINEL + 1, O, np.uint8)
        for point in range(_SENTINEL):
            kind = unicodedata.category(chr(point))[0]
            if kind in "LN":
                table[point] = L if kind == "L" else N
        table[list(WHITE_SPACE)] = RUN
        table[_SENTINEL] = END
        _tables["classes"] = table
    return _tables["classes"]


def symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point, which looks at most two code points ahead."""
    kind = _classes()[points]
    after = np.append(kind[1:], END)
    lone = (kind == RUN) & (after != RUN) & (after != END)
    out = np.where(lone, np.where(points == 0x20, SPACE, BLANK), kind).astype(np.uint8)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.concatenate([points, [_SENTINEL, _SENTINEL]])
        one, two = padded[quotes + 1], padded[quotes + 2]
        pair = np.zeros(len(quotes), bool)
        for a, b in TWO_LETTERS:
            pair |= (one == ord(a)) & (two == ord(b))
        out[quotes[pair]] = A2
        out[quotes[np.isin(one, [ord(x) for x in ONE_LETTER])]] = A1
    return out


def slice_starts(points: np.ndarray) -> np.ndarray:
    """Flags where slices start (also at each sentinel that ends a text)."""
    n = len(points)
    if n <= BLOCK:
        return _walk(symbols(points))
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = symbols(points)
    columns = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    step, starts = STEP.ravel(), STARTS.ravel()
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    columns *= np.uint8(8)
    for at, symbol in enumerate(columns):
        if not at % 16 and whole.shape[1] > 1 and (whole == whole[:, :1]).all():
            whole = whole[:, :1]  # by now every entry state leads to the same state in every row
        whole = step[symbol[:, None] + whole]
    whole = np.broadcast_to(whole, (rows, 8)).copy()
    reach = 1
    while reach < rows:  # each row becomes the composition of all rows up to it
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], 1)
        reach *= 2
    state = np.concatenate([[FRESH], whole[:-1, FRESH]]).astype(np.uint8)
    flags = np.empty((BLOCK, rows), bool)
    for at, symbol in enumerate(columns):
        flags[at] = starts[symbol + state]
        state = step[symbol + state]
    return flags.T.ravel()[:n]


def _walk(found: np.ndarray) -> np.ndarray:
    """The same by one step after the other, for short runs."""
    flags, state = [], FRESH
    for symbol in found.tolist():
        flags.append(_STARTS[symbol][state])
        state = _STEP[symbol][state]
    return np.array(flags, bool)


def starts(text: bytes) -> list[int]:
    """Byte positions where the slices of one text start; a short one is walked without arrays."""
    if len(text) > SHORT:
        return Slices(pa.array([text], pa.binary())).starts.tolist()
    if "bytes" not in _tables:
        _tables["bytes"] = _classes().tobytes()
    kinds, signs = _tables["bytes"], text.decode()
    found = [kinds[ord(c)] for c in signs]
    found.append(END)
    out, at, state, wide = [], 0, FRESH, len(signs) < len(text)
    for i, c in enumerate(signs):
        symbol = found[i]
        if symbol == RUN and found[i + 1] < RUN:
            symbol = SPACE if c == " " else BLANK
        elif c == "'":
            symbol = A1 if signs[i + 1 : i + 2] in CONTRACTED else A2 if signs[i + 1 : i + 3] in TWO_LETTERS else symbol
        if _STARTS[symbol][state]:
            out.append(at)
        state = _STEP[symbol][state]
        at += len(c.encode()) if wide else 1
    return out


class Slices:
    """Pre-token slices of a run of texts."""

    def __init__(self, column: pa.Array):
        data, offsets = words.flat(column)
        lead = (data & 0xC0) != 0x80  # first byte of a code point
        first = np.flatnonzero(lead)
        count = np.concatenate([[0], np.cumsum(lead)])[offsets] if len(data) else np.zeros(len(offsets), np.int64)
        texts = len(offsets) - 1
        real = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.arange(len(real)) + np.repeat(np.arange(texts), np.diff(count))
        points = np.full(len(real) + texts, _SENTINEL, np.uint32)
        points[at] = real
        flags = slice_starts(points)[at]
        self.bytes = data.tobytes()
        self.starts = first[flags]  # byte where each slice starts
        self.ends = np.append(self.starts[1:], len(data))
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)  # first slice of each text, one more than texts

    def __iter__(self) -> Iterator[bytes]:
        data = self.bytes
        return (data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Merger:
    """Ids of a slice by rank, remembered for about CACHE slices."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known, self.older = ranks, {}, {}

    def ids(self, piece: bytes) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece) or self._merge(piece)
            if len(self.known) >= CACHE // 2:  # what is met again moves to the new half
                self.known, self.older = {}, self.known
            if len(piece) <= LONG:
                self.known[piece] = found
        return found

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of ids of each slice; equal ones are looked up once."""
        known = {piece: len(self.ids(piece)) for piece in set(pieces)}
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > LONG:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges, lowest rank and then leftmost first, in n log n."""
        ranks, n = self.ranks, len(piece)
        stop = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = stop[i]
            if not middle or middle >= n or not stop[middle] or stop[middle] != end:
                continue
            stop[i], stop[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : stop[end]])) is not None:
                    heappush(heap, (r, i, stop[end]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
                heappush(heap, (r, j, end))
        return tuple(ranks[piece[i : stop[i]]] for i in range(n) if stop[i])


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, made: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema], schema=schema)


def added(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of df with more fields; a column of the same name is replaced."""
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + fields)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", offsets: bool = True) -> DataFrame:
    """Add `ids`, the token ids of each whole text, and with `offsets` where each slice starts.

    `slice_ids` and `slice_bytes` are positions in the ids and in the UTF-8 bytes. A null text counts as empty; an
    empty text has no ids. Each match of the pre-token pattern is merged alone; there are no special tokens. Columns
    named ids, slice_ids or slice_bytes are replaced. Rows are independent, so lost tasks are simply run again.
    """
    kind = T.ArrayType(T.IntegerType(), False)
    schema = added(docs, [T.StructField(n, kind, False) for n in ("ids", "slice_ids", "slice_bytes")][: 3 if offsets else 1])
    return docs.mapInArrow(_encoder(docs.sparkSession, ranks, text, schema, offsets), schema)


def _encoder(spark: SparkSession, ranks: dict[bytes, int], text: str, schema: T.StructType, keep: bool) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = spark.sparkContext.broadcast(ranks)  # as many entries as the vocabulary file has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, form = Merger(shared.value), to_arrow_schema(schema)
        for batch in batches:
            for part in words.slices(batch, text):
                cut = Slices(part.column(text))
                known, ids_of = merge.known.get, merge.ids
                found = [known(piece) or ids_of(piece) for piece in cut]
                at = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
                ids = np.fromiter(chain.from_iterable(found), np.int32, at[-1])
                made = {"ids": lists(ids, at[cut.first])}
                if keep:
                    text_of = np.repeat(np.arange(part.num_rows), np.diff(cut.first))
                    made["slice_ids"] = lists(at[:-1] - at[cut.first][text_of], cut.first)
                    made["slice_bytes"] = lists(cut.starts - cut.offsets[text_of], cut.first)
                yield with_columns(part, form, made)

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add the bytes of each row's ids. Null ids give empty bytes; an unknown id raises KeyError.

    All columns of `encoded` go through the workers, whole batches at a time: those that are not needed later, such as
    the text or the slices, should be dropped before.
    """
    schema = added(encoded, [T.StructField(output, T.BinaryType(), False)])
    return encoded.mapInArrow(_decoder(encoded.sparkSession, ranks, ids, output, schema), schema)


def _decoder(spark: SparkSession, ranks: dict[bytes, int], ids: str, output: str, schema: T.StructType) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_schema

    numbers, tokens = zip(*{rank: token for token, rank in ranks.items()}.items()) if ranks else ((), ())
    shared = spark.sparkContext.broadcast((pa.array(numbers, pa.int64()), pa.array(tokens, pa.binary())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (numbers, tokens), form = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for part in words.parts(batch, _offsets(batch.column(ids)), DECODED):
                column = part.column(ids)
                values = column.flatten().cast(pa.int64())
                at = pc.index_in(values, value_set=numbers)
                if at.null_count:
                    raise KeyError(values.filter(at.is_null())[0].as_py())
                pieces = pa.ListArray.from_arrays(pa.array(_offsets(column), pa.int32()), tokens.take(at))
                yield with_columns(part, form, {output: pc.binary_join(pieces, b"")})

    return run


def _offsets(column: pa.ListArray) -> np.ndarray:
    """Where the values of each list start among those of all lists; a null is an empty list."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
