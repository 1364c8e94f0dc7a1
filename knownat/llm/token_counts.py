"""Token counts that follow edits without encoding a document anew.

A document is kept as a binary tree of sums over its pre-token slices: each leaf has the bytes and tokens of one slice,
each inner node those of its subtree. An edit finds its leaves by walking down the byte sums, re-encodes only their
text with some slices of context until slice starts agree with the old ones again, and updates the sums above.

Agreement is safe: whether a slice starts at a sign depends on the state before it, but the state after a sign at which
a slice starts depends on that sign alone, and a sign's symbol looks at most two signs ahead. So scanning begins at a
slice start at least three code points before the edit and may end at the first start it shares with the old slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.llm import bpe, words

#: Bytes before an edit that may change meaning with it: three code points of at most four bytes.
LOOK_AROUND = 12
EDIT = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("added", T.StringType())]))


class CountTree:
    """Sums over slices. Leaves stay where they are: a leaf may hold several slices, or none, after edits.

    Only leaves that an edit changed are kept as lists; the others are their one slice. `counts` are the tokens of each
    slice, where they are known.
    """

    def __init__(self, slices: list[bytes], merger: bpe.Merger, counts: np.ndarray | None = None):
        self.merger, self.slices = merger, slices
        self.changed: dict[int, list[bytes]] = {} if slices else {0: []}
        self.last = max(len(slices) - 1, 0)
        self.width = 1 << self.last.bit_length()
        self.sizes, self.tokens = self._sums(list(map(len, slices)), merger.counts(slices) if counts is None else counts)
        self.whole = b"".join(slices)
        self.encoded = 0  # bytes encoded for edits so far

    def _sums(self, *leaves: list[int] | np.ndarray) -> list[memoryview]:
        """The trees over some leaves, level by level; node i has the children 2i and 2i + 1."""
        levels = [np.zeros((len(leaves), self.width), np.int64)]
        for row, values in zip(levels[0], leaves):
            row[: len(values)] = values
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1][:, ::2] + levels[-1][:, 1::2])
        nodes = np.concatenate([np.zeros_like(levels[-1]), *levels[::-1]], 1)
        return [memoryview(row) for row in nodes]

    @property
    def size(self) -> int:
        return self.sizes[1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def leaves(self) -> list[list[bytes]]:
        return [self._held(leaf) for leaf in range(self.last + 1)]

    def text(self) -> bytes:
        return self.whole

    def _held(self, leaf: int) -> list[bytes]:
        found = self.changed.get(leaf)
        return [self.slices[leaf]] if found is None else found

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds byte `at` (the last with text, at the end) and the byte where it starts."""
        sizes, width = self.sizes, self.width
        at, node, start = min(at, max(self.size - 1, 0)), 1, 0
        while node < width:
            node *= 2
            if at >= start + sizes[node]:
                start += sizes[node]
                node += 1
        return min(node - width, self.last), start

    def _set(self, first: int, last: int, slices: list[bytes]) -> None:
        """Give the leaf `first` these slices and the leaves after it up to `last` none, and update the sums above."""
        sizes, tokens, ids = self.sizes, self.tokens, self.merger.ids
        low, high = first + self.width, last + self.width
        self.changed[first] = slices
        sizes[low], tokens[low] = sum(map(len, slices)), sum([len(ids(s)) for s in slices])
        for leaf in range(first + 1, last + 1):
            self.changed[leaf] = []
            sizes[leaf + self.width] = tokens[leaf + self.width] = 0
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                sizes[node] = sizes[2 * node] + sizes[2 * node + 1]
                tokens[node] = tokens[2 * node] + tokens[2 * node + 1]

    def edit(self, at: int, removed: int, added: bytes) -> None:
        """Replace `removed` bytes from byte `at` by `added`; both ends must be code point limits."""
        at = min(max(at, 0), self.size)
        removed = min(max(removed, 0), self.size - at)
        if not removed and not added:
            return
        self.whole = self.whole[:at] + added + self.whole[at + removed :]
        first, start = self._leaf(max(at - LOOK_AROUND, 0))
        last, last_start = self._leaf(at + removed + 2 * LOOK_AROUND)
        end = last_start + self.sizes[last + self.width]
        old = [s for leaf in range(first, last + 1) for s in self._held(leaf)]
        moved, more = len(added) - removed, 1
        while True:
            new = self.whole[start : end + moved]
            found = bpe.starts(new)
            if end == self.size:
                agreed = None
                break
            limits = list(accumulate(map(len, old), initial=start))[:-1]  # where old slices start
            kept = {x + moved for x in limits if x >= at + removed}  # those after the edit, where they are now
            sure = len(new) - LOOK_AROUND  # two more signs follow a start before it: its symbol is the true one
            agreed = next((i for i, x in enumerate(found) if x + start in kept and x < sure), None)
            if agreed is not None:
                break
            grown = min(last + more, self.last)  # include more slices to the right
            for leaf in range(last + 1, grown + 1):
                old += self._held(leaf)
                end += self.sizes[leaf + self.width]
            last, more = grown, 2 * more
        slices = [new[a:b] for a, b in pairwise([*found, len(new)])]
        if agreed is not None:  # from the agreed start on, the old slices hold
            slices = slices[:agreed] + old[limits.index(found[agreed] + start - moved) :]
        self.encoded += len(new)
        self._set(first, last, slices)


def count_edits(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", edits: str = "edits") -> DataFrame:
    """Add n_tokens, edited_tokens, encoded_bytes (encoded for the edits), edited_bytes and edited_text.

    `edits` is an array of (at, removed, added), applied in order; positions count code points of the text as it is
    then, and what lies outside it is ignored. Null or empty edits leave the count; a null text counts as empty and a
    null `added` as nothing. Columns of the names added are replaced. Rows are independent of each other.
    """
    long = T.LongType()
    made = [T.StructField(n, long, False) for n in ("n_tokens", "edited_tokens", "encoded_bytes", "edited_bytes")]
    made.append(T.StructField("edited_text", T.StringType(), False))
    schema = bpe.added(docs, made)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as many entries as the vocabulary file has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        merger, form = bpe.Merger(shared.value), to_arrow_schema(schema)
        for batch in batches:
            for part in words.slices(batch, text):
                cut = bpe.Slices(part.column(text))
                pieces, found, limits = list(cut), [], cut.first.tolist()
                counts = merger.counts(pieces)
                for wanted, a, b in zip(part.column(edits).to_pylist(), limits, limits[1:]):
                    tree = CountTree(pieces[a:b], merger, counts[a:b])
                    before = tree.count
                    for e in wanted or []:
                        apply(tree, e["at"] or 0, e["removed"] or 0, e["added"] or "")
                    found.append((before, tree.count, tree.encoded, tree.size, tree.text().decode()))
                columns = list(zip(*found))
                yield bpe.with_columns(part, form, {f.name: pa.array(columns[k], form.field(f.name).type) for k, f in enumerate(made)})

    return docs.mapInArrow(run, schema)


def apply(tree: CountTree, at: int, removed: int, added: str) -> None:
    """An edit whose positions count code points."""
    data = tree.text()
    if data.isascii():
        tree.edit(at, removed, added.encode())
        return
    text = data.decode()
    at = min(max(at, 0), len(text))
    start = len(text[:at].encode())
    tree.edit(start, len(text[at : at + max(removed, 0)].encode()), added.encode())


def sample_edits(docs: DataFrame) -> DataFrame:
    """Add three edits made from each text: ten signs go at a quarter of it, its first twenty are put in at the middle,
    and five at three quarters become an apostrophe and an s."""
    n = F.char_length(F.coalesce("text", F.lit("")))

    def edit(at: F.Column, removed: int, added: F.Column) -> F.Column:
        return F.struct(at.cast("bigint").alias("at"), F.lit(removed).cast("bigint").alias("removed"), added.alias("added"))

    third = F.floor(n * 3 / 4)
    return docs.withColumn("edits", F.array(edit(F.floor(n / 4), 10, F.lit("")), edit(F.floor(n / 2), 0, F.substring("text", 1, 20)), edit(third, 5, F.lit("'s"))))
