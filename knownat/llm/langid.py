"""Language identification by error-correcting output codes over hashed character n-grams.

Each language has a codeword. For every bit a linear classifier of n-grams separates the languages whose codeword has
the bit from the others (naive Bayes log ratios). A text's margins are decoded to the codeword with the least loss, each
bit weighted by how sure its classifier was on the training texts; a text whose two best codewords lie close together
is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from knownat.llm import words
from knownat.llm.bpe import added, with_columns

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits of +1 and -1
    weights: np.ndarray  # bits x BUCKETS: log ratios
    trust: np.ndarray  # of each bit, from the training texts' margins
    scale: float  # of the losses, so that scores are posteriors


def codewords(count: int) -> np.ndarray:
    """A row of +1 and -1 for each language: every split of up to five languages, else 10 log2 n splits far apart.

    The splits of more languages come from a fixed seed; of 200 such tables the one with the largest least distance is taken.
    """
    if count == 1:
        return np.ones((1, 1))
    if count <= 5:
        rest = [set(c) for size in range(1, count) for c in combinations(range(1, count), size)]
        return np.array([[1.0 if i not in s else -1.0 for s in rest] for i in range(count)])
    random, best, chosen = np.random.default_rng(5), -1, None
    for _ in range(200):
        table = np.where(random.random((count, int(np.ceil(10 * np.log2(count))))) < 0.5, -1.0, 1.0)
        apart = min(int((table[i] != table[j]).sum()) for i, j in combinations(range(count), 2))
        if apart > best and (np.abs(table.sum(0)) < count).all():
            best, chosen = apart, table
    return chosen


def _letters(table: dict = {}) -> np.ndarray:
    """Flags of bytes that can belong to letters: A-Z, a-z and all bytes beyond ASCII."""
    if not table:
        flags = np.zeros(256, bool)
        flags[65:91] = flags[97:123] = flags[128:] = True
        table["flags"] = flags
    return table["flags"]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each text's words (lower case, a blank on both sides), the first of each text,
    and whether each text has a letter."""
    found = words.split(column, lower=True, letters=_letters())
    sizes = found.ends - found.starts
    ends = np.cumsum(sizes + 1)  # each word with a blank behind it; the blank of the word before stands in front
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 1, 0x20, np.uint32)
    inside = np.repeat(found.starts - (ends - sizes), sizes)
    at = np.arange(len(inside)) + np.repeat(np.arange(len(sizes)) + 1, sizes)
    joined[at] = found.data[at + inside] if len(at) else 0
    first = np.concatenate([[0], ends])[found.word_offsets] if len(ends) else np.zeros(len(column) + 1, np.int64)
    grams, length = [], len(joined) - 1
    joined = np.append(joined, np.uint32(0x20))
    beyond = joined[2:].copy()
    beyond[first[1:][first[1:] > first[:-1]] - 1] = 0x20  # no n-gram reaches into the next text
    shifted = [joined[:length], joined[1 : length + 1], beyond]
    for order in ORDERS:
        value = np.full(length, order, np.uint32)
        for k in range(order):
            value = (value * np.uint32(16777619)) ^ shifted[k]
        value *= np.uint32(2654435761)
        grams.append(value >> np.uint32(16))
    return np.stack(grams), first, np.diff(found.word_offsets) > 0


def _real_letters(texts: pa.Array, flags: np.ndarray) -> np.ndarray:
    """Whether each flagged text really has a letter: bytes beyond ASCII may be signs."""
    out = flags.copy()
    for i in np.flatnonzero(flags):
        text = texts[int(i)].as_py()
        out[i] = any(c.isalpha() for c in text) if text else False
    return out


def _counts(languages: list[str], text: str, label: str):
    """Rows of (language number, bucket counts) of each task: as many as languages, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        number = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            for part in words.slices(batch, text):
                grams, first, _ = features(part.column(text))
                owner = np.repeat([number.get(x, -1) for x in part.column(label).to_pylist()], np.diff(first))
                for order in grams:
                    keys = (owner * BUCKETS + order)[owner >= 0]
                    totals += np.bincount(keys, minlength=totals.size).reshape(totals.shape)
        at, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[at, bucket])], ["language", "bucket", "n"])

    return run


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", most: int = 20_000) -> Model | None:
    """Fit on rows with a label; None if there is none.

    `most` bounds the labelled rows used: those whose keys have the smallest hashes, of each language its share, so at
    most that many on average. What reaches the driver is one sum for each language and bucket.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(key).alias("key"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # one row for each language
    if not sizes:
        return None
    languages = sorted(sizes)
    share = max(most // len(languages), 1)
    limits = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, share / sizes[name])))])
    hashed = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(hashed < limits[F.col("label")]).select("text", "label")
    rows = sample.mapInArrow(_counts(languages, "text", "label"), "language int, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(languages), BUCKETS))
    for r in rows:
        counts[r["language"], r["bucket"]] = r["n"]
    codes = codewords(len(languages))
    rates = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    weights = np.stack([np.log(rates[codes[:, b] > 0].mean(0)) - np.log(rates[codes[:, b] < 0].mean(0) if (codes[:, b] < 0).any() else np.full(BUCKETS, 1 / BUCKETS)) for b in range(codes.shape[1])])
    weights = np.clip(weights, -6, 6)
    margins = rates @ weights.T  # expected margin of each language at each bit
    trust = np.maximum((margins * codes).min(0), 1e-3)
    return Model(languages, codes, weights.astype(np.float32), trust / trust.mean(), 8.0 / max(float(np.abs(margins).mean()), 1e-3))


def _margins(model: Model, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text (row) at each bit."""
    lengths = np.maximum(np.diff(first) * len(grams), 1)
    out = np.zeros((len(first) - 1, model.codes.shape[1]))
    for b, weight in enumerate(model.weights):
        sums = np.zeros(len(first))
        if grams.shape[1]:
            total = weight[grams[0]]
            for order in grams[1:]:
                total = total + weight[order]
            sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])[first]
            out[:, b] = np.diff(sums) / lengths
    return out


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by trusted logistic loss, its posterior, and the posterior's lead over the second."""
    signed = margins[:, None, :] * model.codes[None] * model.scale
    loss = (np.logaddexp(0, -signed) * model.trust).sum(2)
    chance = np.exp(-(loss - loss.min(1, keepdims=True)))
    chance /= chance.sum(1, keepdims=True)
    best = np.argmax(chance, 1)
    ordered = np.sort(chance, 1)
    lead = ordered[:, -1] - (ordered[:, -2] if chance.shape[1] > 1 else 0)
    return best, ordered[:, -1], lead


def identify(docs: DataFrame, model: Model | None, text: str = "text", least_lead: float = 0.1) -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous (the lead over the second language is under least_lead).

    Null texts and texts without a letter are `und` with score 0 and ambiguous; so are all texts without a model.
    Whole texts count. Columns of the added names are replaced; ties go to the language first in order.
    """
    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("ambiguous", T.BooleanType(), False)]
    schema = added(docs, fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bits x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, form = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for part in words.slices(batch, text):
                rows = part.num_rows
                named, score, unsure = np.full(rows, UNKNOWN, object), np.zeros(rows), np.ones(rows, bool)
                if fitted is not None:
                    grams, first, letters = features(part.column(text))
                    letters = _real_letters(part.column(text), letters)
                    best, chance, lead = decode(fitted, _margins(fitted, grams, first))
                    named[letters] = np.array(fitted.languages, object)[best[letters]]
                    score[letters] = chance[letters]
                    unsure[letters] = lead[letters] < least_lead
                made = {"lang_pred": pa.array(named.tolist(), pa.string()), "score": pa.array(score), "ambiguous": pa.array(unsure)}
                yield with_columns(part, form, made)

    return docs.mapInArrow(run, schema)
