"""Language-model scores from a weighted backoff automaton that no task holds as a whole.

The model has a state for each word and one for no context. An arc from state v by word w weighs
log10 (c(vw) + mu P(w)) / (c(v) + mu); where a bigram was never seen, the failure arc of v, of weight log10 mu / (c(v) + mu),
leads to the state without context, whose arcs weigh log10 P(w) = log10 (c(w) + 1) / (N + V + 1). mu is fitted so that
failure arcs together get the share of bigrams seen once, the Good-Turing estimate of what is unseen.

Counts grow with the corpus, so they stay dealt out in shards. Texts are dealt out in blocks; each block asks every shard
for the counts of its distinct words and bigrams, and at the same time brings its own training counts. Shards add up
what all blocks brought and answer in the order of the question. A block then holds all arcs its texts can take: the
log-probabilities of all its words are looked up at once and added up by text.

Keys are parts of 64-bit hashes: within a shard 56 bits for words and 48 for bigrams. As shards grow in number with the
corpus and not in size, the chance that two keys of a shard agree stays below one in 10^8 for a bigram.

The automaton is of order 2, so the state is the previous word; `walk` evaluates it in closed form over arrays, and no states
or arcs are built. Contexts longer than one word are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm import words

#: Rows of a block, and rows for each shard of counts.
BLOCK_ROWS, SHARD_ROWS = 1000, 4000
#: Fixed hashes of the end of a text and of the state before its first word.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
WORD, PAIR = 0, 1
KEY_BYTES = {WORD: 7, PAIR: 6}
LEVELS = 64


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, of the token before each (START at first), and the first token of
    each text. A-Z count as a-z; a null text has only its end."""
    found = words.split(column, lower=True)
    first = found.word_offsets + np.arange(len(found.word_offsets))
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(found.docs)) + found.docs] = words.hashes(found)
    before = np.empty(len(out), np.uint64)
    before[1:], before[first[:-1]] = out[:-1], START
    return out, before, first


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


COUNT_BYTES = 6


def _packed(values: np.ndarray, size: int) -> bytes:
    """The low bytes of values, one plane after the other, as high bytes of counts and of sorted keys compress well."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    return np.ascontiguousarray(planes.T).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u8")


def _cut(keys: np.ndarray, kind: int, shards: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """For keys in the order of _ordered: each shard, where its keys lie, and their low bytes."""
    shard = _shard(keys, shards)
    limits = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip(np.append(0, limits), np.append(limits, len(keys))):
        if b > a:
            yield int(shard[a]), slice(int(a), int(b)), keys[a:b] & np.uint64((1 << (8 * KEY_BYTES[kind])) - 1)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _distinct(keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, so that shards lie together, and the place of each key among them."""
    # the shard comes from the upper bits and the key from the lower ones, so mixed values serve both
    return np.unique(words.mix(keys ^ np.uint64(kind)), return_inverse=True)


def _questions(shards: int):
    """Of each block, for every shard: its distinct keys, and how often they occur in the block's training texts."""

    def run(block: pa.Table) -> pa.Table:
        column, trains = block.column("text").combine_chunks(), block.column("trains").to_numpy()
        now, before, first = tokens(column)
        learned = np.repeat(trains, np.diff(first))
        rows = []
        for kind, keys in ((WORD, now), (PAIR, pair_keys(before, now))):
            unique, place = _distinct(keys, kind)
            counts = np.bincount(place[learned], minlength=len(unique))
            for shard, where, low in _cut(unique, kind, shards):
                rows.append((shard, kind, _packed(low, KEY_BYTES[kind]), _packed(counts[where], COUNT_BYTES)))
        shard, kinds, asked, brought = zip(*rows) if rows else ((), (), (), ())
        number = block.column("block")[0].as_py()
        return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array([number] * len(rows), pa.int32()), "kind": pa.array(kinds, pa.int8()), "keys": pa.array(asked, pa.binary()), "counts": pa.array(brought, pa.binary())})

    return run


def _add_up(table: pa.Table, kind: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Blocks that ask for one kind, their keys, and all distinct keys with their sums."""
    own = table.filter(pa.compute.equal(table.column("kind"), kind)).sort_by("block")
    blocks = own.column("block").to_pylist()
    keys = [_unpacked(x, KEY_BYTES[kind]) for x in own.column("keys").to_pylist()]
    counts = [_unpacked(x, COUNT_BYTES) for x in own.column("counts").to_pylist()]
    if not keys:
        return [], [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    return blocks, keys, unique, np.bincount(place, np.concatenate(counts).astype(float), len(unique)).astype(np.int64)


def _answers(table: pa.Table) -> pa.Table:
    rows = []
    shard = table.column("shard")[0].as_py()
    for kind in (WORD, PAIR):
        blocks, keys, unique, sums = _add_up(table, kind)
        rows += [(b, shard, kind, _packed(sums[np.searchsorted(unique, k)], COUNT_BYTES)) for b, k in zip(blocks, keys)]
    block, shards, kinds, counts = zip(*rows)
    return pa.table({"block": pa.array(block, pa.int32()), "shard": pa.array(shards, pa.int32()), "kind": pa.array(kinds, pa.int8()), "counts": pa.array(counts, pa.binary())})


def _statistics(table: pa.Table) -> pa.Table:
    """Of one shard: training tokens and distinct words, bigrams and those seen once, and tokens by the logarithm of
    their word's count."""
    _, _, _, once = _add_up(table, WORD)
    once = once[once > 0]
    _, _, _, pairs = _add_up(table, PAIR)
    pairs = pairs[pairs > 0]
    levels = np.bincount(np.log2(once).astype(int), once, LEVELS).astype(np.int64) if len(once) else np.zeros(LEVELS, np.int64)
    return pa.table({"n": [int(once.sum())], "v": [len(once)], "pairs": [int(pairs.sum())], "single": [int((pairs == 1).sum())], "levels": pa.array([levels], pa.list_(pa.int64()))})


def fit_mu(pairs: int, single: int, levels: np.ndarray) -> float:
    """mu at which failure arcs get the share single / pairs, over tokens by the count of the word before (by halving)."""
    if not pairs or not levels.sum():
        return 1.0
    wanted = min(max(single / pairs, 1e-6), 1 - 1e-6)
    counts = 1.5 * 2.0 ** np.arange(LEVELS)
    low, high = 1e-6, 1e15
    for _ in range(200):
        mu = np.sqrt(low * high)
        share = (levels * (mu / (counts + mu))).sum() / levels.sum()
        low, high = (mu, high) if share < wanted else (low, mu)
    return float(np.sqrt(low * high))


def walk(now: np.ndarray, before: np.ndarray, pairs: np.ndarray, starts: int, n: int, v: int, mu: float, first_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the arcs that one pass over the tokens takes, and those of the state without context alone.

    `now` and `before` are the counts of each token and of the one before it (`starts` at the first), `pairs` of both
    together. The state after a token is that token's own, so all steps of a block can be taken at once.
    """
    alone = (now + 1.0) / (n + v + 1.0)
    state = np.where(first_of, starts, before).astype(float)
    arc = np.log10((pairs + mu * alone) / (state + mu))
    failure = np.log10(mu / (state + mu)) + np.log10(alone)
    return np.where(pairs > 0, arc, failure), np.log10(alone)


def _scores(shards: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        column = block.column("text").combine_chunks()
        now, before, first = tokens(column)
        counts = {}
        for kind, keys in ((WORD, now), (PAIR, pair_keys(before, now))):
            unique, place = _distinct(keys, kind)
            own = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            known = dict(zip(own.column("shard").to_pylist(), own.column("counts").to_pylist()))
            found = np.zeros(len(unique), np.int64)
            for shard, where, _ in _cut(unique, kind, shards):
                found[where] = _unpacked(known[shard], COUNT_BYTES)
            counts[kind] = found[place]
        facts = {c: answers.column(c)[0].as_py() for c in ("n", "v", "pairs", "single", "levels")}
        mu = fit_mu(facts["pairs"], facts["single"], np.array(facts["levels"]))
        ends = first[1:] - 1
        first_of = np.zeros(len(now), bool)
        first_of[first[:-1]] = True
        word = counts[WORD]
        previous = np.concatenate([[0], word[:-1]])
        starts = int(word[ends[0]])  # a text starts as often as it ends
        arc, alone = walk(word, previous, counts[PAIR], starts, facts["n"], facts["v"], mu, first_of)
        sums = [np.add.reduceat(x, first[:-1]) for x in (arc, alone, (word > 0).astype(np.int64))]
        made = {"n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": pa.array(sums[2], pa.int64()), "train_tokens": pa.array([facts["n"]] * block.num_rows, pa.int64()), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])}
        return pa.table({"doc_id": block.column("doc_id"), "held_out": block.column("held_out"), **made})

    return run


def score(docs: DataFrame, held_out: str = "held_out", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs.

    Rows whose held_out is not true are the training texts; every row is scored, with its own counts in the model if it was
    trained on. base_score is the unigram model's, score the automaton's log10 probability of the whole text with
    its end. Null texts count as empty, in training too. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(held_out).alias("held_out"))
    count = rows.count()
    blocks, shards = max(count // BLOCK_ROWS, 1), max(count // SHARD_ROWS, 16)
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = rows.select("doc_id", "text", "held_out", (~F.coalesce("held_out", F.lit(False))).alias("trains"), number.alias("block"))
    dealt = dealt.repartition(max(blocks // 8, 1), "block")
    asked = dealt.groupBy("block").applyInArrow(_questions(shards), "shard int, block int, kind tinyint, keys binary, counts binary")
    gathered = asked.repartition(shards, "shard")
    facts = gathered.groupBy("shard").applyInArrow(_statistics, "n bigint, v bigint, pairs bigint, single bigint, levels array<bigint>")
    levels = F.array(*[F.sum(F.col("levels")[i]) for i in range(LEVELS)])
    facts = facts.agg(*[F.sum(c).alias(c) for c in ("n", "v", "pairs", "single")], levels.alias("levels"))  # one row
    answers = gathered.groupBy("shard").applyInArrow(_answers, "block int, shard int, kind tinyint, counts binary").crossJoin(F.broadcast(facts))
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(shards), schema)
