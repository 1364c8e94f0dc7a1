"""Toxicity: a Levenshtein automaton over a lexicon trie, with windows that tell abuse from quotation.

The lexicon is learned: words, and stems that begin many words, which occur far more often in texts labelled toxic. The
trie of its terms is intersected with the Levenshtein automaton of distance one by subset construction, which gives one
table-driven automaton; all words of a batch step through it together. Each match has a weight, less if it is misspelled;
matches within quotation marks are counted apart, and those near each other add up in a window. A logistic model of
these sums, with a prior that also covers what the labels never show, gives the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from knownat.llm import bpe, words
from knownat.llm.bpe import added, with_columns
from knownat.llm.store import stored

#: Letters of the stems that are tried as terms.
STEMS = (4, 5, 6, 7)
#: Words at least this long may be misspelled; from LONG_WORD letters on a misspelling counts as surer.
FUZZY_WORD, LONG_WORD = 5, 7
#: Words on either side of a match that belong to its window.
WINDOW = 25
EXACT, STEM, NEAR_LONG, NEAR_SHORT = range(1, 5)
#: Prior of the logistic model: bias, then exact, stem, misspelled long and short, quoted, best window, all by words.
PRIOR = np.array([-4.0, 1.0, 1.0, 0.8, 0.0, 0.0, 1.0, 0.0])
#: Texts of fewer words count as having so many, where matches are put in proportion to words.
FEW_WORDS = 100


class Lexicon(NamedTuple):
    terms: list[str]  # a stem ends in *
    weights: np.ndarray
    symbols: np.ndarray  # of each code point; 0: in no term
    moves: np.ndarray  # states x symbols; state 0 is dead, 1 the start
    kinds: np.ndarray  # of the match if a word ends in this state, 0: none
    found: np.ndarray  # its term
    absorbing: np.ndarray  # whether the state holds whatever follows


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray


def compile_lexicon(terms: list[str], weights: list[float]) -> Lexicon:
    """The automaton of all words within distance one of a term, or that begin with a stem."""
    children: list[dict[str, int]] = [{}]
    ends: list[int | None] = [None]
    stems: list[int | None] = [None]
    depth = [0]
    for number, term in enumerate(terms):
        node = 0
        for c in term.rstrip("*"):
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(None)
                stems.append(None)
                depth.append(depth[node] + 1)
            node = children[node][c]
        (stems if term.endswith("*") else ends)[node] = number
    fuzzy = [False] * len(children)  # whether a term that may be misspelled lies below

    def mark(node: int) -> bool:
        below = [mark(x) for x in children[node].values()]
        fuzzy[node] = any(below) or ends[node] is not None and depth[node] >= FUZZY_WORD
        return fuzzy[node]

    mark(0)
    alphabet = sorted({c for t in terms for c in t.rstrip("*")})
    symbol_of = {c: i + 1 for i, c in enumerate(alphabet)}

    def follow(state: frozenset, c: str) -> frozenset:
        out = set()
        for node, wrong in state:
            if (same := children[node].get(c)) is not None:
                out.add((same, wrong))
            if not wrong:
                out.add((node, 1))  # c is one too many
                for d, child in children[node].items():
                    if d != c:
                        out.add((child, 1))  # c stands for d
                    if (skipped := children[child].get(c)) is not None:
                        out.add((skipped, 1))  # d is missing
        return frozenset((n, w) for n, w in out if not w or fuzzy[n] and (n, 0) not in out)

    def match(state: frozenset) -> tuple[int, int]:
        found = [(EXACT, ends[n]) for n, w in state if not w and ends[n] is not None]
        near = [n for n, w in state if w and ends[n] is not None]
        near += [child for n, w in state if not w for child in children[n].values() if ends[child] is not None]  # the last letter is missing
        found += [(NEAR_LONG if depth[n] >= LONG_WORD else NEAR_SHORT, ends[n]) for n in near if depth[n] >= FUZZY_WORD]
        return min(found, key=lambda x: (x[0], -weights[x[1]], x[1]), default=(0, 0))

    start = frozenset({(0, 0)})
    numbers, order, moves, kinds, hits, absorbing = {frozenset(): 0, start: 1}, [frozenset(), start], [], [], [], []
    at = 0
    while at < len(order):
        state = order[at]
        stem = next((stems[n] for n, w in sorted(state) if not w and stems[n] is not None), None)
        absorbing.append(stem is not None)
        kind, term = (STEM, stem) if stem is not None else match(state)
        kinds.append(kind)
        hits.append(term)
        row = [0] * (len(alphabet) + 1)
        for c, i in {"": 0, **symbol_of}.items():
            if stem is not None:
                row[i] = at
            elif state:
                after = follow(state, c)
                if after not in numbers:
                    numbers[after] = len(order)
                    order.append(after)
                row[i] = numbers[after]
        moves.append(row)
        at += 1
    symbols = np.zeros(0x110000, np.uint16)
    for c, i in symbol_of.items():
        symbols[ord(c)] = i
    return Lexicon(terms, np.array(weights), symbols, np.array(moves, np.int32), np.array(kinds, np.int8), np.array(hits, np.int32), np.array(absorbing))


class Letters(NamedTuple):
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first word of each text, one more than texts
    offsets: np.ndarray  # first code point of each text


def letters(column: pa.Array) -> Letters:
    """Words of lower-cased texts: runs of letters and numbers, as positions in their code points."""
    lower = pc.utf8_lower(column.cast(pa.large_string()))
    data, offsets = words.flat(lower)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    offsets = lead[offsets]
    inside = bpe._classes()[points] <= bpe.N
    before, after = np.zeros(len(points), bool), np.zeros(len(points), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    limits = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(points))]
    before[limits], after[limits - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Letters(points, starts, ends, np.searchsorted(starts, offsets), offsets)


def run(lexicon: Lexicon, found: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that match: their numbers, kinds and terms. All words step together; those in the dead state drop out."""
    state = np.ones(len(found.starts), np.int32)
    alive, at = np.arange(len(state)), 0
    sizes = found.ends - found.starts
    while len(alive):
        going = alive[sizes[alive] > at]
        going = going[~lexicon.absorbing[state[going]]]
        state[going] = lexicon.moves[state[going], lexicon.symbols[found.points[found.starts[going] + at]]]
        alive = going[state[going] > 0]
        at += 1
    hit = np.flatnonzero(lexicon.kinds[state] > 0)
    return hit, lexicon.kinds[state[hit]], lexicon.found[state[hit]]


def _quoted(points: np.ndarray, low: int, high: int, start: int, end: int) -> bool:
    """Whether start..end stands within quotation marks of its line of the text low..high."""
    before, after = points[low:start], points[end:high]
    lines = np.flatnonzero(before == 10)
    before = before[lines[-1] + 1 :] if len(lines) else before
    lines = np.flatnonzero(after == 10)
    after = after[: lines[0]] if len(lines) else after
    if np.count_nonzero(before == 0x22) % 2 and (after == 0x22).any():
        return True
    return any(np.count_nonzero(before == a) > np.count_nonzero(before == b) and (after == b).any() for a, b in ((0x201C, 0x201D), (0xAB, 0xBB), (0x201E, 0x201C)))


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row for each text: 1, then log(1 + weight) of exact, stem, misspelled long, misspelled short and quoted matches,
    of the heaviest window, and of all but short misspelled ones in 1000 words. Quoted matches count only as such."""
    found = letters(column)
    hit, kind, term = run(lexicon, found)
    out = np.zeros((len(column), 8))
    out[:, 0] = 1
    doc = np.searchsorted(found.first, hit, "right") - 1
    for text in np.unique(doc):
        own = np.flatnonzero(doc == text) if len(hit) < 64 else slice(*np.searchsorted(doc, [text, text + 1]))
        place, kinds, weight = hit[own], kind[own], lexicon.weights[term[own]] * np.where(kind[own] >= NEAR_LONG, 0.5, 1.0)
        low, high = found.offsets[text], found.offsets[text + 1]
        quoted = np.array([_quoted(found.points, low, high, found.starts[w], found.ends[w]) for w in place])
        for k in range(EXACT, NEAR_SHORT + 1):
            out[text, k] = weight[(kinds == k) & ~quoted].sum()
        out[text, 5] = weight[quoted].sum()
        bare = (kinds != NEAR_SHORT) & ~quoted
        sums = np.concatenate([[0], np.cumsum(weight[bare])])
        if bare.any():
            spots = place[bare]
            out[text, 6] = (sums[np.searchsorted(spots, spots + WINDOW, "right")] - sums[np.searchsorted(spots, spots - WINDOW)]).max()
    out[:, 7] = 1000 * out[:, 1:4].sum(1) / np.maximum(np.diff(found.first), FEW_WORDS)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one task's rows: in how many toxic and clean texts a word or stem occurs, and how often."""
    texts, toxic, clean, clean_texts = Counter(), Counter(), Counter(), Counter()
    for batch in batches:
        for part in words.slices(batch, "text"):
            found = letters(part.column("text"))
            text = found.points.tobytes().decode("utf-32-le")
            pairs = list(zip(found.starts.tolist(), found.ends.tolist()))
            for i, label in enumerate(part.column("label").to_pylist()):
                own = Counter(text[a:b] for a, b in pairs[found.first[i] : found.first[i + 1]])
                for word, n in list(own.items()):
                    for k in STEMS:
                        if len(word) > k:
                            own[word[:k] + "*"] += n
                (toxic if label else clean).update(own)
                (texts if label else clean_texts).update(own.keys())
    terms = list(toxic.keys() | clean.keys())
    counts = [pa.array([c[t] for t in terms], pa.int64()) for c in (texts, toxic, clean, clean_texts)]
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], ["term", "texts", "toxic", "clean", "clean_texts"])


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int, most: int | None = None) -> tuple[list[str], list[float]]:
    """Of (term, occurrences in toxic texts, in clean texts) the `most` that tell most, with their log odds, given the words
    of either kind of text. Of terms that begin with each other only the most telling stays, but for words of FUZZY_WORD
    letters or more: these stand beside their stem and do not count towards `most`, as a stem is never misspelled."""
    weight = {t: float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))) for t, a, b in rows}
    telling = {t: a * weight[t] - (a + b) * np.log((1 + np.exp(weight[t])) / 2) * 0.5 for t, a, b in rows}
    chosen: list[str] = []
    stems, within = set(), set()
    order = sorted(weight, key=lambda t: (-telling[t], t))
    for term in order:
        bare = term.rstrip("*")
        starts = {bare[:k] for k in STEMS if len(bare) >= k}
        if starts & stems or (term.endswith("*") and bare in within):
            continue
        if len(chosen) == most:
            break
        chosen.append(term)
        within |= starts
        if term.endswith("*"):
            stems.add(bare)
    held = set(chosen)
    chosen += [t for t in order if len(t) >= FUZZY_WORD and t[-1] != "*" and t not in held and any(t[:k] in stems for k in STEMS)]
    return chosen, [weight[t] for t in chosen]


def fit(docs: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most: int = 20_000, support: int = 10, odds: float = 8.0, most_terms: int = 500) -> Model:
    """Learn from rows whose label is 0 or 1.

    `most` bounds the labelled rows used, on average: those whose keys have the smallest hashes. A term must occur in
    `support` toxic texts (in an eighth of them, but at least three, if there are few), and `odds` times as often among the words of toxic as of clean texts (and in half
    as many times more texts); the `most_terms` most
    telling are kept, and the words beside their stems. Without labels the lexicon is empty and every text gets the prior's score.
    """
    known = docs.where(F.col(label).isin(0, 1) & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(key).alias("key"))
    rows = docs.where(F.col(label).isin(0, 1)).count()
    share = min(1.0, most / max(rows, 1))
    sample = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "label")
    counted = sample.mapInArrow(_terms, "term string, texts bigint, toxic bigint, clean bigint, clean_texts bigint").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("texts", "toxic", "clean", "clean_texts")])
    counted = stored(counted, "terms")
    bare = counted.where(~F.col("term").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first()  # words of either kind
    toxic, clean = bare[0] or 0, bare[1] or 0
    often = (F.col("toxic") + 0.5) / (toxic + 1) >= odds * (F.col("clean") + 0.5) / (clean + 1)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    spread = (F.col("texts") + 0.5) / (sizes.get(1, 0) + 1) >= odds / 2 * (F.col("clean_texts") + 0.5) / (sizes.get(0, 0) + 1)
    enough = max(3, min(support, sizes.get(1, 0) // 8))
    top = counted.where((F.col("texts") >= enough) & often & spread).orderBy(F.desc("toxic"), "term").limit(20 * most_terms)
    terms, weights = choose_terms([tuple(r) for r in top.select("term", "toxic", "clean").collect()], toxic, clean, most_terms)
    lexicon = compile_lexicon(terms, weights)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                made = features(part.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([part.column("label"), *[pa.array(made[:, k]) for k in range(1, 8)]], ["label", *[f"x{k}" for k in range(1, 8)]])

    kinds = ", ".join(f"x{k} double" for k in range(1, 8))
    table = sample.mapInArrow(rows_of, f"label int, {kinds}")
    table = table.groupBy(*table.columns).count().collect()  # of at most about `most` rows
    x = np.array([[1.0, *r[1:8]] for r in table]).reshape(-1, 8)
    return Model(lexicon, _logistic(x, np.array([r[0] for r in table], float), np.array([r[8] for r in table], float)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Newton's method for the posterior mode under a normal prior of variance one around PRIOR."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """Add the probability that a text is toxic. Null and empty texts get that of a text without matches.

    Whole texts count; rows are independent. A column of the added name is replaced.
    """
    schema = added(docs, [T.StructField(output, T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_terms terms

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, form = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for part in words.slices(batch, text):
                logit = features(part.column(text), fitted.lexicon) @ fitted.weights
                yield with_columns(part, form, {output: pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))})

    return docs.mapInArrow(scored, schema)
