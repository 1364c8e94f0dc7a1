"""Mixing to target weights by soft membership, by DataFrame and SQL functions alone.

A classifier learned from labelled rows (Gaussian naive Bayes over a few measures of a text) gives each document a
probability for each domain. Nonnegative document rates r are fitted so that the expected tokens of each domain,
sum of r * tokens * probability, are in proportion to the target weights, while rates stay near one:

    minimise  1/2 |sum_i a_i r_i p_i - w|^2 + ridge/2 sum_i a_i (r_i - 1)^2   over r >= 0,   a_i = tokens_i / all tokens.

Accelerated projected gradient does this, with the step scaled by 1 / a_i for each document. A round needs one sum for
each domain over all documents; the update of a rate follows from its own probabilities and the rounds' residuals, so
rates are folded from these and written only every FOLD rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import stored

FOLD, ROUNDS, RIDGE, TOLERANCE = 8, 64, 1e-3, 1e-4
MEASURES = ("length", "symbols", "capitals", "digits", "new_words", "new_lines", "word_length")
#: Least variance of a measure within a domain.
LEAST_VARIANCE = 1e-4


def measures(text: Column) -> dict[str, Column]:
    """Tokens (words between blanks) of a text and what the classifier looks at. Null texts count as empty."""
    whole = F.coalesce(text, F.lit(""))
    size = F.greatest(F.char_length(whole), F.lit(1))
    parts = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(whole, "\n")
    share = lambda pattern: F.char_length(F.regexp_replace(whole, pattern, "")) / size
    tokens = F.size(parts)
    return {
        "tokens": tokens.cast("bigint"),
        "length": F.log1p(F.char_length(whole).cast("double")),
        "symbols": share(r"[\p{L}\p{N}\s.,]+"),
        "capitals": share(r"[^\p{Lu}]+"),
        "digits": share(r"[^0-9]+"),
        "new_words": F.size(F.array_distinct(parts)) / F.greatest(tokens, F.lit(1)),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "word_length": F.log1p(F.char_length(whole) / F.greatest(tokens, F.lit(1))),
    }


def fit_domains(measured: DataFrame, labelled: DataFrame, key: str, domain: str) -> dict[str, dict[str, tuple[float, float] | float]]:
    """For each domain its share of labelled rows, and mean and variance of every measure. Null domains are left out.

    One row for each domain reaches the driver; all labelled rows count.
    """
    rows = measured.join(labelled.where(F.col(domain).isNotNull()).select(F.col(key).alias("_id"), F.col(domain).cast("string").alias("domain")), measured[key] == F.col("_id"))
    stats = [f(m).alias(f"{n}_{m}") for m in MEASURES for n, f in (("mean", F.avg), ("variance", F.var_pop))]
    found = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"), *stats).collect()
    total = sum(r["rows"] for r in found)
    return {r["domain"]: {"share": r["rows"] / total, **{m: (r[f"mean_{m}"], max(r[f"variance_{m}"], LEAST_VARIANCE)) for m in MEASURES}} for r in found}


def posteriors(model: dict, domains: Sequence[str]) -> Column:
    """Probabilities of the domains, in their order, from the measures. A domain without labelled rows gets 0."""
    logs = []
    for name in domains:
        if name not in model:
            logs.append(F.lit(-1e300))
            continue
        own = model[name]
        terms = [-((F.col(m) - own[m][0]) ** 2) / (2 * own[m][1]) - 0.5 * math.log(own[m][1]) for m in MEASURES]
        logs.append(sum(terms[1:], terms[0]) + math.log(own["share"]))
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = F.transform(F.array(*logs), lambda x: F.exp(F.greatest(x - most, F.lit(-700.0))) * (x > -1e299).cast("double"))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def _fold(residuals: list[tuple[list[float], float]], ridge: float, step: float) -> Column:
    """Rates after more rounds, from r and the one before: each round's residual and momentum are constants."""
    if not residuals:
        return F.struct("r", "before")
    rounds = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in res]).alias("res"), F.lit(float(m)).alias("m")) for res, m in residuals])

    def move(state: Column, turn: Column) -> Column:
        ahead = state["r"] + turn["m"] * (state["r"] - state["before"])
        pull = F.aggregate(F.zip_with("p", turn["res"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.struct(F.greatest(F.lit(0.0), ahead - step * (pull + ridge * (ahead - 1.0))).alias("r"), state["r"].alias("before"))

    return F.aggregate(rounds, F.struct(F.col("r"), F.col("before")), move)


def fit_rates(rows: DataFrame, targets: Sequence[float], rounds: int = ROUNDS, ridge: float = RIDGE, tolerance: float = TOLERANCE) -> DataFrame:
    """Add `rate` to rows of tokens and p (an array of a probability for each target).

    Targets are scaled to sum to one. Ends when no domain's share is further than `tolerance` from where the round before
    put it and the residual has settled, or after `rounds` rounds. Rows without tokens get a rate as well; without any
    tokens all rates are one.
    """
    weights = [t / sum(targets) for t in targets]
    table = rows.withColumns({"r": F.lit(1.0), "before": F.lit(1.0)})
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return rows.withColumn("rate", F.lit(1.0))
    table = stored(table, "rates")
    held: list[tuple[list[float], float]] = []
    step = 1.0 / (1.0 + ridge)  # the largest curvature is at most one: probabilities sum to one
    sums = previous = None
    for turn in range(rounds):
        state = table.withColumn("s", _fold(held, ridge, step))
        found = state.agg(*[F.sum(F.col("tokens") * F.col("s.r") * F.col("p")[k]).alias(f"s{k}") for k in range(len(weights))]).first()
        previous, sums = sums, [x / total for x in found]
        momentum = turn / (turn + 3.0)
        ahead = [s + momentum * (s - q) for s, q in zip(sums, previous or sums)]
        if previous and max(abs(a - b) for a, b in zip(sums, previous)) < tolerance / 10 and max(abs(s - w) for s, w in zip(sums, weights)) < tolerance * 10:
            break
        held.append(([a - w for a, w in zip(ahead, weights)], momentum))
        if len(held) == FOLD:
            table = stored(table.withColumn("s", _fold(held, ridge, step)).withColumns({"r": F.col("s.r"), "before": F.col("s.before")}).drop("s"), "rates")
            held = []
    return table.withColumn("rate", _fold(held, ridge, step)["r"]).drop("r", "before")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id", domain: str = "domain") -> DataFrame:
    """Rows (key, tokens, p, rate) for every row of docs: p has the probabilities of the targets in their order.

    `labelled` has rows of key and domain. Without a labelled row of any target all probabilities are equal. Null and
    empty texts have no tokens. Repeated rows each get a rate. Other columns are not read.
    """
    domains = list(targets)
    measured = stored(docs.select(F.col(key), *[c.alias(n) for n, c in measures(F.col(text)).items()]), "measures")
    model = {k: v for k, v in fit_domains(measured, labelled, key, domain).items() if k in targets}
    chance = posteriors(model, domains) if model else F.array(*[F.lit(1.0 / len(domains)) for _ in domains])
    return fit_rates(measured.select(key, "tokens", chance.alias("p")), list(targets.values()))


def thin(docs: DataFrame, rates: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep each document with its rate, as a share of the largest rate, by a hash of its key: the same every time.

    `rates` has one rate for each key; rows without one are kept.
    """
    most = rates.agg(F.max("rate")).first()[0] or 1.0
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = rates.groupBy(F.col(key).alias("_id")).agg(F.max("rate").alias("_rate"))
    joined = docs.join(kept, docs[key] == F.col("_id"), "left")
    return joined.where(drawn < F.coalesce(F.col("_rate") / most, F.lit(1.0))).select(*[docs[c] for c in docs.columns])
