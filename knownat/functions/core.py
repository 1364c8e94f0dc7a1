"""Shared scalar expressions: guarded arithmetic, hashes, time, text keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def ratio(num, den) -> Column:
    """num / den, NULL for a zero or missing denominator (ANSI mode would raise)."""
    num, den = col(num), col(den)
    return F.when(den != 0, num / den)


def clamp(value, low, high) -> Column:
    """Least/greatest skip NULL in Spark, so a NULL input is kept NULL here."""
    value = col(value)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def first_match(*rules: tuple[Column, object], otherwise=None) -> Column:
    """CASE chain: the value of the first rule that holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def lenient_number(value) -> Column:
    """Comma-stripped double, NULL for text that is not a number."""
    return F.regexp_replace(col(value).cast("string"), ",", "").try_cast("double")


def form4_number(value) -> Column:
    """As lenient_number, also without a currency sign."""
    return F.regexp_replace(col(value).cast("string"), "[,$]", "").try_cast("double")


def pad_cik(value) -> Column:
    """Ten digits; longer identifiers stay whole."""
    text = col(value).cast("string")
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def sec_symbol(value) -> Column:
    """Exchange symbol in the regulator's and vendor's spelling."""
    return F.replace(F.replace(F.upper(col(value)), F.lit("$"), F.lit("-P")), F.lit("."), F.lit("-"))


def document_url(cik, accession, document) -> Column:
    """Archive address of a filing document; NULL without a file name."""
    name = F.nullif(F.regexp_replace(col(document), "^xsl[^/]*/", ""), F.lit(""))
    return F.when(
        name.isNotNull(),
        F.concat_ws(
            "/",
            F.lit("https://www.sec.gov/Archives/edgar/data"),
            col(cik).cast("bigint").cast("string"),
            F.replace(col(accession), F.lit("-"), F.lit("")),
            name,
        ),
    )


def acceptance_time(value) -> Column:
    """Filing acceptance text as a UTC timestamp; too short means unknown."""
    text = F.replace(F.trim(col(value).cast("string")), F.lit(" "), F.lit("T"))
    text = F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"\..*$", "")
    return F.when(
        F.length(text) >= 19,
        F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
    )


def session_close_utc(day) -> Column:
    """16:00 Eastern of a trading date in UTC, summer time aware."""
    local = col(day).cast("date").cast("timestamp_ntz") + F.expr("INTERVAL 16 HOURS")
    return F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), local)


def end_of_day(day) -> Column:
    """Last second of a date: the knowledge cutoff for that date."""
    return col(day).cast("date").cast("timestamp_ntz") + F.expr("INTERVAL 86399 SECONDS")


def hours_between(earlier, later) -> Column:
    """Elapsed hours, never negative, NULL when either side is unknown."""
    seconds = F.timestamp_diff("SECOND", col(earlier), col(later))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds / F.lit(3600.0)))


def whole_months(start, end) -> Column:
    """Calendar months completed between two dates, floored at zero."""
    months = F.timestamp_diff("MONTH", col(start).cast("date"), col(end).cast("date"))
    return F.when(months.isNotNull(), F.greatest(F.lit(0).cast("bigint"), months))


def sha256(*parts, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *[col(p).cast("string") for p in parts]), 256)


def short_id(prefix: str, *parts) -> Column:
    """Deterministic id: prefix and the first 24 hex digits of the joined key."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256(*parts), 1, 24))


def canonical_json(**fields) -> Column:
    """Compact JSON with sorted keys and NULLs kept."""
    items = [col(fields[name]).alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*items), {"ignoreNullFields": "false"})


def context_hash(context_type, period_start, period_end, dimensions) -> Column:
    return F.sha2(
        canonical_json(
            context_type=context_type,
            period_start=period_start,
            period_end=period_end,
            dimensions_json=dimensions,
        ),
        256,
    )


def semantic_hash(taxonomy, concept, unit, context_type, period_start, period_end, dimensions) -> Column:
    """Identity of what a fact says, apart from which filing said it."""
    return F.sha2(
        canonical_json(
            taxonomy=taxonomy,
            concept=concept,
            unit=unit,
            context_type=context_type,
            period_start=period_start,
            period_end=period_end,
            dimensions_json=dimensions,
        ),
        256,
    )


def canonical_text(value, kind: str = "string") -> Column:
    """One spelling per value for row hashes: 3.0 reads 3, NULL reads null."""
    value = col(value)
    text = value.cast("string")
    if kind == "double":
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        plain = F.regexp_replace(
            text.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"
        )
        text = F.when(whole, value.try_cast("bigint").cast("string")).otherwise(F.coalesce(plain, text))
    return F.coalesce(text, F.lit("null"))


def row_hash(columns: Sequence[tuple[str, str]]) -> Column:
    """Tamper hash over named columns in the given order; (name, kind) pairs."""
    lines = [F.concat(F.lit(f"{name}="), canonical_text(name, kind)) for name, kind in columns]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def money_text(value) -> Column:
    """1234567 as 1.23M."""
    value = col(value)
    size = F.abs(value)
    scaled = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    return first_match(
        *[(size >= cut, F.concat(F.format_number(value / cut, 2), F.lit(mark))) for cut, mark in scaled],
        otherwise=F.format_number(value, 0),
    )


def wilson(wins, n, z: float = 1.959963985) -> Column:
    """95 % score interval of a proportion, clamped to [0, 1]; NULL for n = 0."""
    wins, n = col(wins).cast("double"), col(n).cast("double")
    p, z2 = wins / n, z * z
    scale = 1 + z2 / n
    mid = p + z2 / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(
        n > 0,
        F.struct(
            F.greatest(F.lit(0.0), (mid - margin) / scale).alias("lower"),
            F.least(F.lit(1.0), (mid + margin) / scale).alias("upper"),
            (mid / scale).alias("center"),
        ),
    )


def clean_split_ratio(value, tolerance: float = 1e-6, max_denominator: int = 20) -> Column:
    """True when the ratio (or its reciprocal below one) is a small fraction."""
    value = col(value)

    def near_fraction(x: Column) -> Column:
        return F.exists(
            F.sequence(F.lit(1), F.lit(max_denominator)),
            lambda q: F.abs(x - F.round(x * q) / q) <= tolerance,
        )

    return F.coalesce(
        (value > 0)
        & ~F.isnan(value)
        & (near_fraction(value) | ((value < 1) & near_fraction(F.lit(1.0) / F.nullif(value, F.lit(0.0))))),
        F.lit(False),
    )
