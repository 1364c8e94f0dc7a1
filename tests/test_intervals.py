"""Facts as known at a moment, against brute force, with one company that holds most of them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from knownat.operators import fundamentals as FU

SCHEMA = "cik string, taxonomy string, concept string, period_start date, period_end date, normalized_numeric_value double, form_type string, accession_no string, accepted_at timestamp_ntz"
SHARES = FU.CONCEPTS["shares_outstanding"]


def made(n, seed):
    source, rows = random.Random(seed), []
    for i in range(n):
        cik = "big" if i % 10 else f"c{source.randrange(4)}"
        end = dt.date(2000, 1, 1) + dt.timedelta(days=source.randrange(0, 6000))
        at = dt.datetime(2000, 1, 1) + dt.timedelta(days=source.randrange(0, 7000), seconds=source.randrange(3))
        taxonomy, concept = source.choice(SHARES).split(":")
        value = source.choice([-5.0, 0.0, None]) if i % 9 == 0 else float(source.randrange(1, 10**6))
        rows.append((cik, taxonomy, concept, None, end, value, "10-K", f"A{i}", at if i % 13 else None))
    return rows


def rank(row):
    return -SHARES.index(f"{row[1]}:{row[2]}")


def test_instant_of_a_company_with_20000_facts(spark):
    rows = made(22000, 1)
    source = random.Random(2)
    asked = {(source.choice(["big", "big", "c0", "c1", "none"]), dt.date(2000, 1, 1) + dt.timedelta(days=source.randrange(6000)), dt.datetime(2000, 1, 1) + dt.timedelta(days=source.randrange(8000))) for _ in range(250)}
    asked |= {(r[0], r[4], r[8]) for r in rows[1:40] if r[8]}  # on the very day, at the very second
    grid = spark.createDataFrame(sorted(asked), "cik string, period_end date, knowledge_date timestamp_ntz")
    facts = FU.stated_values(FU.mapped_facts(spark.createDataFrame(rows, SCHEMA), FU.concept_mapping(spark)))
    got = FU.instant_as_of(grid, facts, "shares_outstanding", {"then": F.col("period_end"), "now": F.col("knowledge_date").cast("date")}).collect()
    assert len(got) == len(asked)
    usable = [r for r in rows if r[8] is not None and r[5] is not None and r[5] > 0]
    for g in got:
        for name, day in (("then", g["period_end"]), ("now", g["knowledge_date"].date())):
            known = [r for r in usable if r[0] == g["cik"] and r[4] <= day and r[8] <= g["knowledge_date"]]
            best = max(known, key=lambda r: (rank(r), r[4], r[8], r[7]), default=None)
            want = None if best is None else (best[5], f"{best[1]}:{best[2]}", best[7])
            assert (None if g[name] is None else tuple(g[name])) == want


def test_inputs_of_a_period_with_many_states(spark):
    source, rows = random.Random(3), []
    ends = [dt.date(2001, 12, 31), dt.date(2002, 12, 31)]
    for i in range(3000):
        name = source.choice(["assets", "cash", "short_term_debt", "revenue"])
        taxonomy, concept = source.choice(FU.CONCEPTS[name]).split(":")
        end = ends[i % 2]
        start = dt.date(end.year, 1, 1) if name == "revenue" and i % 5 else None
        rows.append((f"c{i % 3}", taxonomy, concept, start, end, float(i) if i % 17 else None, "10-K", f"A{i:05}", dt.datetime(2002, 1, 1) + dt.timedelta(hours=source.randrange(900))))
    stated = FU.stated_values(FU.mapped_facts(spark.createDataFrame(rows, SCHEMA), FU.concept_mapping(spark)))
    grid = FU.prior_period(FU.annual_ends(stated), FU.annual_ends(stated)).join(FU.knowledge_states(stated), ["cik", "period_end"])
    got = FU.resolve_inputs(grid, stated, ["assets", "cash", "short_term_debt", "revenue"], ["assets", "revenue"]).collect()
    states = {(r[0], r[4], r[8]) for r in rows if r[5] is not None}
    assert {(g["cik"], g["period_end"], g["knowledge_date"]) for g in got} == states and len(got) == len(states)
    for g in got[::7]:
        for column in ("assets", "cash", "short_term_debt", "revenue", "prior_assets", "prior_revenue"):
            name, end = column.removeprefix("prior_"), g["prior_end"] if column.startswith("prior_") else g["period_end"]
            concepts = FU.CONCEPTS[name]
            known = [
                r for r in rows if r[5] is not None and r[0] == g["cik"] and r[4] == end and r[8] <= g["knowledge_date"] and f"{r[1]}:{r[2]}" in concepts
                and (r[3] is not None) == (name == "revenue")
            ]
            best = max(known, key=lambda r: (-concepts.index(f"{r[1]}:{r[2]}"), r[8], r[7]), default=None)
            assert (None if g[column] is None else tuple(g[column])) == (None if best is None else (best[5], f"{best[1]}:{best[2]}", best[7]))
