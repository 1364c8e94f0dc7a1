"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from knownat.plans import QUERIES  # noqa: E402
from knownat.session import get_spark  # noqa: E402

HEADLINE = (
    "bars_daily", "adv_trailing", "atr14", "asof_price", "trading_weeks", "wilson", "batch_summary", "filing_class",
    "going_concern", "composite_rank", "suppressions", "drawdown", "insider_cluster", "symbol_at_date", "pct_midrank",
    "split_adjusted", "relative_strength",
)


#: Timed as well, outside the total, which stays comparable with earlier rounds.
MORE = (
    "amendment_link", "asof_pit_fact", "restatements", "facts_summary", "derived_fundamentals", "barrier_exit", "benchmark_pair", "html_text",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_daily"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE + MORE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds[name] for name in HEADLINE), 3)
    more = {name: seconds.pop(name) for name in MORE}
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "more": more, "sf": folder}))


if __name__ == "__main__":
    main()
