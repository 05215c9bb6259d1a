"""Headline queries, timed one after the other; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factlode.catalog import QUERIES  # noqa: E402
from factlode.session import build_session  # noqa: E402

HEADLINE = (
    "e1_choose_fact", "i12_financial_history", "i6_signals", "a7_upsert_by_key", "f4_newest_filings", "f8_resolve_identity",
    "j2_html_to_text", "i8_filing_chunks", "i14_claim_audit", "g1_metric_union", "a1_read_companyfacts", "d1_quality_score",
    "g2_findings_union", "i4_forensic_tests", "i5_anomalies", "i7_peer_context", "i9_search",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
