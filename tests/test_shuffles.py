"""Facts stay with their company: what is derived from them crosses no further shuffle."""

from __future__ import annotations

import contextlib
import io
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factlode.operators import forensics, metrics, normalize
from factlode.sources import adapters


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    rows = [
        (key, date(1996 + q // 4, 3 * (q % 4) + 1, 5 + n), Decimal(n * 10 + key), Decimal("0.05"), Decimal("0.02"), Decimal(n), "RAN"[n % 3])
        for key in (1, 2, 9, 13) for q in range(8) for n in range(1, 5)]
    money = "decimal(15,2)"
    frame = spark.createDataFrame(rows, (
        f"l_suppkey bigint, l_shipdate date, l_extendedprice {money}, l_discount {money}, l_tax {money}, l_quantity {money}, l_returnflag string"))
    frame.write.parquet(f"{folder}/lineitem.parquet")
    return adapters.raw_facts(spark, folder)


def _plan(frame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain()
    return text.getvalue()


def _shuffles(frame) -> int:
    return _plan(frame).count("Exchange hashpartitioning")


def test_facts_results_and_series_add_no_shuffle(raw):
    made = _shuffles(raw)
    candidates = normalize.classify_candidates(raw)
    chosen = normalize.choose_facts(candidates)
    assert _shuffles(chosen) == made
    results = metrics.metric_results(normalize.normalized_facts(chosen))
    assert _shuffles(results) == made
    assert _shuffles(forensics.anomalies(results)) == made
    assert _shuffles(forensics.forensic_tests(results)) == made


def test_links_of_duplicates_come_without_a_join(raw):
    candidates = normalize.classify_candidates(raw)
    chosen = normalize.choose_facts(candidates)
    links = normalize.finding_facts(candidates, chosen)
    plan = _plan(links)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    linked = {r.finding_id: r.n for r in links.groupBy("finding_id").agg(F.count("fact_id").alias("n")).collect()}
    duplicates = {r.finding_id: r.affected_count for r in normalize.duplicate_findings(chosen).collect()}
    assert duplicates and duplicates == {k: linked.get(k) for k in duplicates}


def test_rows_dealt_by_anything_give_the_same_results(raw):
    facts = normalize.normalized_facts(normalize.choose_facts(normalize.classify_candidates(raw)))
    columns = ["metric_result_id", "status", "value"]
    dealt = metrics.metric_results(facts).select(*columns).collect()
    scattered = metrics.metric_results(facts.repartition(5, "normalized_fact_id")).select(*columns).collect()
    assert dealt and sorted(map(str, dealt)) == sorted(map(str, scattered))


def test_tasks_follow_the_rows_and_lines_are_summed_once(spark, raw, monkeypatch):
    """A task holds as many quarter rows whatever the files are cut into, and no part of a query reads the line items again."""
    monkeypatch.setattr(adapters, "QUARTERS_PER_TASK", 4)
    quarters = spark.range(0, 200, 1, 1).selectExpr("lpad(CAST(id AS STRING), 10, '0') AS cik", "id AS n")
    dealt = adapters.by_company(quarters)
    assert dealt.rdd.getNumPartitions() == 50
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, quarters.collect()))
    summary = normalize.summary_counts(raw, normalize.choose_facts(normalize.classify_candidates(raw)))
    assert "lineitem" not in _plan(summary) and "l_suppkey" not in _plan(summary)
