"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlode.functions import ids, periods, text
from factlode.functions.html import html_to_text
from factlode.functions.stemming import porter
from factlode.operators import (
    audit, company, evidence, filings_text, forensics, history, metrics, normalize, peers, quality, retrieval,
)
from factlode.operators.search_index import SearchIndex
from factlode.plans.analysis import analyze
from factlode.session import cut_lineage
from factlode.sources import adapters, payloads, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WINDOW = (date(1994, 1, 1), date(1996, 12, 31))
PEER_POLICY = peers.PeerPolicy(2, Decimal("0.8"), Decimal("0.5"), Decimal("2"))
SEARCH_TEXT = "customer#00000001"
PAGE_HOSTS = ("blog.tionsh.example.net", "www.ththhe.example.com")
SCREEN_PHRASES = ("the of", "and the", "de la", "und der")


class Inputs:
    """Frames that queries start from, made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return adapters.raw_facts(self.spark, self.sf)

    @cached_property
    def candidates(self) -> DataFrame:
        return normalize.classify_candidates(self.raw)

    @cached_property
    def chosen(self) -> DataFrame:
        return normalize.choose_facts(self.candidates)

    @cached_property
    def facts(self) -> DataFrame:
        return normalize.normalized_facts(self.chosen)

    @cached_property
    def findings(self) -> DataFrame:
        return normalize.findings(self.raw, self.candidates, self.chosen)

    @cached_property
    def results(self) -> DataFrame:
        return metrics.metric_results(self.facts)

    @cached_property
    def tests(self) -> DataFrame:
        return forensics.forensic_tests(self.results)

    @cached_property
    def anomalies(self) -> DataFrame:
        return forensics.anomalies(self.results)

    @cached_property
    def signals(self) -> DataFrame:
        return forensics.ranked_signals(self.results)

    @cached_property
    def signal_table(self) -> DataFrame:
        """Signals as the written table that retrieval and audit start from."""
        return cut_lineage(self.signals)

    @cached_property
    def companies(self) -> DataFrame:
        return adapters.companies(self.spark, self.sf)

    @cached_property
    def directory(self) -> DataFrame:
        return adapters.directory(self.spark, self.sf)

    @cached_property
    def filings(self) -> DataFrame:
        return adapters.filings(self.spark, self.sf)

    @cached_property
    def documents(self) -> DataFrame:
        frame = adapters.filing_texts(self.spark, self.sf)
        return frame.withColumn("body", text.clean_text(F.col("body")))

    @cached_property
    def chunks(self) -> DataFrame:
        return filings_text.filing_chunks(self.documents)

    @cached_property
    def queries(self) -> DataFrame:
        return adapters.benchmark_queries(self.spark, self.sf)

    @cached_property
    def hits(self) -> DataFrame:
        return retrieval.bm25_search(self.chunks, self.queries, 10, stemmed=False, phrases=False)

    @cached_property
    def packets(self) -> DataFrame:
        return evidence.evidence_packets(self.signal_table, self.chunks, stemmed=False)

    @cached_property
    def run(self) -> dict[str, DataFrame]:
        return adapters.claim_tables(self.spark, self.sf)

    @cached_property
    def allowed(self) -> DataFrame:
        r = self.run
        return audit.allowed_references(r["signals"], r["evidence"], r["facts"], r["tests"], r["results"])

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf, name)


def plain(frame: DataFrame) -> DataFrame:
    """Dates and exact decimals as text, arrays joined, doubles rounded, whole numbers as long."""

    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType)):
            return column.cast("string")
        if isinstance(kind, T.DecimalType):
            return column.cast("decimal(38,6)" if kind.scale > 6 else kind).cast("string")
        if isinstance(kind, T.DoubleType):
            # the same double operations as in the SQL text, so that equal inputs round equally
            return F.rint(column * 1e6) / 1e6
        if isinstance(kind, (T.IntegerType, T.ShortType)):
            return column.cast("bigint")
        if isinstance(kind, T.ArrayType):
            return F.array_join(column, "|")
        return column

    return frame.select(*[shown(f).alias(f.name) for f in frame.schema.fields])


def query(name: str):
    """Register a query written over ``Inputs``."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(build(Inputs(spark, sf_dir)))
        return build

    return register


# ------------------------------------------------------------------- A: sources and sinks
FACT_COLUMNS = [
    "fact_id", "cik", "taxonomy", "concept", "unit", "value", "start_date", "end_date", "fiscal_year", "fiscal_period",
    "form", "filed", "accession_number", "frame",
]


@query("a1_read_companyfacts")
def _(i: Inputs) -> DataFrame:
    parsed = payloads.parse(adapters.companyfacts_payloads(i.spark, i.sf), payloads.COMPANYFACTS)
    return payloads.read_companyfacts(parsed).select(*FACT_COLUMNS)


@query("a2_read_companies")
def _(i: Inputs) -> DataFrame:
    parsed = payloads.parse(adapters.submissions_payloads(i.spark, i.sf), payloads.SUBMISSIONS)
    return payloads.read_companies(parsed)


@query("a3_read_filings")
def _(i: Inputs) -> DataFrame:
    parsed = payloads.parse(adapters.filing_list_payloads(i.spark, i.sf), payloads.SUBMISSIONS)
    return payloads.read_filings(parsed).drop("manifest_id")


@query("a4_read_directory")
def _(i: Inputs) -> DataFrame:
    return payloads.read_directory(adapters.directory_payloads(i.spark, i.sf))


@query("a5_quarantine_payloads")
def _(i: Inputs) -> DataFrame:
    good, bad = payloads.quarantine(*adapters.defective_payloads(i.spark, i.sf))
    return good.select("cik", F.lit("accepted").alias("reason")).unionByName(bad)


@query("a6_payload_manifest")
def _(i: Inputs) -> DataFrame:
    return payloads.payload_manifest(i.table("pages").withColumn("html", F.col("html").cast("binary")), "url", "html")


@query("a6_verify_payloads")
def _(i: Inputs) -> DataFrame:
    pages = i.table("pages").select(F.concat_ws("/", "url", F.col("page_id").cast("string")).alias("url"), "page_id", "html")
    now = payloads.payload_manifest(pages.where("page_id % 5 <> 0"), "url", "html")
    edited = F.when(F.col("page_id") % 3 == 0, F.upper("html")).otherwise(F.col("html"))
    before = payloads.payload_manifest(pages.where("page_id % 7 <> 0").withColumn("html", edited), "url", "html")
    return payloads.verify_payloads(now, before).select("canonical_url", "integrity")


def _order_versions(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """All orders as stored rows; open orders repriced, and moved ones, as incoming rows."""
    orders = i.table("orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    repriced = orders.withColumn("price", F.when(F.col("o_orderstatus") == "P", F.col("price") + 1).otherwise(F.col("price")).cast("decimal(14,2)"))
    moved = repriced.withColumn("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") + 1000000000).otherwise(F.col("o_orderkey")))
    return orders, moved.unionByName(moved)


@query("a7_upsert_by_key")
def _(i: Inputs) -> DataFrame:
    return tables.merge_by_key(*_order_versions(i), ["o_orderkey"])


@query("a7_changed_rows")
def _(i: Inputs) -> DataFrame:
    stored, incoming = _order_versions(i)
    return tables.changed_rows(stored, tables.merge_by_key(incoming.limit(0), incoming, ["o_orderkey"]), ["o_orderkey"])


@query("a8_partition_layout")
def _(i: Inputs) -> DataFrame:
    laid = tables.with_partitions(i.facts, "normalized_facts", per_company=True)
    return laid.groupBy(*tables.partition_columns("normalized_facts", True)).agg(F.count(F.lit(1)).alias("row_count"))


@query("a10_typed_scan")
def _(i: Inputs) -> DataFrame:
    rows = tables.conform(i.findings, "data_quality_findings").where(F.col("category") == "incompatible_unit")
    return rows.select("cik", "finding_id", "category", "severity", "metric", "affected_count")


def _folder(i: Inputs, name: str) -> str:
    from uuid import uuid4

    from factlode.session import checkpoint_dir

    return f"{checkpoint_dir(i.spark).rstrip('/')}/{name}-{uuid4().hex}"


@query("a7_stored_upsert")
def _(i: Inputs) -> DataFrame:
    """Companies after a second batch with new, changed and equal rows, read from base and delta and again after they were merged."""
    store = tables.Warehouse(i.spark, _folder(i, "upserts"))
    digit = F.substring("cik", 10, 1).cast("int")
    store.upsert("companies", i.companies.where(digit < 8), buckets=4)
    named = F.when(digit % 3 == 1, F.concat("legal_name", F.lit(" Holding"))).otherwise(F.col("legal_name"))
    store.upsert("companies", i.companies.where(digit > 2).withColumn("legal_name", named))
    before = cut_lineage(store.companies().select(F.lit("base and delta").alias("state"), "cik", "legal_name", "sic"))
    tables.compact(i.spark, store.root, "companies")
    return before.unionByName(store.companies().select(F.lit("merged").alias("state"), "cik", "legal_name", "sic"))


@query("a8_written_layout")
def _(i: Inputs) -> DataFrame:
    """Facts written by version, mapping, bucket of companies and year, counted from the folders that were written."""
    root = _folder(i, "layout")
    tables.upsert(i.spark, root, "normalized_facts", i.facts, buckets=4)
    written = i.spark.read.parquet(tables.dataset_path(root, "normalized_facts"))
    parts = written.select(F.col("version").cast("string"), F.col("mapping").cast("string"), F.col("year_part").cast("string"), "cik", "cik_bucket")
    return parts.groupBy("version", "mapping", "year_part").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("cik").alias("companies"),
        (F.count_distinct("cik", "cik_bucket") == F.count_distinct("cik")).alias("one_bucket_each"))


@query("a9_dataset_views")
def _(i: Inputs) -> DataFrame:
    """SQL over the views of a warehouse that holds two versions of filings with different columns."""
    root = _folder(i, "views")
    tables.upsert(i.spark, root, "filings", i.filings, buckets=4)
    older = i.filings.select(
        F.concat(F.lit("old-"), "accession_number").alias("accession_number"), "cik", "form", "filing_date", F.lit(1).alias("pages"))
    older.write.parquet(f"{tables.dataset_path(root, 'filings')}/version=0.9.0/cik_bucket=0")
    tables.upsert(i.spark, root, "data_quality_findings", i.findings, buckets=4)
    tables.create_views(i.spark, root)
    return i.spark.sql("""
        SELECT form, accession_number LIKE 'old-%' AS older, count(*) AS filings, count(primary_document) AS documents,
               CAST(min(filing_date) AS STRING) AS first_date, (SELECT count(*) FROM data_quality_findings) AS findings
        FROM filings GROUP BY 1, 2""")


@query("a10_stored_scan")
def _(i: Inputs) -> DataFrame:
    """Findings of one category, scanned from the stored table."""
    root = _folder(i, "findings")
    tables.upsert(i.spark, root, "data_quality_findings", i.findings, buckets=4)
    rows = tables.scan(i.spark, root, "data_quality_findings", ordered=False, category="incompatible_unit")
    return rows.select("cik", "finding_id", "category", "severity", "metric", "affected_count")


@query("a11_named_readers")
def _(i: Inputs) -> DataFrame:
    """Every row that the readers give for one company, from a warehouse of all companies."""
    store = tables.Warehouse(i.spark, _folder(i, "readers"))
    for name, frame in (("companies", i.companies), ("filings", i.filings), ("normalized_facts", i.facts), ("data_quality_findings", i.findings)):
        store.upsert(name, frame, buckets=4)
    asked, found = "0000000001", None
    for reader, key in (("company", "cik"), ("filings", "accession_number"), ("normalized_facts", "normalized_fact_id"), ("data_quality_findings", "finding_id")):
        rows = getattr(store, reader)(asked).select(F.lit(reader).alias("reader"), F.col(key).alias("row_key"))
        found = rows if found is None else found.unionByName(rows)
    counts = store.counts("companies", "filings", "normalized_facts", "signals")
    return found.unionByName(counts.select(F.lit("counts").alias("reader"), F.concat_ws(" ", "dataset", "row_count").alias("row_key")))


@query("a12_agent_outputs")
def _(i: Inputs) -> DataFrame:
    return audit.agent_outputs(adapters.reports(i.spark, i.sf))


@query("a13_filing_url")
def _(i: Inputs) -> DataFrame:
    url = payloads.filing_document_url(F.col("cik"), F.concat_ws("-", "cik", "accession_number"), F.col("primary_document"))
    return i.filings.select("accession_number", url.alias("url"))


@query("a14_report_lines")
def _(i: Inputs) -> DataFrame:
    parts = {"tests": i.tests.select("cik", "test_id", "status"), "signals": i.signals.select("cik", "signal_id", "test_id")}
    return audit.report_lines(parts)


# ------------------------------------------------------------------ B: filters, predicates
@query("b1_select_periods")
def _(i: Inputs) -> DataFrame:
    chosen = periods.PeriodFilter(start_date=WINDOW[0], end_date=WINDOW[1])
    return periods.select_periods(i.facts, chosen).select(
        "normalized_fact_id", "cik", "canonical_metric", "end_date", "reporting_basis", "value"
    )


@query("b2_requested_window")
def _(i: Inputs) -> DataFrame:
    kept = history.requested_window(i.facts, i.results, i.tests, i.anomalies, *WINDOW)
    identifiers = {"facts": "normalized_fact_id", "metric_results": "metric_result_id", "test_results": "test_result_id",
                   "anomalies": "anomaly_id"}
    united = None
    for name, frame in kept.items():
        rows = frame.groupBy("cik").agg(F.count(identifiers[name]).alias("row_count")).withColumn("kind", F.lit(name))
        united = rows if united is None else united.unionByName(rows)
    return united


@query("b2_window_rows")
def _(i: Inputs) -> DataFrame:
    """The rows of each kind that the requested window keeps."""
    kept = history.requested_window(i.facts, i.results, i.tests, i.anomalies, *WINDOW)
    keys = {"facts": "normalized_fact_id", "metric_results": "metric_result_id", "test_results": "test_result_id", "anomalies": "anomaly_id"}
    united = None
    for name, frame in kept.items():
        rows = frame.select("cik", F.lit(name).alias("kind"), F.col(keys[name]).alias("row_id"))
        united = rows if united is None else united.unionByName(rows)
    return united


@query("b3_rejection_cascade")
def _(i: Inputs) -> DataFrame:
    return i.candidates.select("fact_id", "canonical_metric", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


@query("b4_periods_align")
def _(i: Inputs) -> DataFrame:
    side = lambda metric, p: i.facts.where(F.col("canonical_metric") == metric).select(
        *[F.col(c).alias(f"{p}_{c}") for c in ("normalized_fact_id", "cik", "start_date", "end_date", "fiscal_year", "fiscal_period")])
    left, right = side("gross_profit", "l"), side("revenue", "r")
    get = lambda p: {c: F.col(f"{p}_{c}") for c in ("start_date", "end_date", "fiscal_year", "fiscal_period")}
    joined = left.join(right, (F.col("l_cik") == F.col("r_cik")) & periods.periods_align(get("l"), get("r")))
    return joined.select(F.col("l_normalized_fact_id").alias("left_id"), F.col("r_normalized_fact_id").alias("right_id"))


@query("b5_view_filters")
def _(i: Inputs) -> DataFrame:
    errors = history.by_severity(i.findings, "error", "warning").select("cik", F.col("finding_id").alias("row_id"))
    shown = history.facts_view(i.facts, ("annual",), ("revenue", "net_income")).select(
        "cik", F.col("normalized_fact_id").alias("row_id"))
    return errors.unionByName(shown)


@query("b6_record_validity")
def _(i: Inputs) -> DataFrame:
    declared = i.candidates.where(F.col("canonical_metric").isNotNull()).withColumn("period_type", F.col("mapped_period_type"))
    return declared.select(
        "fact_id", F.coalesce(quality.first_violation(quality.fact_rules()), F.lit("valid")).alias("violation"))


@query("b7_canonical_url")
def _(i: Inputs) -> DataFrame:
    return i.table("pages").select("page_id", payloads.canonical_url(F.col("url"), PAGE_HOSTS).alias("canonical"))


# ------------------------------------------------------------------------------- C: joins
@query("c1_fact_mapping")
def _(i: Inputs) -> DataFrame:
    return i.candidates.where("canonical_metric IS NOT NULL").select("fact_id", "canonical_metric", "concept_rank", "data_confidence")


@query("c2_unmapped_facts")
def _(i: Inputs) -> DataFrame:
    found = normalize.fact_findings(i.candidates).where("category = 'unmapped_concept'")
    return found.select("cik", "fact_id", "finding_id", "message")


@query("c3_missing_metrics")
def _(i: Inputs) -> DataFrame:
    return normalize.missing_metric_findings(i.candidates).select("cik", "metric", "finding_id", "message", "severity")


def _result_view(results: DataFrame) -> DataFrame:
    return results.select(
        "cik", "metric_result_id", "metric_id", "formula_version", "period_type", "start_date", "end_date", "fiscal_year",
        "fiscal_period", "reporting_basis", "status", "value", "unit", "comparability_flags",
        F.col("data_confidence").cast("double").alias("data_confidence"), "not_computable_reason",
        F.size("input_fact_ids").alias("input_count"),
    )


@query("c4_metric_inputs")
def _(i: Inputs) -> DataFrame:
    return _result_view(i.results.where("formula_version = '1.0.0'"))


@query("c5_tests_latest_metric")
def _(i: Inputs) -> DataFrame:
    return i.tests.select("cik", "test_id", F.get("metric_result_ids", F.lit(0)).alias("metric_result_id"), "end_date", "status")


@query("c6_anomaly_tests")
def _(i: Inputs) -> DataFrame:
    return forensics.matched_anomalies(i.anomalies, i.tests).select("cik", "anomaly_id", "metric_id", "test_id", "robust_z_score")


@query("c7_peer_cohort")
def _(i: Inputs) -> DataFrame:
    found = peers.peer_context(i.companies, i.results, PEER_POLICY)
    return found.select("cik", "metric_id", "end_date", "peer_count", "peer_assets_from", "peer_assets_to", "reason")


@query("c8_geography")
def _(i: Inputs) -> DataFrame:
    return company.geographic_evidence(adapters.addresses(i.spark, i.sf))


@query("c9_search_payload")
def _(i: Inputs) -> DataFrame:
    return retrieval.search_hits(i.hits, i.chunks).select("query_id", "rank", "chunk_id", "section", "accession_number", "form", "source_url")


@query("c10_local_availability")
def _(i: Inputs) -> DataFrame:
    return company.mark_available(i.directory, i.companies)


@query("c11_signal_metrics")
def _(i: Inputs) -> DataFrame:
    return audit.signal_metrics(i.signals, i.tests, i.results).select("cik", "metric_result_id", "metric_id")


@query("c12_claim_references")
def _(i: Inputs) -> DataFrame:
    return audit.claim_violations(i.run["claims"], i.allowed)


@query("c13_reference_repair")
def _(i: Inputs) -> DataFrame:
    return audit.repair_references(i.run["claims"], i.allowed).select("run_id", "claim_id", "fact_ids")


@query("c14_verification_coverage")
def _(i: Inputs) -> DataFrame:
    return audit.verification_violations(i.run["claims"], i.run["verifications"], i.run["evidence"])


@query("c15_signal_coverage")
def _(i: Inputs) -> DataFrame:
    return audit.uncovered_signals(i.run["claims"], i.run["signals"]).distinct()


@query("c16_accepted_claims")
def _(i: Inputs) -> DataFrame:
    return audit.accepted_claims(i.run["claims"], i.run["verifications"]).select("run_id", "claim_id", "role")


@query("c17_entity_consistency")
def _(i: Inputs) -> DataFrame:
    _, bad = payloads.quarantine(*adapters.defective_payloads(i.spark, i.sf))
    return bad.where("reason IN ('entity_mismatch', 'cik_mismatch')")


# ------------------------------------------------------------------------ D: aggregations
@query("d1_quality_score")
def _(i: Inputs) -> DataFrame:
    return quality.data_quality(i.facts, i.findings).drop("reconciliation", "explanation")


@query("d2_normalization_summary")
def _(i: Inputs) -> DataFrame:
    counts = normalize.summary_counts(i.raw, i.chosen)
    return normalize.summary_findings(counts).select("cik", "finding_id", "message", "affected_count")


@query("d3_duplicate_groups")
def _(i: Inputs) -> DataFrame:
    return normalize.duplicate_findings(i.chosen).select("cik", "metric", "finding_id", "message", "affected_count")


@query("d4_peer_statistics")
def _(i: Inputs) -> DataFrame:
    return peers.peer_statistics(peers.aligned_results(i.companies, i.results), PEER_POLICY).where("peer_count > 0")


@query("d5_run_summary")
def _(i: Inputs) -> DataFrame:
    return history.run_summary(adapters.runs(i.spark, i.sf))


@query("d6_financials_summary")
def _(i: Inputs) -> DataFrame:
    return history.financials_summary(i.facts, i.findings, i.filings)


@query("d7_dataset_counts")
def _(i: Inputs) -> DataFrame:
    return history.dataset_counts({
        "companies": i.companies, "filings": i.filings, "raw_xbrl_facts": i.raw, "normalized_facts": i.facts,
        "data_quality_findings": i.findings, "investigation_runs": None,
    })


@query("d8_ingestion_summary")
def _(i: Inputs) -> DataFrame:
    return history.ingestion_summary(i.companies, i.filings, i.raw, i.facts, i.tests, i.signals)


@query("d9_minimum_confidence")
def _(i: Inputs) -> DataFrame:
    return i.results.where("formula_version = '1.0.0'").select(
        "metric_result_id", F.col("data_confidence").cast("double").alias("data_confidence"))


@query("d10_test_coverage")
def _(i: Inputs) -> DataFrame:
    return history.test_coverage(i.tests, i.signals)


def _labels(i: Inputs) -> DataFrame:
    """The expected answer of a benchmark query: the section that holds document text."""
    return i.queries.select("query_id", F.lit("PART II Item 7").alias("label"))


@query("d11_retrieval_evaluation")
def _(i: Inputs) -> DataFrame:
    hits = retrieval.search_hits(i.hits, i.chunks).select("query_id", "rank", F.col("section").alias("label"))
    return retrieval.evaluate_retrieval(_labels(i), hits, 3)


@query("d12_corpus_statistics")
def _(i: Inputs) -> DataFrame:
    return retrieval.corpus_statistics(i.chunks)


@query("d12_document_frequency")
def _(i: Inputs) -> DataFrame:
    return retrieval.document_frequency(retrieval.postings(i.chunks))


@query("d13_source_manifests")
def _(i: Inputs) -> DataFrame:
    return audit.source_manifests(i.facts)


# ------------------------------------------------------------ E: windows and ordered groups
def _fact_view(facts: DataFrame) -> DataFrame:
    return facts.select(
        "normalized_fact_id", "cik", "canonical_metric", "original_fact_id", "original_concept", "value", "unit", "period_type",
        "start_date", "end_date", "fiscal_year", "fiscal_period", "reporting_basis", "form", "filed", "accession_number",
        "frame", "selection_rank", "selection_rationale", "is_fallback",
    )


@query("e1_choose_fact")
def _(i: Inputs) -> DataFrame:
    return i.chosen.select("cik", "canonical_metric", "unit", "start_date", "end_date", "fiscal_year", "fiscal_period",
                           "reporting_basis", "fact_id", "candidate_count")


@query("e1_prefer_amendments")
def _(i: Inputs) -> DataFrame:
    policy = normalize.SelectionPolicy(prefer_amendments=True)
    return normalize.choose_facts(i.candidates, policy).select("cik", "canonical_metric", "end_date", "fact_id", "form")


def _series(name: str, *columns: str) -> None:
    @query(name)
    def _(i: Inputs) -> DataFrame:
        return i.anomalies.select("anomaly_id", *columns)


_series("e2_expanding_median", "historical_median")
_series("e3_expanding_mad", "median_absolute_deviation")
_series("e4_robust_z", "robust_z_score", "sample_count")
_series("e5_relative_change", "year_over_year_change", "quarter_over_quarter_change")
_series("e6_expanding_percentile", "rolling_percentile")
_series("e7_persistence", "persistence")


@query("e8_history_ids")
def _(i: Inputs) -> DataFrame:
    rows = forensics.anomalies(i.results, history_ids=True)
    return rows.select("anomaly_id", "sample_count", F.sha2(F.array_join("input_metric_result_ids", "|"), 256).alias("history"))


@query("e2_by_basis")
def _(i: Inputs) -> DataFrame:
    return forensics.anomalies(i.results, by_basis=True).select(
        "anomaly_id", "historical_median", "robust_z_score", "sample_count", "persistence")


@query("e9_latest_results")
def _(i: Inputs) -> DataFrame:
    return forensics.latest_results(i.results).select("cik", "metric_id", "latest.end_date", F.col("latest.id").alias("metric_result_id"))


@query("e10_last_periods")
def _(i: Inputs) -> DataFrame:
    return history.last_periods(periods.select_periods(i.facts), 12).select("cik", "canonical_metric", "normalized_fact_id", "end_date")


@query("e11_top_signals")
def _(i: Inputs) -> DataFrame:
    return i.signals.select("cik", "signal_rank", "signal_id", "score")


@query("e12_first_test")
def _(i: Inputs) -> DataFrame:
    return forensics.first_test_per_metric(i.tests).select("cik", "metric_id", "test_id")


@query("e13_greedy_evidence")
def _(i: Inputs) -> DataFrame:
    queries = evidence.signal_queries(i.signal_table)
    hits = retrieval.bm25_search(i.chunks, queries, 8, stemmed=False, phrases=False)
    return evidence.assign_hits(queries, hits).select("cik", "packet_order", "signal_id", "chunk_id")


@query("e14_section_numbering")
def _(i: Inputs) -> DataFrame:
    return i.chunks.select("accession_number", "section", "sequence", "chunk_id")


@query("e15_run_caps")
def _(i: Inputs) -> DataFrame:
    signals, _packets = audit.run_inputs(i.signal_table, i.packets)
    return signals.select("cik", "run_position", "signal_id")


@query("e15_capped_packets")
def _(i: Inputs) -> DataFrame:
    _signals, packets = audit.run_inputs(i.signal_table, i.packets)
    return packets.select("cik", "run_position", "evidence_id", "content_sha256")


# ------------------------------------------------------------------ F: sorts, limits, top-k
def _positions(frame: DataFrame, key: str, order: list[Column], identifier: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("position")
    return frame.select(key, F.col(identifier), place)


@query("f1_fact_order")
def _(i: Inputs) -> DataFrame:
    start = periods.order_date(F.col("start_date"), F.col("end_date"))
    order = [F.col("canonical_metric"), F.col("end_date"), start, F.col("accession_number"), F.col("normalized_fact_id")]
    return _positions(i.facts, "cik", order, "normalized_fact_id")


@query("f2_result_order")
def _(i: Inputs) -> DataFrame:
    start = periods.order_date(F.col("start_date"), F.col("end_date"))
    order = [F.col("metric_id"), F.col("end_date"), start, F.col("metric_result_id")]
    return _positions(i.results, "cik", order, "metric_result_id")


@query("f3_directory_search")
def _(i: Inputs) -> DataFrame:
    return company.search_directory(i.directory, SEARCH_TEXT)


@query("f4_newest_filings")
def _(i: Inputs) -> DataFrame:
    return history.newest_filings(i.filings, 5).select("cik", "position", "accession_number", "filing_date", "form")


@query("f5_search_top_k")
def _(i: Inputs) -> DataFrame:
    return i.hits.select("query_id", "cik", "rank", "chunk_id")


@query("f6_finding_order")
def _(i: Inputs) -> DataFrame:
    order = [normalize.severity_rank(), F.col("category"), F.col("finding_id")]
    return _positions(i.findings, "cik", order, "finding_id")


@query("f7_company_search")
def _(i: Inputs) -> DataFrame:
    return company.search_companies(i.companies, "SUPPLIER#00000000", 12)


@query("f8_resolve_identity")
def _(i: Inputs) -> DataFrame:
    known = i.companies.unionByName(i.companies.where("cik LIKE '%5'").withColumn("cik", F.concat(F.lit("9"), F.substring("cik", 2, 9))))
    key = F.col("c_custkey")
    asked = i.table("customer").select(
        F.when(key % 4 == 0, F.concat(F.lit("cik"), key.cast("string")))
        .when(key % 4 == 1, F.concat(F.lit(" t"), key.cast("string"), F.lit(" ")))
        .when(key % 4 == 2, F.upper(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))))
        .otherwise(key.cast("string")).alias("identifier"), F.col("c_custkey").alias("asked"),
    )
    return company.resolve_identities(known, asked).select("asked", "resolution", "match_count", "cik")


# --------------------------------------------------------------------- G: set operations
@query("g1_metric_union")
def _(i: Inputs) -> DataFrame:
    return _result_view(i.results)


@query("g2_findings_union")
def _(i: Inputs) -> DataFrame:
    return i.findings.drop("mapping_version")


@query("g4_row_set_equality")
def _(i: Inputs) -> DataFrame:
    return tables.rows_equal(*_order_versions(i))


@query("g5_reference_subset")
def _(i: Inputs) -> DataFrame:
    checked = i.run["verifications"].join(i.run["claims"].select("run_id", "claim_id", "evidence_ids"), ["run_id", "claim_id"])
    return checked.select("run_id", "claim_id", (F.size(F.array_except("checked_evidence_ids", "evidence_ids")) == 0).alias("is_subset")).distinct()


@query("g6_distinct_values")
def _(i: Inputs) -> DataFrame:
    return i.facts.select("cik", "reporting_basis").dropDuplicates()


# ------------------------------------------------------------------- H: scalar functions
@query("h1_normalize_cik")
def _(i: Inputs) -> DataFrame:
    key = F.col("c_custkey")
    written = (
        F.when(key % 4 == 0, F.concat(F.lit(" CIK"), key.cast("string")))
        .when(key % 4 == 1, F.concat(F.lit("cik"), key.cast("string"), F.lit(" ")))
        .when(key % 4 == 2, F.concat(key.cast("string"), F.lit("x"))).otherwise(F.lpad(key.cast("string"), 11, "1"))
    )
    return i.table("customer").select("c_custkey", ids.normalize_cik(written).alias("cik"))


@query("h2_fact_id")
def _(i: Inputs) -> DataFrame:
    return i.raw.select("fact_id", "accession_number", "concept")


@query("h3_stable_ids")
def _(i: Inputs) -> DataFrame:
    return audit.run_records(i.companies, i.signal_table, i.packets, *WINDOW)


@query("h4_period_classes")
def _(i: Inputs) -> DataFrame:
    return i.candidates.select("fact_id", "reporting_basis")


@query("h5_amendment_forms")
def _(i: Inputs) -> DataFrame:
    return i.filings.select("accession_number", "is_amendment", F.regexp_replace("form", "/A$", "").alias("base_form"))


@query("h6_casefold")
def _(i: Inputs) -> DataFrame:
    return i.table("documents").select("doc_id", F.sha2(text.casefold(F.col("text")), 256).alias("folded"))


@query("h8_materiality")
def _(i: Inputs) -> DataFrame:
    return i.signals.select("signal_id", "materiality", "data_confidence")


@query("h9_explanations")
def _(i: Inputs) -> DataFrame:
    return i.tests.select("cik", "test_id", "reason", F.col("threshold_context.purpose").alias("purpose"))


@query("h11_address_line")
def _(i: Inputs) -> DataFrame:
    line = text.address_line(*[F.col(c) for c in ("street1", "street2", "city", "state_or_country", "zip_code")])
    return adapters.addresses(i.spark, i.sf).select("cik", line.alias("address"))


@query("h12_language_screen")
def _(i: Inputs) -> DataFrame:
    said = i.table("conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text_id"), "text")
    docs = i.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    return said.unionByName(docs).select(
        "text_id", quality.contains_any(F.col("text"), SCREEN_PHRASES).alias("flagged"), audit.accusatory(F.col("text")).alias("accusatory"))


@query("h13_citation")
def _(i: Inputs) -> DataFrame:
    return i.packets.select("evidence_id", evidence.citation(i.packets).alias("citation"))


@query("h14_word_count")
def _(i: Inputs) -> DataFrame:
    return i.table("documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


# --------------------------------------------------------------------------- I: stages
@query("i1_normalized_facts")
def _(i: Inputs) -> DataFrame:
    return _fact_view(i.facts)


@query("i1_finding_facts")
def _(i: Inputs) -> DataFrame:
    return normalize.finding_facts(i.candidates, i.chosen)


@query("i4_forensic_tests")
def _(i: Inputs) -> DataFrame:
    return i.tests.select(
        "cik", "test_result_id", "test_id", F.col("threshold_context.category").alias("category"), "end_date", "start_date",
        "reporting_basis", "status", "result", F.array_join("threshold_context.evidence_requirements", "; ").alias("evidence"))


@query("i5_anomalies")
def _(i: Inputs) -> DataFrame:
    return i.anomalies.drop("explanation", "fiscal_year", "fiscal_period", "period_type")


@query("i6_signals")
def _(i: Inputs) -> DataFrame:
    return i.signals.select("cik", "signal_id", "signal_rank", "category", "test_id", "severity", "materiality", "persistence", "score")


@query("i7_peer_context")
def _(i: Inputs) -> DataFrame:
    return peers.peer_context(i.companies, i.results, PEER_POLICY).drop("peer_assets_from", "peer_assets_to")


@query("i8_filing_chunks")
def _(i: Inputs) -> DataFrame:
    return i.chunks.select("chunk_id", "cik", "accession_number", "section", "subsection", "sequence", "start_offset", "end_offset",
                           F.sha2("text", 256).alias("text_hash"), "source_url")


@query("i8_page_chunks")
def _(i: Inputs) -> DataFrame:
    """HTML filings decoded, cleaned, cut into sections and packed line by line, next to those without text."""
    good, rejected = filings_text.document_text(adapters.filing_pages(i.spark, i.sf).withColumn("content", F.encode("html", "UTF-8")).drop("html"))
    chunks = filings_text.filing_chunks(good, "\n").select(
        "accession_number", "section", "sequence", "start_offset", "end_offset", F.sha2("text", 256).alias("text_hash"), "source_url")
    return chunks.unionByName(rejected.select("accession_number", F.col("reason").alias("section")), allowMissingColumns=True)


@query("i9_search")
def _(i: Inputs) -> DataFrame:
    return retrieval.bm25_search(i.chunks, i.queries, 10, stemmed=False, phrases=True)


@query("i9_search_stemmed")
def _(i: Inputs) -> DataFrame:
    return retrieval.bm25_search(i.chunks, i.queries, 10, stemmed=True)


@query("i9_phrase_search")
def _(i: Inputs) -> DataFrame:
    """Every document asks its company for two phrases of its own text, through a stored index."""
    index = _stored_index(i, "phrase-index")
    index.refresh(i.chunks)
    return retrieval.bm25_search(None, adapters.document_phrases(i.spark, i.sf), 10, stemmed=False, index=index)


@query("i9_search_filtered")
def _(i: Inputs) -> DataFrame:
    """Stemmed search among the retained form and section only; statistics cover all chunks."""
    return retrieval.bm25_search(i.chunks, i.queries, 10, stemmed=True, forms=("10-K",), sections=("PART II Item 7",))


@query("i9_search_company_statistics")
def _(i: Inputs) -> DataFrame:
    return retrieval.bm25_search(i.chunks, i.queries, 10, stemmed=False, phrases=False, stats_scope="cik", forms=("10-K",))


@query("i10_evidence_packets")
def _(i: Inputs) -> DataFrame:
    return i.packets


@query("i12_financial_history")
def _(i: Inputs) -> DataFrame:
    found = history.financial_history(i.facts, start=WINDOW[0], end=WINDOW[1], periods_per_metric=4)
    return found.select("cik", "canonical_metric", "end_date", "start_date", "reporting_basis", "value", "normalized_fact_id")


@query("i13_audit_lineage")
def _(i: Inputs) -> DataFrame:
    return audit.audit_manifest(audit.audit_lineage(i.results, i.tests, i.signal_table, i.packets))


@query("i14_claim_audit")
def _(i: Inputs) -> DataFrame:
    r = i.run
    return audit.audit_claims(r["claims"], r["verifications"], i.allowed, r["signals"].select("run_id", "signal_id").distinct(), r["evidence"])


@query("i15_gate_status")
def _(i: Inputs) -> DataFrame:
    return audit.gate_status(i.companies, i.signals)


@query("i16_analyze")
def _(i: Inputs) -> DataFrame:
    done = analyze(i.raw, materialize=True)
    return history.dataset_counts(done.datasets())


# ------------------------------------------------------------------------------- J: text
@query("j1_decode_payload")
def _(i: Inputs) -> DataFrame:
    from factlode.functions.html import decode_payload

    doc = i.table("documents")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.concat(F.lit("é"), F.regexp_replace("text", "[^\\x00-\\x7F]", "")), "ISO-8859-1"))
    return doc.select("doc_id", F.sha2(decode_payload(content), 256).alias("decoded"))


@query("j2_html_to_text_jvm")
@query("j2_html_to_text")
def _(i: Inputs) -> DataFrame:
    return i.table("pages").select("page_id", text.clean_text(html_to_text(F.col("html"))).alias("body"))


@query("j3_clean_text")
def _(i: Inputs) -> DataFrame:
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(" . \t\n\n"))
    return i.table("documents").select("doc_id", F.sha2(text.clean_text(spaced), 256).alias("cleaned"))


@query("j4_sections")
def _(i: Inputs) -> DataFrame:
    return filings_text.split_sections(i.documents).select(
        "accession_number", "section", "subsection", "section_start", F.length("section_text").alias("section_length"))


@query("j5_chunk_text")
def _(i: Inputs) -> DataFrame:
    return filings_text.filing_chunks(i.documents, "\n").select(
        "accession_number", "section", "sequence", "start_offset", "end_offset", F.sha2("text", 256).alias("text_hash"))


@query("j6_query_terms")
def _(i: Inputs) -> DataFrame:
    return i.queries.select("query_id", text.query_terms(F.col("query"), 24).alias("terms"))


@query("j7_document_tokens")
def _(i: Inputs) -> DataFrame:
    return i.table("documents").select("doc_id", F.sha2(F.array_join(text.document_tokens(F.col("text")), " "), 256).alias("tokens"))


@query("j8_bm25")
def _(i: Inputs) -> DataFrame:
    return i.hits.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"))


@query("j9_search_index")
def _(i: Inputs) -> DataFrame:
    index = retrieval.postings(i.chunks)
    return index.groupBy("chunk_id", "length").agg(F.count("term").alias("terms"), F.sum("frequency").alias("weight"))


def _stored_index(i: Inputs, name: str) -> SearchIndex:
    from uuid import uuid4

    from factlode.session import checkpoint_dir

    return SearchIndex(i.spark, f"{checkpoint_dir(i.spark).rstrip('/')}/{name}-{uuid4().hex}", buckets=8, slices=2)


@query("j9_index_refresh")
def _(i: Inputs) -> DataFrame:
    """A stored index after chunks were added, changed, taken out and put back, before and after its segments are merged."""
    number = F.expr("CAST(substring(accession_number, 3) AS BIGINT)")
    changed = F.when(F.col("section") == "Item 8", F.concat("text", F.lit(" amended filing"))).otherwise(F.col("text"))
    index = _stored_index(i, "refreshed-index")
    index.refresh(i.chunks.where(number % 5 != 4))
    index.refresh(i.chunks.where(number % 5 >= 3).withColumn("text", changed))
    index.refresh(i.chunks.where(number % 10 == 1), removed=i.chunks.where(number % 7 == 3).select("cik", "chunk_id"))
    found = None
    for state in ("segments", "merged"):
        if state == "merged":
            index.compact()
        counted = index.postings().join(index.frequencies(stemmed=False), "term")
        average = index.corpus().select("average_length").scalar()
        rows = counted.groupBy("chunk_id", "length").agg(
            F.count("term").alias("terms"), F.sum("frequency").alias("weight"), F.sum("document_frequency").alias("shared"))
        rows = rows.select(F.lit(state).alias("state"), "*", average.alias("average_length"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("j7_stems")
def _(i: Inputs) -> DataFrame:
    """Each distinct token of the documents with its stem and the documents that hold it."""
    tokens = F.explode(F.array_distinct(text.document_tokens(F.col("text")))).alias("term")
    held = i.table("documents").select(tokens).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    return held.select("term", porter(F.col("term")).alias("stem"), "documents")


@query("j10_minimal_excerpt")
def _(i: Inputs) -> DataFrame:
    found = retrieval.search_hits(i.hits, i.chunks).join(i.queries, ["query_id", "cik"])
    return evidence.with_excerpt(found).select("query_id", "chunk_id", "excerpt", "excerpt_start")


@query("j11_evidence_spans")
def _(i: Inputs) -> DataFrame:
    return i.packets.select("evidence_id", "signal_id", "start_offset", "end_offset", "token_count", "selection_reason")


# --------------------------------------------------------------------------- K: streaming
@query("k1_incremental_ingest")
def _(i: Inputs) -> DataFrame:
    """Land payload files for all companies twice over, ingest both and return the table."""
    from uuid import uuid4

    from factlode.session import checkpoint_dir
    from factlode.streaming.ingest import DATASET, ingest_stream

    base = f"{checkpoint_dir(i.spark).rstrip('/')}/ingest-{uuid4().hex}"
    landed = adapters.companyfacts_payloads(i.spark, i.sf).withColumn("name", F.concat(F.lit("CIK"), "cik"))
    for _round in range(2):
        landed.select("name", "body").write.mode("append").partitionBy("name").option("lineSep", "\n").text(f"{base}/landing")
        ingest_stream(i.spark, f"{base}/landing", f"{base}/warehouse", f"{base}/progress", buckets=8, payload_per_line=True).awaitTermination()
    return tables.read_dataset(i.spark, f"{base}/warehouse", DATASET).select(*FACT_COLUMNS)
