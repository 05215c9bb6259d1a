"""One SQL text per query of the catalog."""

from __future__ import annotations

from factlode.catalog import PAGE_HOSTS, SCREEN_PHRASES, WINDOW
from factlode.operators.audit import ACCUSATORY_PHRASES, NO_PROVIDER, NO_SIGNALS, PROMPT_VERSION
from factlode.operators.company import LIMITATION
from factlode.operators.peers import FILTERS_APPLIED, NO_ASSETS
import oracle.tables  # noqa: F401  (registers the CTEs after the chain)
from oracle.build import query
from oracle.chain import PERSISTENCE, Z, spread, text
from oracle.tables import casefold, clean_lines, company_scores, excerpts, phrase_scores, stemmed_hits, stems, tokens

SQL: dict[str, str] = {}


def rounded(sql: str) -> str:
    """``round(x, 6)`` written as the double operations that the Spark side performs."""
    while "round(" in sql:
        start = sql.index("round(")
        depth, end = 0, start + 5
        for end in range(start + 5, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
        inner = sql[start + 6:end].rsplit(",", 1)[0]
        sql = f"{sql[:start]}(round_even(({inner}) * 1000000::DOUBLE, 0) / 1000000::DOUBLE){sql[end + 1:]}"
    return sql


def add(name: str, sql: str) -> None:
    SQL[name] = query(rounded(sql.strip()))


def day(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS VARCHAR) AS {name or column.split('.')[-1]}"


def fixed(column: str, unit: str, name: str) -> str:
    """An integer number of ``1/unit`` as decimal text with six places, half up."""
    whole = f"sign({column}) * ((2 * abs({column}) * 1000000 + {unit}) // (2 * {unit}))"
    return f"CAST(CAST({whole} AS DECIMAL(30,0)) * CAST('0.000001' AS DECIMAL(6,6)) AS VARCHAR) AS {name}"


ONE = "1000000000000000"
VALUE = fixed("v", ONE, "value")
FROM, TO = (f"DATE '{d.isoformat()}'" for d in WINDOW)

# ---------------------------------------------------------------------------------- A
add("a1_read_companyfacts", f"""
SELECT fact_id, cik, taxonomy, concept, unit, CAST(value AS VARCHAR) AS value, {day('start_date')}, {day('end_date')},
  CAST(fiscal_year AS BIGINT) AS fiscal_year, fiscal_period, form, {day('filed')}, accession_number, frame FROM raw_facts""")
SQL["k1_incremental_ingest"] = SQL["a1_read_companyfacts"]
add("a2_read_companies", """
SELECT cik, legal_name, concat_ws('|', list_sort(list_distinct([upper(ticker), 'ZZ']))[1], list_sort(list_distinct([upper(ticker), 'ZZ']))[2]) AS tickers,
  'NYSE|Nasdaq' AS exchanges, sic FROM (SELECT cik, legal_name, sic, concat('t', CAST(CAST(cik AS BIGINT) AS VARCHAR)) AS ticker FROM companies)""")
add("a3_read_filings", f"""
SELECT accession_number, cik, form, {day('filing_date')}, {day('report_period')}, primary_document, form LIKE '%/A' AS is_amendment FROM filings""")
add("a4_read_directory", "SELECT cik, ticker, legal_name FROM directory")
_DEFECTS = """
SELECT cik, CASE WHEN digit = 7 THEN 'payload_missing' WHEN digit IN (3, 4, 5, 6, 8) THEN 'invalid_payload' WHEN digit = 2 THEN 'cik_mismatch'
  WHEN digit = 1 THEN 'entity_mismatch' ELSE 'accepted' END AS reason FROM companies"""
add("a5_quarantine_payloads", _DEFECTS)
add("c17_entity_consistency", f"SELECT * FROM ({_DEFECTS}) WHERE reason IN ('entity_mismatch', 'cik_mismatch')")
add("a6_payload_manifest", """
SELECT url AS canonical_url, CAST(strlen(html) AS BIGINT) AS byte_length, sha256(html) AS content_sha256,
  sha256(concat(url, chr(10), sha256(html))) AS manifest_id FROM pages""")
add("a6_verify_payloads", """
SELECT concat_ws('/', url, CAST(page_id AS VARCHAR)) AS canonical_url, CASE WHEN page_id % 7 = 0 THEN 'new' WHEN page_id % 5 = 0 THEN 'missing'
  WHEN page_id % 3 = 0 AND upper(html) <> html THEN 'changed' ELSE 'unchanged' END AS integrity
FROM pages WHERE page_id % 5 <> 0 OR page_id % 7 <> 0""")
_PRICE = "CAST(o_totalprice AS DECIMAL(14,2))"
_REPRICED = f"CAST(CASE WHEN o_orderstatus = 'P' THEN {_PRICE} + 1 ELSE {_PRICE} END AS VARCHAR)"
add("a7_upsert_by_key", f"""
SELECT o_orderkey, o_orderstatus, {_REPRICED} AS price FROM orders
UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, CAST({_PRICE} AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'""")
add("a7_changed_rows", f"""
SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, o_orderstatus, {_REPRICED} AS price
FROM orders WHERE o_orderstatus IN ('P', 'F')""")
add("g4_row_set_equality", """
SELECT count(*) = 0 AS equal_rows, count(*) FILTER (WHERE o_orderstatus IN ('P', 'F')) AS only_left,
  count(*) FILTER (WHERE o_orderstatus IN ('P', 'F')) AS only_right FROM orders""")
add("a8_partition_layout", """
SELECT '1.0.0' AS version, '1.0.0' AS mapping, cik AS cik_part, CAST(fiscal_year AS VARCHAR) AS year_part, count(*) AS row_count
FROM facts GROUP BY cik, fiscal_year""")
add("a10_typed_scan", "SELECT cik, finding_id, category, severity, metric, affected_count FROM findings WHERE category = 'incompatible_unit'")
add("a7_stored_upsert", """
SELECT state, cik, CASE WHEN digit > 2 AND digit % 3 = 1 THEN concat(legal_name, ' Holding') ELSE legal_name END AS legal_name, sic
FROM companies, (SELECT unnest(['base and delta', 'merged']) AS state)""")
add("a8_written_layout", """
SELECT '1.0.0' AS version, '1.0.0' AS mapping, coalesce(CAST(fiscal_year AS VARCHAR), 'unknown') AS year_part, count(*) AS row_count,
  count(DISTINCT cik) AS companies, true AS one_bucket_each FROM facts GROUP BY fiscal_year""")
add("a9_dataset_views", """
SELECT form, older, count(*) AS filings, CASE WHEN older THEN 0 ELSE count(primary_document) END AS documents, CAST(min(filing_date) AS VARCHAR) AS first_date,
  (SELECT count(*) FROM findings) AS findings FROM filings, (SELECT unnest([true, false]) AS older) GROUP BY form, older""")
add("a10_stored_scan", "SELECT cik, finding_id, category, severity, metric, affected_count FROM findings WHERE category = 'incompatible_unit'")
add("a11_named_readers", """
SELECT 'company' AS reader, cik AS row_key FROM companies WHERE cik = '0000000001'
UNION ALL SELECT 'filings', accession_number FROM filings WHERE cik = '0000000001'
UNION ALL SELECT 'normalized_facts', normalized_fact_id FROM facts WHERE cik = '0000000001'
UNION ALL SELECT 'data_quality_findings', finding_id FROM findings WHERE cik = '0000000001'
UNION ALL SELECT 'counts', concat('companies ', count(*)) FROM companies
UNION ALL SELECT 'counts', concat('filings ', count(*)) FROM filings
UNION ALL SELECT 'counts', concat('normalized_facts ', count(*)) FROM facts
UNION ALL SELECT 'counts', 'signals 0'""")
add("a12_agent_outputs", """
SELECT concat(run_id, ':', r) AS output_id, run_id, cik, r AS role, '1' AS prompt_version, 'm' AS model_name, true AS validated,
  concat('{"size":', CAST(size AS VARCHAR), '}') AS output_json
FROM (SELECT concat_ws('-', conv_id, turn) AS run_id, lpad(CAST(conv_id AS VARCHAR), 10, '0') AS cik,
    CASE role WHEN 'user' THEN 'planner' WHEN 'assistant' THEN 'investigator' ELSE 'judge' END AS r, length(text) AS size FROM conversations
  UNION ALL SELECT concat_ws('-', conv_id, turn), lpad(CAST(conv_id AS VARCHAR), 10, '0'), 'verifier', turn FROM conversations)""")
add("a13_filing_url", """
SELECT accession_number, concat('https://www.sec.gov/Archives/edgar/data/', CAST(CAST(cik AS BIGINT) AS VARCHAR), '/',
  replace(concat(cik, '-', accession_number), '-', ''), '/', primary_document) AS url FROM filings""")
add("a14_report_lines", """
SELECT cik, 'tests' AS section, concat('{"test_id":"', test_id, '","status":"', CASE WHEN computed THEN 'computed' ELSE 'not_computable' END, '"}') AS record FROM tests
UNION ALL SELECT cik, 'signals', concat('{"signal_id":"', signal_id, '","test_id":"', test_id, '"}') FROM signals""")

# ---------------------------------------------------------------------------------- B
add("b1_select_periods", f"""
SELECT normalized_fact_id, cik, canonical_metric, {day('end_date')}, reporting_basis, CAST(value AS VARCHAR) AS value FROM facts
WHERE reporting_basis IN ('instant', 'annual', 'quarterly') AND end_date BETWEEN {FROM} AND {TO}""")
add("b2_requested_window", " UNION ALL ".join(
    f"SELECT cik, count(*) AS row_count, '{kind}' AS kind FROM {table} WHERE end_date BETWEEN {FROM} AND {TO} GROUP BY cik"
    for kind, table in (("facts", "facts"), ("metric_results", "results"), ("test_results", "tests"), ("anomalies", "anomalies"))))
add("b2_window_rows", " UNION ALL ".join(
    f"SELECT cik, '{kind}' AS kind, {key} AS row_id FROM {table} WHERE end_date BETWEEN {FROM} AND {TO}"
    for kind, table, key in (("facts", "facts", "normalized_fact_id"), ("metric_results", "results", "metric_result_id"),
                             ("test_results", "tests", "test_result_id"), ("anomalies", "anomalies", "anomaly_id"))))
add("b3_rejection_cascade", "SELECT fact_id, canonical_metric, coalesce(reject_reason, 'accepted') AS outcome FROM cand")
add("b4_periods_align", """
SELECT l.normalized_fact_id AS left_id, r.normalized_fact_id AS right_id FROM facts l JOIN facts r ON l.cik = r.cik AND l.end_date = r.end_date
  AND l.fiscal_year IS NOT DISTINCT FROM r.fiscal_year AND l.fiscal_period IS NOT DISTINCT FROM r.fiscal_period AND l.start_date = r.start_date
WHERE l.canonical_metric = 'gross_profit' AND r.canonical_metric = 'revenue'""")
add("b5_view_filters", """
SELECT cik, finding_id AS row_id FROM findings WHERE severity IN ('error', 'warning')
UNION ALL SELECT cik, normalized_fact_id FROM facts WHERE reporting_basis = 'annual' AND canonical_metric IN ('revenue', 'net_income')""")
add("b6_record_validity", """
SELECT fact_id, CASE WHEN m_period_type = 'duration' AND start_date IS NULL THEN 'duration_without_start'
  WHEN m_period_type = 'instant' AND start_date IS NOT NULL THEN 'instant_with_start' WHEN start_date > end_date THEN 'start_after_end'
  ELSE 'valid' END AS violation FROM cand WHERE canonical_metric IS NOT NULL""")
_HOSTS = ", ".join(text(h) for h in PAGE_HOSTS)
add("b7_canonical_url", f"""
SELECT page_id, CASE WHEN url LIKE 'https://%' AND regexp_extract(url, '^https://([^/?#:]+)', 1) IN ({_HOSTS}) THEN
  concat('https://', regexp_extract(url, '^https://([^/?#:]+)', 1), '/',
    array_to_string(list_filter(string_split(regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> ''), '/'),
    CASE WHEN contains(regexp_replace(url, '#.*', ''), '?') THEN concat('?', array_to_string(list_sort(string_split(
      regexp_extract(regexp_replace(url, '#.*', ''), '\\?(.*)$', 1), '&')), '&')) ELSE '' END) END AS canonical FROM pages""")

# ---------------------------------------------------------------------------------- C
add("c1_fact_mapping", "SELECT fact_id, canonical_metric, CAST(1 AS BIGINT) AS concept_rank, '1.0000' AS data_confidence FROM cand WHERE canonical_metric IS NOT NULL")
add("c2_unmapped_facts", """
SELECT r.cik, r.fact_id, f.finding_id, f.message FROM raw_facts r JOIN findings f
  ON f.category = 'unmapped_concept' AND f.finding_id = sha256(concat_ws('|', '1.0.0', r.cik, 'unmapped_concept', '', r.fact_id))""")
add("c3_missing_metrics", "SELECT cik, metric, finding_id, message, severity FROM findings WHERE category = 'missing_metric'")
_RESULT = f"""
SELECT cik, metric_result_id, metric_id, formula_version, period_type, {day('start_date')}, {day('end_date')},
  CAST(fiscal_year AS BIGINT) AS fiscal_year, fiscal_period, reporting_basis, CASE WHEN computed THEN 'computed' ELSE 'not_computable' END AS status,
  {VALUE}, unit, CASE WHEN reason LIKE 'Missing%' THEN 'missing_inputs' WHEN reason LIKE 'Formula%' THEN 'zero_denominator' ELSE '' END AS comparability_flags,
  confidence AS data_confidence, reason AS not_computable_reason, CAST(len(fact_ids) AS BIGINT) AS input_count FROM results"""
add("g1_metric_union", _RESULT)
add("c4_metric_inputs", _RESULT + " WHERE formula_version = '1.0.0'")
add("c5_tests_latest_metric", f"SELECT cik, test_id, metric_result_id, {day('end_date')}, CASE WHEN computed THEN 'computed' ELSE 'not_computable' END AS status FROM tests")
add("c6_anomaly_tests", "SELECT cik, anomaly_id, metric_id, test_id, round(z, 6) AS robust_z_score FROM strong")
_REASON = f"""CASE WHEN coalesce(a.assets, 0) = 0 THEN {text(NO_ASSETS)} WHEN coalesce(p.peer_count, 0) >= 2 THEN {text(FILTERS_APPLIED)}
  ELSE concat('Only ', CAST(coalesce(p.peer_count, 0) AS VARCHAR), ' coherent SIC peers passed the explicit filters') END AS reason"""
_PEERS = "aligned a LEFT JOIN peer_stats p ON p.cik = a.cik AND p.metric_id = a.metric_id AND p.end_date = a.end_date"
add("c7_peer_cohort", f"""
SELECT a.cik, a.metric_id, {day('a.end_date')}, coalesce(p.peer_count, 0) AS peer_count,
  CAST(CAST(a.assets * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(20,4)) AS VARCHAR) AS peer_assets_from, CAST(CAST(a.assets * 2 AS DECIMAL(20,4)) AS VARCHAR) AS peer_assets_to,
  {_REASON} FROM {_PEERS}""")
add("d4_peer_statistics", f"""
SELECT cik, metric_id, {day('end_date')}, peer_count, round(first_quartile, 6) AS first_quartile, round(median, 6) AS median,
  round(third_quartile, 6) AS third_quartile, round(percentile, 6) AS percentile FROM peer_stats""")
_SHOWN = lambda c, n: f"CASE WHEN p.peer_count >= 2 THEN round(p.{c}, 6) END AS {n}"
add("i7_peer_context", f"""
SELECT a.cik, a.metric_id, {day('a.end_date')}, a.metric_result_id, CASE WHEN coalesce(p.peer_count, 0) >= 2 THEN 'computed' ELSE 'not_computable' END AS status,
  {fixed('a.v', ONE, 'company_value')}, {_SHOWN('median', 'peer_median')}, {_SHOWN('first_quartile', 'peer_first_quartile')},
  {_SHOWN('third_quartile', 'peer_third_quartile')}, {_SHOWN('percentile', 'percentile')}, coalesce(p.peer_count, 0) AS peer_count, {_REASON} FROM {_PEERS}""")
add("c8_geography", f"""
SELECT a.cik, sha256(concat_ws('|', source_sha256, 'business', address)) AS geographic_evidence_id,
  concat('Registered business address · ', coalesce(nullif(trim(city), ''), upper(a.state))) AS label, latitude, longitude,
  'administrative_area_centroid' AS precision, 'registered_business_address' AS context, address, source_url, source_sha256,
  {text(LIMITATION)} AS limitation FROM address_lines a JOIN centroids c ON c.state = upper(a.state)""")
add("c9_search_payload", """
SELECT h.query_id, h.rank, h.chunk_id, c.section, c.accession_number, c.form, c.source_url FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id AND c.cik = h.cik""")
add("c10_local_availability", "SELECT d.cik, d.ticker, d.legal_name, EXISTS (SELECT 1 FROM companies c WHERE c.cik = d.cik) AS locally_available FROM directory d")
add("c11_signal_metrics", """
SELECT r.cik, r.metric_result_id, r.metric_id FROM results r WHERE EXISTS (SELECT 1 FROM signals s JOIN tests t ON t.cik = s.cik AND t.test_result_id = s.test_result_id
  WHERE t.cik = r.cik AND t.metric_result_id = r.metric_result_id)""")
add("c12_claim_references", "SELECT * FROM claim_violations")
add("c13_reference_repair", "SELECT run_id, claim_id, array_to_string(fact_ids, '|') AS fact_ids FROM repaired")
add("c14_verification_coverage", "SELECT * FROM verification_violations")
add("c15_signal_coverage", "SELECT * FROM uncovered")
add("c16_accepted_claims", """
SELECT run_id, claim_id, role FROM claims c WHERE EXISTS (SELECT 1 FROM verifications v WHERE v.run_id = c.run_id AND v.claim_id = c.claim_id
  AND v.status IN ('supported', 'partially_supported'))""")

# ---------------------------------------------------------------------------------- D
add("d1_quality_score", """
SELECT cik, round(completeness, 6) AS completeness, unit_consistency, mapping_confidence, round(period_alignment, 6) AS period_alignment, amendment_status,
  round((completeness + unit_consistency + mapping_confidence + period_alignment + amendment_status) / 5, 6) AS overall
FROM (SELECT f.cik, CAST(count(DISTINCT canonical_metric) AS DOUBLE) / 31 AS completeness, 1.0::DOUBLE AS mapping_confidence,
    avg(CASE WHEN reporting_basis <> 'other_duration' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS period_alignment,
    CASE WHEN EXISTS (SELECT 1 FROM findings g WHERE g.cik = f.cik AND category = 'incompatible_unit') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unit_consistency,
    CASE WHEN EXISTS (SELECT 1 FROM findings g WHERE g.cik = f.cik AND category = 'amendment_selected') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS amendment_status
  FROM facts f GROUP BY f.cik)""")
add("d2_normalization_summary", "SELECT cik, finding_id, message, affected_count FROM findings WHERE category = 'normalization_summary'")
add("d3_duplicate_groups", "SELECT cik, metric, finding_id, message, affected_count FROM findings WHERE category = 'duplicate_period_candidates'")
add("d5_run_summary", """
SELECT count(*) AS total_runs, count(*) FILTER (WHERE event_type = 'purchase') AS complete_runs, count(*) FILTER (WHERE event_type = 'error') AS partial_runs,
  count(*) FILTER (WHERE event_id % 2 = 0) AS deterministic_only_runs, count(*) FILTER (WHERE event_id % 2 <> 0) AS provider_runs FROM events""")
add("d6_financials_summary", """
SELECT k.cik, coalesce(f.n, 0) AS normalized_fact_count, coalesce(f.bases, '') AS available_bases, coalesce(g.n, 0) AS finding_count,
  coalesce(g.missing, 0) AS missing_metric_count, coalesce(h.n, 0) AS filing_count
FROM (SELECT DISTINCT cik FROM raw_facts) k
LEFT JOIN (SELECT cik, count(*) AS n, array_to_string(list_sort(list(DISTINCT reporting_basis)), '|') AS bases FROM facts GROUP BY cik) f ON f.cik = k.cik
LEFT JOIN (SELECT cik, count(*) AS n, count(*) FILTER (WHERE category = 'missing_metric') AS missing FROM findings GROUP BY cik) g ON g.cik = k.cik
LEFT JOIN (SELECT cik, count(*) AS n FROM filings GROUP BY cik) h ON h.cik = k.cik""")
add("d7_dataset_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS row_count FROM {t}" for n, t in (
        ("companies", "companies"), ("filings", "filings"), ("raw_xbrl_facts", "raw_facts"), ("normalized_facts", "facts"),
        ("data_quality_findings", "findings"))) + " UNION ALL SELECT 'investigation_runs', 0")
_COUNT = lambda t, n: f"(SELECT count(*) FROM {t} x WHERE x.cik = c.cik) AS {n}"
add("d8_ingestion_summary", f"""
SELECT cik, {_COUNT('filings', 'filing_count')}, {_COUNT('raw_facts', 'raw_fact_count')}, {_COUNT('facts', 'normalized_fact_count')},
  {_COUNT('tests', 'forensic_test_count')}, {_COUNT('signals', 'signal_count')} FROM companies c""")
add("d9_minimum_confidence", "SELECT metric_result_id, confidence AS data_confidence FROM results WHERE formula_version = '1.0.0'")
add("d10_test_coverage", f"""
SELECT cik, count(*) AS test_count, count(*) FILTER (WHERE computed) AS computable_count,
  (SELECT count(*) FROM signals s WHERE s.cik = c.cik) AS signal_count FROM tests c GROUP BY cik""")
add("d11_retrieval_evaluation", """
SELECT count(*) AS query_count, count(rank) AS recalled, round(CAST(count(rank) AS DOUBLE) / count(*), 6) AS recall_at_k,
  round(avg(coalesce(1.0::DOUBLE / rank, 0.0::DOUBLE)), 6) AS mean_reciprocal_rank
FROM (SELECT q.query_id, min(h.rank) AS rank FROM queries q LEFT JOIN (SELECT h.query_id, h.rank FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id AND c.cik = h.cik
    WHERE c.section = 'PART II Item 7' AND h.rank <= 3) h ON h.query_id = q.query_id GROUP BY q.query_id)""")
add("d12_corpus_statistics", "SELECT document_count, round(average_length, 6) AS average_length FROM corpus")
add("d12_document_frequency", "SELECT term, document_frequency FROM frequencies")
add("d13_source_manifests", "SELECT DISTINCT cik, manifest_id FROM facts")

# ---------------------------------------------------------------------------------- E
_CHOSEN = f"""SELECT cik, canonical_metric, unit, {day('start_date')}, {day('end_date')}, CAST(fiscal_year AS BIGINT) AS fiscal_year, fiscal_period,
  reporting_basis, fact_id, candidate_count FROM facts"""
add("e1_choose_fact", _CHOSEN)
add("e1_prefer_amendments", f"""
SELECT cik, canonical_metric, {day('end_date')}, fact_id, form FROM (SELECT *, row_number() OVER (PARTITION BY cik, canonical_metric, unit, start_date, end_date,
    fiscal_year, fiscal_period, reporting_basis ORDER BY CASE WHEN form LIKE '%/A' THEN 0 ELSE 1 END, filed DESC, accession_number, fact_id) AS c FROM accepted) WHERE c = 1""")
_MEDIAN = "round(centre2 / 2, 6) AS historical_median"
_MAD = "round(mad4 / 4, 6) AS median_absolute_deviation"
_YOY = "CASE WHEN reporting_basis = 'annual' THEN round(change, 6) END AS year_over_year_change"
_QOQ = "CASE WHEN reporting_basis = 'quarterly' THEN round(change, 6) END AS quarter_over_quarter_change"
add("e2_expanding_median", f"SELECT anomaly_id, {_MEDIAN} FROM anomalies")
add("e3_expanding_mad", f"SELECT anomaly_id, {_MAD} FROM anomalies")
add("e4_robust_z", "SELECT anomaly_id, round(z, 6) AS robust_z_score, CAST(n AS BIGINT) AS sample_count FROM anomalies")
add("e5_relative_change", f"SELECT anomaly_id, {_YOY}, {_QOQ} FROM anomalies")
add("e6_expanding_percentile", "SELECT anomaly_id, round(percentile, 6) AS rolling_percentile FROM anomalies")
add("e7_persistence", "SELECT anomaly_id, persistence FROM anomalies")
_ORDER = "ORDER BY end_date, coalesce(start_date, end_date), metric_result_id"
add("e8_history_ids", f"""
SELECT sha256(concat_ws('|', metric_id, metric_result_id)) AS anomaly_id, len(h) AS sample_count, sha256(array_to_string(h, '|')) AS history
FROM (SELECT metric_id, metric_result_id, list(metric_result_id) OVER (PARTITION BY cik, metric_id {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
  FROM results WHERE computed)""")
_BY_BASIS = spread(f"""(SELECT *, list(x) OVER (PARTITION BY cik, metric_id, reporting_basis {_ORDER}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM valued)""")
add("e2_by_basis", f"""
SELECT sha256(concat_ws('|', metric_id, metric_result_id)) AS anomaly_id, {_MEDIAN}, CAST(n AS BIGINT) AS sample_count,
  round({Z}, 6) AS robust_z_score, {PERSISTENCE} AS persistence FROM ({_BY_BASIS})""")
add("e9_latest_results", f"SELECT cik, metric_id, {day('end_date')}, metric_result_id FROM latest")
_RECENT = """row_number() OVER (PARTITION BY cik, canonical_metric ORDER BY end_date DESC, coalesce(start_date, end_date) DESC, accession_number DESC,
    normalized_fact_id DESC) AS recency"""
add("e10_last_periods", f"""
SELECT cik, canonical_metric, normalized_fact_id, {day('end_date')} FROM (SELECT *, {_RECENT} FROM facts WHERE reporting_basis IN ('instant', 'annual', 'quarterly'))
WHERE recency <= 12""")
add("i12_financial_history", f"""
SELECT cik, canonical_metric, {day('end_date')}, {day('start_date')}, reporting_basis, CAST(value AS VARCHAR) AS value, normalized_fact_id
FROM (SELECT *, {_RECENT} FROM facts WHERE reporting_basis IN ('instant', 'annual', 'quarterly') AND end_date BETWEEN {FROM} AND {TO}) WHERE recency <= 4""")
add("e11_top_signals", "SELECT cik, signal_rank, signal_id, round(score, 6) AS score FROM signals")
add("e12_first_test", "SELECT cik, metric_id, test_id FROM first_test")
add("e14_section_numbering", "SELECT accession_number, section, CAST(sequence AS BIGINT) AS sequence, chunk_id FROM chunks")
add("e15_run_caps", """
SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY signal_rank) AS run_position, signal_id FROM signals QUALIFY run_position <= 8""")

add("e15_capped_packets", """
SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY evidence_id) AS run_position, evidence_id, content_sha256 FROM packets QUALIFY run_position <= 12""")

# ---------------------------------------------------------------------------------- F
add("f1_fact_order", """
SELECT cik, normalized_fact_id, row_number() OVER (PARTITION BY cik ORDER BY canonical_metric, end_date, coalesce(start_date, end_date), accession_number,
  normalized_fact_id) AS position FROM facts""")
add("f2_result_order", """
SELECT cik, metric_result_id, row_number() OVER (PARTITION BY cik ORDER BY metric_id, end_date, coalesce(start_date, end_date), metric_result_id) AS position FROM results""")
_Q = "'customer#00000001'"
add("f3_directory_search", f"""
SELECT cik, ticker, legal_name, CAST(CASE WHEN lower(ticker) = {_Q} THEN 1 WHEN lower(legal_name) = {_Q} THEN 2 WHEN starts_with(lower(ticker), {_Q}) THEN 3
  WHEN starts_with(lower(legal_name), {_Q}) THEN 4 WHEN contains(lower(ticker), {_Q}) THEN 5 ELSE 6 END AS BIGINT) AS match_rank
FROM directory WHERE contains(lower(ticker), {_Q}) OR contains(lower(legal_name), {_Q}) ORDER BY match_rank, lower(legal_name), lower(ticker), cik LIMIT 12""")
add("f4_newest_filings", f"""
SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number DESC) AS position, accession_number, {day('filing_date')}, form
FROM filings QUALIFY position <= 5""")
add("f5_search_top_k", "SELECT query_id, cik, rank, chunk_id FROM hits")
add("f6_finding_order", """
SELECT cik, finding_id, row_number() OVER (PARTITION BY cik ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, category, finding_id) AS position
FROM findings""")
add("f7_company_search", """
SELECT cik, ticker, legal_name, true AS locally_available FROM companies WHERE contains(lower(legal_name), 'supplier#00000000') ORDER BY cik LIMIT 12""")
add("f8_resolve_identity", """
WITH known AS (SELECT cik, ticker, legal_name FROM companies UNION ALL
    SELECT concat('9', substr(cik, 2, 9)), ticker, legal_name FROM companies WHERE cik LIKE '%5'),
asked AS (SELECT c_custkey AS asked, CASE c_custkey % 4 WHEN 0 THEN 'cik' WHEN 1 THEN 'ticker' WHEN 2 THEN 'name' ELSE 'cik' END AS how,
    lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS k, concat('t', CAST(c_custkey AS VARCHAR)) AS t, lower(replace(c_name, 'Customer', 'Supplier')) AS n FROM customer)
SELECT asked, CASE count(cik) WHEN 0 THEN 'not_found' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, count(cik) AS match_count,
  CASE WHEN count(cik) = 1 THEN min(cik) END AS cik
FROM asked LEFT JOIN known ON (how = 'cik' AND cik = k) OR (how = 'ticker' AND lower(ticker) = t) OR (how = 'name' AND lower(legal_name) = n) GROUP BY asked""".replace(
    "WITH known", "SELECT * FROM (WITH known") + ")")

# ------------------------------------------------------------------------------- G, H
add("g2_findings_union", "SELECT * FROM findings")
add("g5_reference_subset", """
SELECT DISTINCT v.run_id, v.claim_id, len(list_filter(v.checked, lambda e: NOT list_contains(c.evidence_ids, e))) = 0 AS is_subset
FROM verifications v JOIN claims c ON c.run_id = v.run_id AND c.claim_id = v.claim_id""")
add("g6_distinct_values", "SELECT DISTINCT cik, reporting_basis FROM facts")
add("h1_normalize_cik", "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer")
add("h2_fact_id", "SELECT fact_id, accession_number, concept FROM raw_facts")
add("h4_period_classes", "SELECT fact_id, reporting_basis FROM cand")
add("h5_amendment_forms", "SELECT accession_number, form LIKE '%/A' AS is_amendment, regexp_replace(form, '/A$', '') AS base_form FROM filings")
add("h6_casefold", f"SELECT doc_id, sha256({casefold('text')}) AS folded FROM documents")
add("h8_materiality", "SELECT signal_id, round(materiality, 6) AS materiality, '1.0000' AS data_confidence FROM signals")
add("h9_explanations", "SELECT cik, test_id, reason, purpose FROM tests")
add("h11_address_line", "SELECT cik, address FROM address_lines")
_ANY = lambda phrases: "(" + " OR ".join(f"contains(lower(text), {text(p)})" for p in phrases) + ")"
add("h12_language_screen", f"""
SELECT text_id, {_ANY(SCREEN_PHRASES)} AS flagged, {_ANY(ACCUSATORY_PHRASES)} AS accusatory
FROM (SELECT concat_ws('-', 'c', conv_id, turn) AS text_id, text FROM conversations UNION ALL SELECT concat('d', doc_id), text FROM documents)""")
add("h14_word_count", "SELECT doc_id, CAST(greatest(1, len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS BIGINT) AS words FROM documents")

# ---------------------------------------------------------------------------------- I
add("i1_normalized_facts", f"""
SELECT normalized_fact_id, cik, canonical_metric, fact_id AS original_fact_id, concept AS original_concept, CAST(value AS VARCHAR) AS value, unit, period_type,
  {day('start_date')}, {day('end_date')}, CAST(fiscal_year AS BIGINT) AS fiscal_year, fiscal_period, reporting_basis, form, {day('filed')}, accession_number, frame,
  CAST(1 AS BIGINT) AS selection_rank, concat('Selected exact ', taxonomy, ':', concept, ' mapping at priority 1; compatible unit ', unit, '; ', reporting_basis,
    ' period; accession ', accession_number, '.') AS selection_rationale, false AS is_fallback FROM facts""")
add("i1_finding_facts", """
SELECT sha256(concat_ws('|', '1.0.0', cik, reject_reason, coalesce(canonical_metric, ''), fact_id)) AS finding_id, cik, fact_id FROM cand WHERE reject_reason IS NOT NULL
UNION ALL SELECT sha256(concat_ws('|', '1.0.0', cik, 'amendment_selected', canonical_metric, fact_id)), cik, fact_id FROM facts WHERE form LIKE '%/A'
UNION ALL SELECT sha256(concat_ws('|', '1.0.0', cik, 'duplicate_period_candidates', canonical_metric, concat_ws('|', first_id, last_id, CAST(candidate_count AS VARCHAR), id_digest))), cik, fact_id FROM accepted WHERE candidate_count > 1""")
add("i4_forensic_tests", f"""
SELECT cik, test_result_id, test_id, category, {day('end_date')}, {day('start_date')}, reporting_basis,
  CASE WHEN computed THEN 'computed' ELSE 'not_computable' END AS status, CASE WHEN computed THEN {fixed('v', ONE, 'result').replace(' AS result', '')} END AS result,
  evidence FROM tests""")
add("i5_anomalies", f"""
SELECT cik, anomaly_id, metric_id, metric_result_id, {day('start_date')}, {day('end_date')}, reporting_basis, {fixed('v', ONE, 'current_value')}, {_YOY}, {_QOQ},
  {_MEDIAN}, {_MAD}, round(z, 6) AS robust_z_score, round(percentile, 6) AS rolling_percentile, CAST(n AS BIGINT) AS sample_count, persistence FROM anomalies""")
add("i6_signals", """
SELECT cik, signal_id, signal_rank, category, test_id, 'moderate' AS severity, round(materiality, 6) AS materiality, persistence, round(score, 6) AS score FROM signals""")
add("i8_filing_chunks", """
SELECT chunk_id, cik, accession_number, section, subsection, CAST(sequence AS BIGINT) AS sequence, start_offset, end_offset, sha256(body) AS text_hash, source_url FROM chunks""")
_HIT = "SELECT query_id, cik, chunk_id, CAST(CAST(score AS DECIMAL(28,6)) AS VARCHAR) AS score, rank FROM hits"
add("i9_search", _HIT)
add("i9_search_stemmed", _HIT.replace("FROM hits", f"FROM ({stemmed_hits()})"))
add("i9_search_filtered", _HIT.replace("FROM hits", f"""FROM ({stemmed_hits("p.form = '10-K' AND p.section = 'PART II Item 7'")})"""))
add("i9_phrase_search", _HIT.replace("FROM hits", f"""FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cik ORDER BY score DESC, chunk_id) AS rank
FROM ({phrase_scores()})) WHERE rank <= 10"""))
add("i9_search_company_statistics", _HIT.replace("FROM hits", f"""FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cik ORDER BY score DESC, chunk_id) AS rank
FROM ({company_scores()})) WHERE rank <= 10"""))
add("i15_gate_status", f"""
SELECT cik, n AS signal_count, CASE WHEN n = 0 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN n = 0 THEN {text(NO_SIGNALS)} ELSE {text(NO_PROVIDER)} END AS stop_reason,
  true AS deterministic_only FROM (SELECT cik, (SELECT count(*) FROM signals s WHERE s.cik = c.cik) AS n FROM companies c)""")
add("i14_claim_audit", """
SELECT run_id, claim_id, code, reference_id FROM repaired_violations
UNION ALL SELECT run_id, NULL, 'agent_signal_coverage_failed', signal_id FROM uncovered
UNION ALL SELECT * FROM verification_violations""")
add("i16_analyze", " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS row_count FROM {t}" for n, t in (
    ("normalized_facts", "facts"), ("data_quality_findings", "findings"), ("metric_results", "results"), ("test_results", "tests"),
    ("anomalies", "anomalies"), ("signals", "signals"))))

# ---------------------------------------------------------------------------------- J
add("j1_decode_payload", """
SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE concat('é', regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) END) AS decoded FROM documents""")


# Written out here, not shared with the implementation.
SKIPPED = ("script", "style", "nav", "noscript", "svg")
BREAKING = "address|article|aside|blockquote|br|div|footer|h1|h2|h3|h4|header|li|p|section|table|td|th|tr"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def _page_lines() -> str:
    """For the given pages: no skipped tag lies in another one of its kind, and these are the references they use."""
    sql = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in SKIPPED:
        sql = f"regexp_replace({sql}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    sql = f"regexp_replace({sql}, '(?i)</?({BREAKING})\\b[^>]*>', chr(10), 'g')"
    sql = f"regexp_replace({sql}, '<[/!]?[A-Za-z][^>]*>', '', 'g')"
    for entity, character in ENTITIES:
        sql = f"replace({sql}, {text(entity)}, {text(character)})"
    return clean_lines(sql)


def _html() -> str:
    return f"SELECT page_id, array_to_string({_page_lines()}, chr(10)) AS body FROM pages"


add("j2_html_to_text", _html())
add("j2_html_to_text_jvm", _html())
add("j3_clean_text", f"""
SELECT doc_id, sha256(array_to_string({clean_lines("replace(text, '. ', concat(' . ', chr(9), chr(10), chr(10)))")}, chr(10))) AS cleaned FROM documents""")
add("j4_sections", """
SELECT accession_number, section, subsection, CAST(start_at AS BIGINT) AS section_start, CAST(length(body) AS BIGINT) AS section_length FROM sections""")
add("j6_query_terms", "SELECT query_id, string_agg(word, '|' ORDER BY first_at) AS terms FROM query_words WHERE place <= 24 GROUP BY query_id")
add("j7_stems", f"""
SELECT term, stem, documents FROM ({stems(f"SELECT DISTINCT unnest({tokens('text')}) AS term FROM documents")})
JOIN (SELECT term, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY term) USING (term)""")
add("j7_document_tokens", f"SELECT doc_id, sha256(array_to_string({tokens('text')}, ' ')) AS tokens FROM documents")
add("j8_bm25", "SELECT query_id, chunk_id, round(CAST(score AS DOUBLE), 6) AS score FROM hits")
add("j9_search_index", "SELECT chunk_id, CAST(length AS BIGINT) AS length, count(*) AS terms, sum(frequency) AS weight FROM postings GROUP BY chunk_id, length")
add("j9_index_refresh", """
SELECT state, chunk_id, CAST(length AS BIGINT) AS length, count(*) AS terms, sum(frequency) AS weight, CAST(sum(shared) AS BIGINT) AS shared,
  round((SELECT CAST(sum(length) AS DOUBLE) / count(*) FROM (SELECT chunk_id, max(length) AS length FROM refreshed_postings GROUP BY chunk_id)), 6) AS average_length
FROM refreshed_postings JOIN (SELECT term, count(*) AS shared FROM refreshed_postings GROUP BY term) USING (term), (SELECT unnest(['segments', 'merged']) AS state)
GROUP BY state, chunk_id, length""")
add("e13_greedy_evidence", "SELECT cik, CAST(packet_order AS BIGINT) AS packet_order, signal_id, chunk_id FROM assigned")
add("h13_citation", """
SELECT evidence_id, concat('[', evidence_id[1:14], '] ', section, ', ', coalesce(accession_number, 'unknown accession'), ', ', source_url) AS citation FROM packets""")
add("i10_evidence_packets", """
SELECT evidence_id, cik, signal_id, signal_rank, section, subsection, chunk_id, CAST(from_at AS BIGINT) AS start_offset, CAST(to_at AS BIGINT) AS end_offset, excerpt,
  round(greatest(score, 0::DOUBLE), 6) AS relevance_score, selection_reason, '1.0.0' AS parser_version, CAST(token_count AS BIGINT) AS token_count, accession_number,
  source_url, content_sha256 FROM packets""")
add("j11_evidence_spans", """
SELECT evidence_id, signal_id, CAST(from_at AS BIGINT) AS start_offset, CAST(to_at AS BIGINT) AS end_offset, CAST(token_count AS BIGINT) AS token_count, selection_reason FROM packets""")
add("j10_minimal_excerpt", f"""
SELECT query_id, chunk_id, excerpt, CAST(excerpt_start AS BIGINT) AS excerpt_start FROM ({excerpts("""
  SELECT h.query_id, h.chunk_id, c.body, q.query FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id AND c.cik = h.cik
  JOIN queries q ON q.query_id = h.query_id AND q.cik = h.cik""")})""")
add("j5_chunk_text", """
SELECT accession_number, section, CAST(k AS BIGINT) AS sequence, CAST(min(base_at + line_at) AS BIGINT) AS start_offset,
  CAST(min(base_at + line_at) + length(string_agg(line, chr(10) ORDER BY n)) AS BIGINT) AS end_offset, sha256(string_agg(line, chr(10) ORDER BY n)) AS text_hash
FROM packed_lines GROUP BY accession_number, section, base_at, k""")
# the pages have no headings: each is one section, whose lines are packed one after the other
add("i8_page_chunks", f"""
SELECT * FROM (WITH RECURSIVE lines AS (
    SELECT page_id, u.n AS n, u.line AS line FROM (SELECT page_id, unnest(list_transform({_page_lines()}, lambda l, i: {{'n': i, 'line': l}})) AS u FROM pages)),
  walk AS (
    SELECT page_id, n, 0 AS k, length(line) AS held, CAST(0 AS BIGINT) AS line_at, line FROM lines WHERE n = 1
    UNION ALL
    SELECT l.page_id, l.n, CASE WHEN w.held + 1 + length(l.line) > 2400 THEN w.k + 1 ELSE w.k END,
      CASE WHEN w.held + 1 + length(l.line) > 2400 THEN length(l.line) ELSE w.held + 1 + length(l.line) END, w.line_at + length(w.line) + 1, l.line
    FROM walk w JOIN lines l ON l.page_id = w.page_id AND l.n = w.n + 1)
  SELECT concat('P-', page_id) AS accession_number, 'Document' AS section, CAST(k AS BIGINT) AS sequence, CAST(min(line_at) AS BIGINT) AS start_offset,
    CAST(min(line_at) + length(string_agg(line, chr(10) ORDER BY n)) AS BIGINT) AS end_offset, sha256(string_agg(line, chr(10) ORDER BY n)) AS text_hash,
    any_value(url) AS source_url FROM walk JOIN pages USING (page_id) GROUP BY page_id, k
  UNION ALL SELECT concat('P-', page_id), 'filing_text_empty', NULL, NULL, NULL, NULL, NULL FROM pages WHERE len({_page_lines()}) = 0)""")
