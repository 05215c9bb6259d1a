"""Normalisation, metrics, tests, anomalies and signals."""

from __future__ import annotations

from factlode.registries import FINDING_CLASSES, FORMULAS, MAPPINGS, TESTS
from oracle.build import cte


def double(units: str) -> str:
    """An integer number of 1e-15 as the nearest double (through its decimal text)."""
    return (f"CAST(CAST(CAST({units} AS DECIMAL(23,0)) * CAST('0.000000000000001' AS DECIMAL(15,15)) AS VARCHAR) AS DOUBLE)")


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


cte("raw_base", """
WITH li AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR(20)), 10, '0') AS cik, CAST(l_shipdate AS DATE) AS d,
         CAST(year(l_shipdate) AS INT) AS fy, CAST(quarter(l_shipdate) AS INT) AS q,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS ext, CAST(l_discount AS DECIMAL(4,2)) AS disc,
         CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(l_quantity AS DECIMAL(12,2)) AS qty, l_returnflag AS rf
  FROM lineitem),
per AS (
  SELECT 'Q' AS kind, CAST(date_trunc('quarter', d) AS DATE) AS start_date, concat('Q', CAST(q AS VARCHAR(2))) AS fp, '10-Q' AS form,
         CAST(date_trunc('quarter', d) + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE) AS end_date, li.* FROM li
  UNION ALL
  SELECT 'A', CAST(date_trunc('year', d) AS DATE), 'FY', '10-K',
         CAST(date_trunc('year', d) + INTERVAL '12' MONTH - INTERVAL '1' DAY AS DATE), li.* FROM li
  UNION ALL
  SELECT 'Y', CAST(date_trunc('year', d) AS DATE), concat('Q', CAST(t.yq AS VARCHAR(2))), '10-Q',
         CASE WHEN t.yq = 2 THEN CAST(date_trunc('year', d) + INTERVAL '6' MONTH - INTERVAL '1' DAY AS DATE)
              ELSE CAST(date_trunc('year', d) + INTERVAL '9' MONTH - INTERVAL '1' DAY AS DATE) END, li.*
  FROM li CROSS JOIN (VALUES (2), (3)) AS t(yq) WHERE li.q <= t.yq),
w AS (
  SELECT cik, kind, start_date, end_date, fy, fp, form, CAST(substr(cik, 10, 1) AS INT) AS digit,
         CAST(count(*) AS INT) AS n, CAST(sum(ext) AS DECIMAL(18,4)) AS ext,
         CAST(sum(CAST(ext * disc AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS disc,
         CAST(sum(CAST(ext * tax AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS tax, CAST(sum(qty) AS DECIMAL(18,4)) AS qty,
         CAST(sum(CASE WHEN rf = 'R' THEN ext ELSE 0 END) AS DECIMAL(18,4)) AS ret,
         CAST(sum(CASE WHEN rf = 'A' THEN ext ELSE 0 END) AS DECIMAL(18,4)) AS acc
  FROM per GROUP BY cik, kind, start_date, end_date, fy, fp, form),
f AS (
  SELECT w.*, c.concept, c.unit AS unit0, c.ptype, CAST(CASE c.concept
      WHEN 'Revenues' THEN ext WHEN 'SalesRevenueNet' THEN ext WHEN 'GrossProfit' THEN ext - disc * CASE WHEN fy = 2000 AND fp = 'Q4' AND digit IN (2, 4, 6) THEN 15 ELSE 5 END
      WHEN 'OperatingIncomeLoss' THEN ext - disc * 5 - tax * 5
      WHEN 'SellingGeneralAndAdministrativeExpense' THEN disc * 2 WHEN 'ResearchAndDevelopmentExpense' THEN tax * CASE WHEN fy = 2000 AND fp = 'Q4' AND digit IN (2, 4, 6) THEN 30 ELSE 2 END
      WHEN 'IncomeTaxExpenseBenefit' THEN tax
      WHEN 'IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest' THEN ext - disc * 4 - tax * 4
      WHEN 'NetIncomeLoss' THEN ext - disc * 4 - tax * 5 WHEN 'NetCashProvidedByUsedInOperatingActivities' THEN ext - disc * 3 - ret
      WHEN 'PaymentsToAcquirePropertyPlantAndEquipment' THEN tax * 3 WHEN 'ShareBasedCompensation' THEN disc
      WHEN 'PaymentsForRepurchaseOfCommonStock' THEN ret
      WHEN 'WeightedAverageNumberOfSharesOutstandingBasic' THEN n * 100
      WHEN 'WeightedAverageNumberOfDilutedSharesOutstanding' THEN n * 100 + qty
      WHEN 'Assets' THEN ext * 2 WHEN 'Liabilities' THEN ext + ret WHEN 'AssetsCurrent' THEN acc + qty
      WHEN 'LiabilitiesCurrent' THEN CASE WHEN n % 7 = 0 THEN 0 ELSE ret END
      WHEN 'StockholdersEquity' THEN ext - ret WHEN 'LongTermDebt' THEN disc * 4 WHEN 'Goodwill' THEN tax
      WHEN 'AccountsReceivableNetCurrent' THEN acc WHEN 'InventoryNet' THEN qty * 10 WHEN 'AccountsPayableCurrent' THEN ret
    END AS DECIMAL(20,4)) AS value
  FROM w CROSS JOIN (VALUES
    ('Revenues','USD','duration'), ('SalesRevenueNet','USD','duration'), ('GrossProfit','USD','duration'),
    ('OperatingIncomeLoss','USD','duration'), ('SellingGeneralAndAdministrativeExpense','USD','duration'),
    ('ResearchAndDevelopmentExpense','USD','duration'), ('IncomeTaxExpenseBenefit','USD','duration'),
    ('IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest','USD','duration'),
    ('NetIncomeLoss','USD','duration'), ('NetCashProvidedByUsedInOperatingActivities','USD','duration'),
    ('PaymentsToAcquirePropertyPlantAndEquipment','USD','duration'), ('ShareBasedCompensation','USD','duration'),
    ('PaymentsForRepurchaseOfCommonStock','USD','duration'),
    ('WeightedAverageNumberOfSharesOutstandingBasic','shares','duration'),
    ('WeightedAverageNumberOfDilutedSharesOutstanding','shares','duration'),
    ('Assets','USD','instant'), ('Liabilities','USD','instant'), ('AssetsCurrent','USD','instant'),
    ('LiabilitiesCurrent','USD','instant'), ('StockholdersEquity','USD','instant'), ('LongTermDebt','USD','instant'),
    ('Goodwill','USD','instant'), ('AccountsReceivableNetCurrent','USD','instant'), ('InventoryNet','USD','instant'),
    ('AccountsPayableCurrent','USD','instant')) AS c(concept, unit, ptype)
  WHERE NOT (w.kind = 'Y' AND c.ptype = 'instant')
    AND NOT (c.concept = 'PaymentsToAcquirePropertyPlantAndEquipment' AND w.digit = 5)),
g AS (
  SELECT f.*, 0 AS amended FROM f
  UNION ALL
  SELECT f.*, 1 FROM f WHERE kind = 'A' AND fy % 2 = 0 AND concept IN ('Revenues', 'NetIncomeLoss', 'Assets'))
SELECT cik, 'us-gaap' AS taxonomy, concept,
       CASE WHEN concept = 'InventoryNet' AND digit = 3 THEN 'EUR' ELSE unit0 END AS unit,
       CAST(value + amended * 100 AS DECIMAL(20,4)) AS value,
       CASE WHEN ptype = 'instant' AND NOT (concept = 'Goodwill' AND digit = 7) THEN NULL ELSE start_date END AS start_date,
       end_date, fy AS fiscal_year, fp AS fiscal_period,
       CASE WHEN kind = 'A' AND digit = 9 THEN '20-F' WHEN amended = 1 THEN concat(form, '/A') ELSE form END AS form,
       CAST(end_date + INTERVAL '1' DAY * (30 + 60 * amended) AS DATE) AS filed,
       concat(cik, '-', CAST(fy AS VARCHAR(4)), '-', kind, fp, CASE WHEN amended = 1 THEN '-A' ELSE '' END) AS accession_number,
       CASE WHEN kind = 'Y' OR fy % 2 = 1 THEN NULL
            ELSE concat('CY', CAST(fy AS VARCHAR(4)), CASE WHEN kind = 'Q' THEN fp ELSE '' END,
                        CASE WHEN ptype = 'instant' OR (concept = 'NetIncomeLoss' AND digit = 1 AND fp = 'Q4') THEN 'I' ELSE '' END) END AS frame
FROM g
""")

cte("raw_facts", """
SELECT *, CAST(NULL AS INT) AS decimals,
  sha256(concat_ws('|', cik, taxonomy, concept, unit, CAST(value AS VARCHAR), coalesce(CAST(start_date AS VARCHAR), ''),
    CAST(end_date AS VARCHAR), accession_number)) AS fact_id,
  sha256(concat('companyfacts|', cik)) AS manifest_id
FROM raw_base
""")

cte("mapping", "SELECT * FROM (VALUES " + ", ".join(
    f"({text(m.metric)}, {text(m.concepts[0].taxonomy)}, {text(m.concepts[0].name)}, {text(m.period_type)}, {text(m.units[0])})"
    for m in MAPPINGS) + ") AS t(canonical_metric, m_taxonomy, m_concept, m_period_type, m_unit)")

cte("cand", """
SELECT *, CASE WHEN canonical_metric IS NULL THEN 'unmapped_concept'
    WHEN unit <> m_unit THEN 'incompatible_unit'
    WHEN period_type <> m_period_type THEN 'incompatible_period_type'
    WHEN regexp_replace(form, '/A$', '') NOT IN ('10-K', '10-Q') THEN 'unsupported_form'
    WHEN period_type = 'duration' AND coalesce(regexp_matches(frame, '^CY[0-9]{4}(Q[1-4])?I$'), false) THEN 'invalid_period_context'
  END AS reject_reason,
  CASE WHEN period_type = 'instant' THEN 'instant'
    WHEN regexp_matches(frame, '^CY[0-9]{4}$') THEN 'annual'
    WHEN regexp_matches(frame, '^CY[0-9]{4}Q[1-4]$') THEN 'quarterly'
    WHEN days BETWEEN 335 AND 395 THEN 'annual'
    WHEN days BETWEEN 61 AND 121 THEN 'quarterly'
    WHEN fiscal_period IN ('Q2', 'Q3') AND days BETWEEN 122 AND 304 THEN 'year_to_date'
    ELSE 'other_duration' END AS reporting_basis
FROM (SELECT r.*, m.canonical_metric, m.m_period_type, m.m_unit,
        CASE WHEN start_date IS NULL THEN 'instant' ELSE 'duration' END AS period_type,
        datediff('day', start_date, end_date) + 1 AS days
      FROM raw_facts r LEFT JOIN mapping m ON r.taxonomy = m.m_taxonomy AND r.concept = m.m_concept)
""")

cte("accepted", """
SELECT *, count(*) OVER g AS candidate_count, min(fact_id) OVER g AS first_id, max(fact_id) OVER g AS last_id,
  concat_ws(':', CAST(sum(CAST(concat('0x', substr(fact_id, 1, 16)) AS UBIGINT)) OVER g AS VARCHAR), CAST(sum(CAST(concat('0x', substr(fact_id, 17, 16)) AS UBIGINT)) OVER g AS VARCHAR), CAST(sum(CAST(concat('0x', substr(fact_id, 33, 16)) AS UBIGINT)) OVER g AS VARCHAR), CAST(sum(CAST(concat('0x', substr(fact_id, 49, 16)) AS UBIGINT)) OVER g AS VARCHAR)) AS id_digest,
  row_number() OVER (PARTITION BY cik, canonical_metric, unit, start_date, end_date, fiscal_year, fiscal_period, reporting_basis
    ORDER BY CASE WHEN form LIKE '%/A' THEN 1 ELSE 0 END, filed DESC, accession_number, fact_id) AS choice
FROM cand WHERE reject_reason IS NULL
WINDOW g AS (PARTITION BY cik, canonical_metric, unit, start_date, end_date, fiscal_year, fiscal_period, reporting_basis)
""")

cte("facts", """
SELECT *, sha256(concat_ws('|', '1.0.0', canonical_metric, fact_id)) AS normalized_fact_id
FROM accepted WHERE choice = 1
""")

_CLASSES = ", ".join(
    f"({text(n)}, {text(c.severity)}, {text(c.remediation)})" for n, c in FINDING_CLASSES.items())

cte("finding_parts", """
SELECT cik, reject_reason AS category, canonical_metric AS metric, fact_id AS id_text, 1 AS affected_count,
  CASE reject_reason
    WHEN 'unmapped_concept' THEN concat('No mapping exists for ', taxonomy, ':', concept, '; the fact was not coerced.')
    WHEN 'incompatible_unit' THEN concat(taxonomy, ':', concept, ' uses ', unit, '; expected one of ', m_unit, '.')
    WHEN 'incompatible_period_type' THEN concat(taxonomy, ':', concept, ' is ', period_type, '; the mapping requires ', m_period_type, '.')
    WHEN 'unsupported_form' THEN concat('Form ', form, ' is outside this mapping''s allowed forms.')
    ELSE 'duration fact carries an instantaneous SEC frame' END AS message
FROM cand WHERE reject_reason IS NOT NULL
UNION ALL
SELECT c.cik, 'missing_metric', m.canonical_metric, NULL, 0, concat('No compatible fact was found for ', m.canonical_metric, '.')
FROM (SELECT DISTINCT cik FROM raw_facts) c CROSS JOIN mapping m
WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.cik = c.cik AND f.canonical_metric = m.canonical_metric)
UNION ALL
SELECT cik, 'duplicate_period_candidates', canonical_metric,
  concat_ws('|', first_id, last_id, CAST(candidate_count AS VARCHAR), id_digest),
  candidate_count, concat('Selected ', accession_number, ' from ', CAST(candidate_count AS VARCHAR), ' facts for the same canonical period.')
FROM facts WHERE candidate_count > 1
UNION ALL
SELECT cik, 'amendment_selected', canonical_metric, fact_id, 1, concat('Selected amended filing fact ', accession_number, '.')
FROM facts WHERE form LIKE '%/A'
UNION ALL
SELECT cik, 'normalization_summary', NULL, concat_ws('|', min(fact_id), max(fact_id), CAST(count(*) AS VARCHAR),
    concat_ws(':', CAST(sum(CAST(concat('0x', substr(fact_id, 1, 16)) AS UBIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(fact_id, 17, 16)) AS UBIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(fact_id, 33, 16)) AS UBIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(fact_id, 49, 16)) AS UBIGINT)) AS VARCHAR))), count(*),
  concat('Selected ', CAST((SELECT count(*) FROM facts f WHERE f.cik = r.cik) AS VARCHAR), ' normalized facts from ',
    CAST(count(*) AS VARCHAR), ' raw facts using mapping version 1.0.0.')
FROM raw_facts r GROUP BY cik
""")

cte("findings", f"""
SELECT sha256(concat_ws('|', '1.0.0', cik, p.category, coalesce(metric, ''), id_text)) AS finding_id, cik, severity, p.category,
  metric, message, CAST(affected_count AS BIGINT) AS affected_count, remediation
FROM finding_parts p JOIN (VALUES {_CLASSES}) AS k(category, severity, remediation) ON k.category = p.category
""")

# --------------------------------------------------------------------------- metrics
# Values are integers in units of 1e-15, so that every statistic is exact.
_INPUTS = ", ".join(
    f"({text(f.metric)}, {i}, {text(m)})" for f in FORMULAS for i, m in enumerate(f.inputs))
_LEVEL_2 = ("fcf_conversion", "working_capital_intensity", "stock_compensation_to_fcf")

cte("formula_inputs", f"""
SELECT *, formula IN ({', '.join(text(m) for m in _LEVEL_2)}) AS second
FROM (VALUES {_INPUTS}) AS t(formula, position, metric)
""")

cte("reported", """
SELECT cik, sha256(concat('reported|', normalized_fact_id)) AS metric_result_id, canonical_metric AS metric_id, period_type,
  start_date, end_date, fiscal_year, fiscal_period, reporting_basis, true AS computed, CAST(value AS DECIMAL(20,4)) AS money,
  CAST(value * 10000 AS HUGEINT) * 100000000000 AS v, unit, [normalized_fact_id] AS fact_ids, CAST(1 AS DOUBLE) AS confidence,
  CAST(NULL AS VARCHAR) AS reason, 'reported:1.0.0' AS formula_version
FROM facts
""")


def _derived(pool: str, second: str) -> str:
    return f"""
WITH anchors AS (
  SELECT a.*, i.formula FROM {pool} a JOIN formula_inputs i ON i.metric = a.metric_id AND i.position = 0 AND i.second = {second}),
matched AS (
  SELECT a.metric_result_id AS anchor_id, a.formula, i.metric, i.position, c.money, c.fact_ids, c.metric_result_id AS input_id,
    row_number() OVER (PARTITION BY a.metric_result_id, a.formula, i.position
      ORDER BY coalesce(c.start_date, c.end_date) DESC, c.metric_result_id DESC) AS choice
  FROM anchors a JOIN formula_inputs i ON i.formula = a.formula AND i.position > 0
  LEFT JOIN {pool} c ON c.metric_id = i.metric AND c.computed AND c.cik = a.cik AND c.end_date = a.end_date
    AND c.fiscal_year IS NOT DISTINCT FROM a.fiscal_year AND c.fiscal_period IS NOT DISTINCT FROM a.fiscal_period
    AND (c.start_date IS NULL OR a.start_date IS NULL OR c.start_date = a.start_date)),
wide AS (
  SELECT anchor_id, formula, max(CASE WHEN position = 1 THEN money END) AS m1, max(CASE WHEN position = 2 THEN money END) AS m2,
    flatten(list(fact_ids) FILTER (WHERE fact_ids IS NOT NULL)) AS other_ids,
    list(metric ORDER BY position) FILTER (WHERE input_id IS NULL) AS absent
  FROM matched WHERE choice = 1 GROUP BY anchor_id, formula),
calc AS (
  SELECT a.*, w.m1, w.m2, list_sort(list_concat(a.fact_ids, coalesce(w.other_ids, []))) AS ids,
    CASE WHEN w.absent IS NOT NULL THEN w.absent WHEN NOT a.computed THEN [a.metric_id] END AS missing,
    CASE WHEN a.formula IN ('free_cash_flow', 'working_capital') THEN a.money - w.m1
         WHEN a.formula = 'accrual_ratio' THEN a.money - w.m1
         WHEN a.formula = 'dilution_spread' THEN a.money - w.m1 ELSE a.money END AS top,
    CASE WHEN a.formula IN ('free_cash_flow', 'working_capital') THEN NULL
         WHEN a.formula = 'accrual_ratio' THEN w.m2 ELSE w.m1 END AS bottom
  FROM anchors a JOIN wide w ON w.anchor_id = a.metric_result_id AND w.formula = a.formula),
judged AS (
  SELECT *, missing IS NULL AS complete, coalesce(bottom = 0, false) AS zero,
    CAST(top * 10000 AS HUGEINT) AS t, CAST(bottom * 10000 AS HUGEINT) AS b FROM calc)
SELECT cik, sha256(concat_ws('|', '1.0.0', formula, coalesce(CAST(start_date AS VARCHAR), ''), CAST(end_date AS VARCHAR),
    array_to_string(ids, '|'))) AS metric_result_id, formula AS metric_id, period_type, start_date, end_date, fiscal_year,
  fiscal_period, reporting_basis, complete AND NOT zero AS computed,
  CASE WHEN complete AND bottom IS NULL THEN CAST(top AS DECIMAL(20,4)) END AS money,
  CASE WHEN complete AND NOT zero THEN CASE WHEN bottom IS NULL THEN t * 100000000000
    ELSE sign(t) * sign(b) * ((2 * abs(t) * 1000000000000000 + abs(b)) // (2 * abs(b))) END END AS v,
  CASE WHEN complete AND NOT zero THEN CASE WHEN bottom IS NULL THEN 'USD' ELSE 'ratio' END END AS unit, ids AS fact_ids,
  CASE WHEN complete AND NOT zero THEN CAST(1 AS DOUBLE) END AS confidence,
  CASE WHEN NOT complete THEN concat('Missing required inputs: ', array_to_string(missing, ', '))
       WHEN zero THEN 'Formula denominator is zero' END AS reason, '1.0.0' AS formula_version
FROM judged
"""


cte("derived_first", _derived("reported", "false"))
cte("pool", "SELECT * FROM reported UNION ALL SELECT * FROM derived_first")
cte("derived_second", _derived("pool", "true"))
cte("results", "SELECT * FROM pool UNION ALL SELECT * FROM derived_second")

# ----------------------------------------------------------------------------- tests
_TESTS = ", ".join(
    f"({text(t.test_id)}, {text(t.category)}, {text(t.metric)}, {text(t.purpose)}, {text('; '.join(t.evidence))})" for t in TESTS)
cte("test_list", f"SELECT * FROM (VALUES {_TESTS}) AS t(test_id, category, metric_id, purpose, evidence)")

cte("latest", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, metric_id
    ORDER BY end_date DESC, coalesce(start_date, end_date) DESC, metric_result_id DESC) AS recency,
  row_number() OVER (PARTITION BY cik
    ORDER BY end_date DESC, coalesce(start_date, end_date) DESC, metric_result_id DESC) AS company_recency FROM results)
WHERE recency = 1
""")

cte("tests", """
SELECT c.cik, t.test_id, t.category, t.metric_id, t.purpose, t.evidence,
  coalesce(l.end_date, c.end_date) AS end_date,
  CASE WHEN l.metric_result_id IS NULL THEN c.start_date ELSE l.start_date END AS start_date,
  CASE WHEN l.metric_result_id IS NULL THEN c.reporting_basis ELSE l.reporting_basis END AS reporting_basis,
  l.metric_result_id, coalesce(l.computed, false) AS computed, l.v, l.confidence,
  sha256(concat_ws('|', '1.0.0', t.test_id,
    coalesce(CAST(CASE WHEN l.metric_result_id IS NULL THEN c.start_date ELSE l.start_date END AS VARCHAR), ''),
    CAST(coalesce(l.end_date, c.end_date) AS VARCHAR), coalesce(l.metric_result_id, 'missing'))) AS test_result_id,
  CASE WHEN coalesce(l.computed, false) THEN 'Deterministic diagnostic value only; no risk conclusion is assigned without a versioned anomaly or applicability rule.'
    ELSE coalesce(l.reason, concat('Required metric ', t.metric_id, ' is unavailable')) END AS reason
FROM (SELECT * FROM latest WHERE company_recency = 1) c CROSS JOIN test_list t
LEFT JOIN latest l ON l.cik = c.cik AND l.metric_id = t.metric_id
""")

# ------------------------------------------------------------------------- anomalies
cte("valued", f"SELECT *, {double('v')} AS x FROM results WHERE computed")
cte("series", """
SELECT r.*, list(x) OVER w AS h,
  lag(x) OVER (PARTITION BY cik, metric_id ORDER BY end_date, coalesce(start_date, end_date), metric_result_id) AS previous
FROM valued r
WINDOW w AS (PARTITION BY cik, metric_id ORDER BY end_date, coalesce(start_date, end_date), metric_result_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")


def spread(source: str) -> str:
    """Doubled centre and four times the MAD of each row's prefix."""
    return f"""
SELECT *, d[(n + 1) // 2] + d[n // 2 + 1] AS mad4
FROM (SELECT *, list_sort(list_transform(h, lambda y: abs(y + y - centre2))) AS d
  FROM (SELECT *, len(h) AS n, list_sort(h)[(len(h) + 1) // 2] + list_sort(h)[len(h) // 2 + 1] AS centre2 FROM {source}))
"""


Z = "CASE WHEN n >= 4 AND mad4 <> 0 THEN 0.67448975::DOUBLE * ((x + x - centre2) * 2) / mad4 END"
_D = [f"abs(h[n - {k}] + h[n - {k}] - centre2)" for k in (2, 1, 0)]
_ABOVE = " AND ".join(f"h[n - {k}] + h[n - {k}] >= centre2" for k in (2, 1, 0))
_UNDER = " AND ".join(f"h[n - {k}] + h[n - {k}] <= centre2" for k in (2, 1, 0))
PERSISTENCE = f"""CASE WHEN n < 3 THEN 'unknown'
    WHEN {_D[1]} - {_D[0]} > 1e-12::DOUBLE * abs(centre2) AND {_D[2]} - {_D[1]} > 1e-12::DOUBLE * abs(centre2) THEN 'worsening'
    WHEN ({_ABOVE}) OR ({_UNDER}) THEN 'recurring' ELSE 'one_off' END"""

cte("spread", spread("series"))
cte("anomalies", f"""
SELECT *, sha256(concat_ws('|', metric_id, metric_result_id)) AS anomaly_id, {Z} AS z,
  CASE WHEN previous <> 0 THEN (x - previous) / abs(previous) END AS change,
  CAST(len(list_filter(h, lambda y: y <= x)) AS DOUBLE) / n AS percentile, {PERSISTENCE} AS persistence
FROM spread
""")
cte("first_test", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, metric_id ORDER BY test_id) AS choice FROM tests WHERE computed)
WHERE choice = 1
""")
cte("strong", """
SELECT a.cik, a.metric_id, a.anomaly_id, a.z, a.n, a.persistence, a.reporting_basis, a.change, t.test_id, t.test_result_id, t.category,
  t.evidence, t.confidence, sha256(concat_ws('|', t.test_result_id, a.anomaly_id)) AS signal_id,
  round_even((least(abs(a.z) / 3.5::DOUBLE, 2.0::DOUBLE) * t.confidence / 2.0::DOUBLE) * 1e12::DOUBLE, 0) / 1e12::DOUBLE AS score,
  CASE WHEN a.reporting_basis IN ('annual', 'quarterly') THEN abs(a.change) END AS materiality
FROM anomalies a JOIN first_test t ON t.cik = a.cik AND t.metric_id = a.metric_id WHERE abs(a.z) >= 3.5
""")
cte("signals", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY score DESC, signal_id) AS signal_rank FROM strong)
WHERE signal_rank <= 10
""")
