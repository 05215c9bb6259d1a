"""Diagnostic tests, expanding robust statistics and ranked screening signals."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.functions.periods import ANNUAL, QUARTERLY, order_date
from factlode.functions.relations import string_array
from factlode.operators.expanding import expanding_statistics
from factlode.registries import TEST_VERSION, TESTS, Diagnostic

PERIOD_COLUMNS = ["period_type", "start_date", "end_date", "fiscal_year", "fiscal_period", "reporting_basis"]
# Fixed value: the reason of every diagnostic result.
DIAGNOSTIC_REASON = (
    "Deterministic diagnostic value only; no risk conclusion is assigned without a versioned anomaly or "
    "applicability rule."
)


# -------------------------------------------------------------------------------- tests
def _result_struct() -> Column:
    """A metric result whose field order is (end, start or end, id)."""
    return F.struct(
        "end_date",
        order_date(F.col("start_date"), F.col("end_date")).alias("ordered"),
        F.col("metric_result_id").alias("id"),
        F.col("metric_id").alias("metric"),
        "status", "value", "data_confidence", "not_computable_reason",
        "period_type", "start_date", "fiscal_year", "fiscal_period", "reporting_basis",
    )


def latest_results(results: DataFrame) -> DataFrame:
    """Latest result per company and metric, computable or not (map-side combined)."""
    return results.groupBy("cik", "metric_id").agg(F.max(_result_struct()).alias("latest"))


def tests_literal(tests: tuple[Diagnostic, ...]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(t.test_id).alias("test_id"), F.lit(t.category).alias("category"),
            F.lit(t.metric).alias("metric_id"), F.lit(t.purpose).alias("purpose"),
            string_array(t.evidence).alias("evidence_requirements"),
        )
        for t in tests
    ])


def forensic_tests(results: DataFrame, tests: tuple[Diagnostic, ...] = TESTS) -> DataFrame:
    """Every test for every company, on the latest result of the test's metric.

    Latest results are at most one per metric, so a company's row holds no more than the
    registry does; the tests are exploded from a literal instead of being cross-joined.
    """
    wanted = sorted({t.metric for t in tests})
    companies = latest_results(results).groupBy("cik").agg(
        F.max("latest").alias("fallback"),
        F.collect_list(F.when(F.col("metric_id").isin(*wanted), F.col("latest"))).alias("found"),
    )
    each = companies.select("cik", "fallback", "found", F.explode(tests_literal(tests)).alias("t"))
    matched = each.withColumn("m", F.expr("get(filter(found, x -> x.metric = t.metric_id), 0)"))
    framed = matched.withColumn("p", F.coalesce("m", "fallback"))
    computed = F.coalesce(F.col("m.status") == "computed", F.lit(False))
    reason = F.when(computed, DIAGNOSTIC_REASON).otherwise(F.coalesce(
        "m.not_computable_reason",
        F.concat(F.lit("Required metric "), F.col("t.metric_id"), F.lit(" is unavailable")),
    ))
    return framed.select(
        "cik",
        ids.stable_id(
            TEST_VERSION, F.col("t.test_id"), F.col("p.start_date"), F.col("p.end_date"),
            F.coalesce("m.id", F.lit("missing")),
        ).alias("test_result_id"),
        F.col("t.test_id").alias("test_id"),
        F.lit(TEST_VERSION).alias("test_version"),
        *[F.col(f"p.{c}").alias(c) for c in PERIOD_COLUMNS],
        F.when(computed, "computed").otherwise("not_computable").alias("status"),
        F.when(computed, F.col("m.value")).alias("result"),
        F.struct(
            F.col("t.category").alias("category"), F.col("t.metric_id").alias("metric_id"),
            F.col("t.purpose").alias("purpose"), F.col("t.evidence_requirements").alias("evidence_requirements"),
            F.lit(None).cast("decimal(10,4)").alias("screening_threshold"),
        ).alias("threshold_context"),
        F.when(F.col("m.id").isNotNull(), F.array("m.id"))
        .otherwise(F.array().cast("array<string>")).alias("metric_result_ids"),
        F.col("m.data_confidence").alias("data_confidence"),
        reason.alias("reason"),
    )


# ---------------------------------------------------------------------------- anomalies
ROBUST_Z_SCALE = 0.67448975
MIN_ROBUST_SAMPLE = 4


def series_window(by_basis: bool = False) -> tuple[Window, list[str]]:
    keys = ["cik", "metric_id", *(["reporting_basis"] if by_basis else [])]
    order = ["end_date", order_date(F.col("start_date"), F.col("end_date")), "metric_result_id"]
    return Window.partitionBy(*keys).orderBy(*order), keys


def anomalies(results: DataFrame, by_basis: bool = False, history_ids: bool = False) -> DataFrame:
    """Expanding median, MAD, robust z, change, percentile and persistence.

    A series is what ``choose_facts`` left of one metric of one company. Its rows stream through a
    sorted structure that grows by one value a row (see ``expanding_statistics``).
    ``history_ids`` adds the ids of the rows up to each row; the same list is given without storing it
    by the rows of the series whose ``sample_count`` is not larger.
    """
    series = results.where((F.col("status") == "computed") & F.col("value").isNotNull())
    return _series_statistics(series, by_basis, history_ids)


def _series_statistics(
    series: DataFrame, by_basis: bool = False, history_ids: bool = False, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Statistics of the rows that have a value; rows without one are passed over."""
    ordered, _ = series_window(by_basis)
    # what follows is not pruned through the Python task
    needed = ["cik", "metric_id", "metric_result_id", *PERIOD_COLUMNS, "value", *keep]
    valued = series.where(F.col("value").isNotNull()).select(*needed)
    if history_ids:
        prefix = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        valued = valued.withColumn("input_metric_result_ids", F.collect_list("metric_result_id").over(prefix))
    spread = expanding_statistics(valued, ordered, "value").withColumn("x", F.col("value").cast("double"))
    offset = F.col("x") + F.col("x") - F.col("centre2")
    robust_z = F.when(
        (F.col("sample_count") >= MIN_ROBUST_SAMPLE) & (F.col("mad4") != 0),
        F.lit(ROBUST_Z_SCALE) * (offset * 2) / F.col("mad4"),
    )
    change = F.when(
        F.col("previous") != 0,
        (F.col("x") - F.col("previous")) / F.abs("previous"),
    )
    measured = spread.withColumns({
        "robust_z_score": robust_z,
        "change": change,
        "rolling_percentile": F.col("not_above").cast("double") / F.col("sample_count"),
        "persistence": _persistence(),
    })
    explanation = F.concat(
        F.lit("Window contains "), F.col("sample_count").cast("string"), F.lit(" observations; robust z-score "),
        F.when(F.col("robust_z_score").isNotNull(),
               F.concat(F.col("robust_z_score").cast("string"), F.lit(" uses median/MAD.")))
        .otherwise("is unavailable until at least four non-constant values exist."),
    )
    return measured.select(
        "cik", ids.stable_id(F.col("metric_id"), F.col("metric_result_id")).alias("anomaly_id"),
        "metric_id", "metric_result_id", *PERIOD_COLUMNS,
        F.col("value").alias("current_value"),
        F.when(F.col("reporting_basis") == ANNUAL, F.col("change")).alias("year_over_year_change"),
        F.when(F.col("reporting_basis") == QUARTERLY, F.col("change")).alias("quarter_over_quarter_change"),
        (F.col("centre2") / 2).alias("historical_median"),
        (F.col("mad4") / 4).alias("median_absolute_deviation"),
        "robust_z_score", "rolling_percentile", "sample_count", "persistence",
        *(["input_metric_result_ids"] if history_ids else []),
        explanation.alias("explanation"), *keep,
    )


def _persistence() -> Column:
    """Shape of the last three values around the current centre.

    Distances that agree to twelve digits count as equal: the two middle values of an even
    sample are equally far from their mean, whatever its last bit.
    """
    slack = F.lit(1e-12) * F.abs("centre2")
    last = [F.col(c) + F.col(c) for c in ("before_previous", "previous", "x")]
    distance = [F.abs(v - F.col("centre2")) for v in last]
    above = [v >= F.col("centre2") for v in last]
    under = [v <= F.col("centre2") for v in last]
    return (
        F.when(F.col("sample_count") < 3, "unknown")
        .when((distance[1] - distance[0] > slack) & (distance[2] - distance[1] > slack), "worsening")
        .when((above[0] & above[1] & above[2]) | (under[0] & under[1] & under[2]), "recurring")
        .otherwise("one_off")
    )


# ------------------------------------------------------------------------------ signals
@dataclass(frozen=True)
class SignalPolicy:
    robust_z_threshold: Decimal = Decimal("3.5")
    max_signals: int = 10


def first_test_per_metric(tests: DataFrame) -> DataFrame:
    """The first computed test, by id, of each company and metric."""
    fields = F.struct(
        "test_id", "test_result_id", "data_confidence",
        F.col("threshold_context.category").alias("category"),
        F.col("threshold_context.evidence_requirements").alias("evidence_requirements"),
    )
    return (
        tests.where(F.col("status") == "computed")
        .groupBy("cik", F.col("threshold_context.metric_id").alias("metric_id"))
        .agg(F.min(fields).alias("t"))
        .select("cik", "metric_id", "t.*")
    )


def matched_anomalies(anomaly_rows: DataFrame, tests: DataFrame, policy: SignalPolicy = SignalPolicy()) -> DataFrame:
    """Anomalies beyond the threshold next to the test of their metric."""
    threshold = float(policy.robust_z_threshold)
    strong = anomaly_rows.where(F.abs("robust_z_score") >= threshold)
    return strong.join(first_test_per_metric(tests), ["cik", "metric_id"])


def signals(anomaly_rows: DataFrame, tests: DataFrame, policy: SignalPolicy = SignalPolicy()) -> DataFrame:
    """Top screening signals per company by score.

    ``row_number() <= k`` is limited on the map side before the shuffle by company, so a
    company with many strong anomalies sends k rows per task.
    """
    return _ranked(matched_anomalies(anomaly_rows, tests, policy), policy)


def ranked_signals(
    results: DataFrame, tests: tuple[Diagnostic, ...] = TESTS, policy: SignalPolicy = SignalPolicy(),
) -> DataFrame:
    """``signals(anomalies(results), forensic_tests(results))`` in one pass.

    Whether a metric's test is computable depends on the metric's latest result, which is in
    the same (company, metric) partition as its series.  So the anomalies, the latest result
    and the test id come from one shuffle, and only metrics that have a test take part.
    """
    first: dict[str, Diagnostic] = {}
    for test in sorted(tests, key=lambda t: t.test_id):
        first.setdefault(test.metric, test)
    whole = Window.partitionBy("cik", "metric_id")
    tested = results.where(F.col("metric_id").isin(*sorted(first))).withColumn(
        "latest", F.max(F.struct(
            "end_date", order_date(F.col("start_date"), F.col("end_date")).alias("ordered"),
            F.col("metric_result_id").alias("id"), "status", "start_date", "data_confidence",
        )).over(whole)
    ).where(F.col("latest.status") == "computed")
    screened = _series_statistics(tested, keep=("latest",)).where(
        F.abs("robust_z_score") >= float(policy.robust_z_threshold)
    )
    found = F.get(F.filter(tests_literal(tuple(first.values())), lambda t: t["metric_id"] == F.col("metric_id")), F.lit(0))
    matched = screened.withColumn("t", found).select(
        *[c for c in screened.columns if c != "latest"],
        F.col("t.test_id").alias("test_id"), F.col("t.category").alias("category"),
        F.col("t.evidence_requirements").alias("evidence_requirements"),
        F.col("latest.data_confidence").alias("data_confidence"),
        ids.stable_id(
            TEST_VERSION, F.col("t.test_id"), F.col("latest.start_date"), F.col("latest.end_date"), F.col("latest.id"),
        ).alias("test_result_id"),
    )
    return _ranked(matched, policy)


def _ranked(matched: DataFrame, policy: SignalPolicy) -> DataFrame:
    threshold = float(policy.robust_z_threshold)
    confidence = F.coalesce(F.col("data_confidence"), F.lit(0))
    score = F.least(F.abs("robust_z_score") / threshold, F.lit(2.0)) * confidence.cast("double") / 2.0
    score = F.rint(score * 1e12) / 1e12  # equal up to rounding noise means equal: ties go by id
    materiality = F.abs(F.coalesce("year_over_year_change", "quarter_over_quarter_change"))
    explained = F.concat(
        F.lit("Moderate screening priority: |robust z|="), F.abs("robust_z_score").cast("string"), F.lit(" over "),
        F.col("sample_count").cast("string"),
        F.lit(f" observations, threshold {policy.robust_z_threshold}, confidence "), confidence.cast("string"),
        F.lit("."),
    )
    scored = matched.select(
        "cik", ids.stable_id(F.col("test_result_id"), F.col("anomaly_id")).alias("signal_id"),
        "category", "test_id", F.lit("moderate").alias("severity"), materiality.alias("materiality"), "persistence",
        confidence.alias("data_confidence"), "evidence_requirements", score.alias("score"),
        explained.alias("score_explanation"), F.array("test_result_id").alias("source_test_result_ids"),
        "metric_id", "anomaly_id",
    )
    return top_signals(scored, policy.max_signals)


def top_signals(scored: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("cik").orderBy(F.col("score").desc(), F.col("signal_id"))
    return scored.withColumn("signal_rank", F.row_number().over(ranked)).where(F.col("signal_rank") <= k)
