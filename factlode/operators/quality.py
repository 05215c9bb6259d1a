"""Data-quality score, record validity and language screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlode.functions.periods import OTHER_DURATION
from factlode.registries import MAPPINGS

# Fixed value: the explanation of a quality score.
SCORE_EXPLANATION = (
    "Unweighted mean of available completeness, unit consistency, mapping confidence, period alignment, and "
    "amendment-status components. Reconciliation is unavailable until statement coverage supports it."
)

# Phrases an assessment must not contain.
ACCUSATORY_PHRASES = ("committed fraud", "is fraudulent", "proves fraud", "fraud was committed")


def data_quality(facts: DataFrame, findings: DataFrame, metric_count: int = len(MAPPINGS)) -> DataFrame:
    """Mean of five components per company; companies without facts score 0 on fact parts.

    Distinct metrics are bounded by the registry, so a partial ``collect_set`` combines on
    the map side and no second distinct shuffle is needed.
    """
    aligned = (F.col("reporting_basis").isNotNull() & (F.col("reporting_basis") != OTHER_DURATION)).cast("double")
    from_facts = facts.groupBy("cik").agg(
        (F.size(F.collect_set("canonical_metric")).cast("double") / metric_count).alias("completeness"),
        F.avg(F.col("data_confidence").cast("double")).alias("mapping_confidence"),
        F.avg(aligned).alias("period_alignment"),
    )
    none_of = lambda category: (1 - F.max((F.col("category") == category).cast("int"))).cast("double")
    from_findings = findings.groupBy("cik").agg(
        none_of("incompatible_unit").alias("unit_consistency"),
        none_of("amendment_selected").alias("amendment_status"),
    )
    joined = from_facts.join(from_findings, "cik", "full_outer")
    zero_parts = ("completeness", "mapping_confidence", "period_alignment")
    one_parts = ("unit_consistency", "amendment_status")
    filled = joined.fillna(0.0, subset=list(zero_parts)).fillna(1.0, subset=list(one_parts))
    parts = ["completeness", "unit_consistency", "mapping_confidence", "period_alignment", "amendment_status"]
    total = F.col(parts[0])
    for part in parts[1:]:
        total = total + F.col(part)
    return filled.select(
        "cik", *parts, F.lit(None).cast("double").alias("reconciliation"), (total / len(parts)).alias("overall"),
        F.lit(SCORE_EXPLANATION).alias("explanation"),
    )


# ------------------------------------------------------------------------ record validity
CIK_PATTERN = "^[0-9]{10}$"
SHA_PATTERN = "^[0-9a-f]{64}$"


def first_violation(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that is broken (a rule's column is true where broken)."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])


def period_rules(declared: str = "period_type") -> list[tuple[str, Column]]:
    start, end, kind = F.col("start_date"), F.col("end_date"), F.col(declared)
    basis = F.col("reporting_basis")
    return [
        ("duration_without_start", (kind == "duration") & start.isNull()),
        ("instant_with_start", (kind == "instant") & start.isNotNull()),
        ("start_after_end", start > end),
        ("instant_with_duration_basis", (kind == "instant") & (basis != "instant")),
        ("duration_with_instant_basis", (kind == "duration") & (basis == "instant")),
    ]


def fact_rules() -> list[tuple[str, Column]]:
    return [
        ("cik_malformed", ~F.col("cik").rlike(CIK_PATTERN)),
        ("basis_missing", F.col("reporting_basis").isNull()),
        *period_rules(),
        ("confidence_out_of_range", ~F.col("data_confidence").between(0, 1)),
    ]


def result_rules() -> list[tuple[str, Column]]:
    return [
        ("computed_without_value", (F.col("status") == "computed") & F.col("value").isNull()),
        ("not_computable_without_reason",
         (F.col("status") == "not_computable") & F.col("not_computable_reason").isNull()),
        ("confidence_out_of_range", ~F.col("data_confidence").between(0, 1)),
    ]


def span_rules() -> list[tuple[str, Column]]:
    """Chunks and evidence packets."""
    return [
        ("negative_start", F.col("start_offset") < 0),
        ("empty_span", F.col("end_offset") <= F.col("start_offset")),
        ("source_hash_malformed", ~F.col("content_sha256").rlike(SHA_PATTERN)),
    ]


def claim_rules() -> list[tuple[str, Column]]:
    references = F.size("evidence_ids") + F.size("fact_ids") + F.size("metric_result_ids")
    return [("material_claim_without_reference", F.col("material") & (references == 0))]


def run_rules(max_days: int = 1900) -> list[tuple[str, Column]]:
    start, end = F.col("requested_period_start"), F.col("requested_period_end")
    return [
        ("period_reversed", start > end),
        ("period_too_long", F.datediff(end, start) > max_days),
    ]


def split_valid(frame: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, violating rows with the rule's name)."""
    judged = frame.withColumn("violation", first_violation(rules))
    return judged.where("violation IS NULL").drop("violation"), judged.where("violation IS NOT NULL")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """Case-insensitive containment of any literal phrase."""
    folded = F.lower(text)
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | folded.contains(phrase.lower())
    return F.coalesce(hit, F.lit(False))
