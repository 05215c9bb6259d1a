"""Audit lineage, claim reference checks, gate status and run records."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.operators.quality import ACCUSATORY_PHRASES, contains_any
from factlode.registries import MAPPING_VERSION

MAX_SIGNALS = 8
MAX_EVIDENCE = 12
PROMPT_VERSION = "1.4.0"
ROLES = ("planner", "investigator", "bull", "skeptical", "verifier", "judge")
CASE_ROLES = ("investigator", "bull", "skeptical")
ACCEPTED_STATUSES = ("supported", "partially_supported")

# Violation code per kind of reference.
REFERENCE_CODES = {
    "signal": "claim_signal_invalid", "evidence": "claim_evidence_invalid", "fact": "claim_fact_invalid",
    "metric": "claim_metric_invalid",
}
REFERENCE_COLUMNS = {
    "signal": "signal_ids", "evidence": "evidence_ids", "fact": "fact_ids", "metric": "metric_result_ids",
}

# Why a run stopped.
NO_SIGNALS = "No ranked signals met the configured deterministic screening policy."
NO_PROVIDER = "Model provider unavailable; deterministic analysis and evidence are complete."


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ------------------------------------------------------------------------------- lineage
def signal_metrics(signals: DataFrame, tests: DataFrame, results: DataFrame, key: str = "cik") -> DataFrame:
    """Metric results reached from the signals' tests (two semi-joins)."""
    test_ids = signals.select(key, F.explode("source_test_result_ids").alias("test_result_id")).distinct()
    metric_ids = (
        tests.join(test_ids, [key, "test_result_id"], "left_semi")
        .select(key, F.explode("metric_result_ids").alias("metric_result_id")).distinct()
    )
    return results.join(metric_ids, [key, "metric_result_id"], "left_semi")


def source_manifests(facts: DataFrame, key: str = "cik") -> DataFrame:
    """Distinct manifest ids of the facts used, as rows (any number per company)."""
    return facts.select(key, "manifest_id").distinct()


def audit_lineage(
    results: DataFrame, tests: DataFrame, signals: DataFrame, evidence: DataFrame,
    verifications: DataFrame | None = None, key: str = "cik",
) -> DataFrame:
    """The source chain as distinct link rows (key, kind, reference and its source).

    A company's chain can be long, so it stays a table; ``audit_manifest`` summarises it.
    """
    nothing = F.lit(None).cast("string")
    plain = lambda frame, kind, column: frame.select(
        key, F.lit(kind).alias("kind"), F.col(column).alias("reference_id"), nothing.alias("chunk_id"),
        nothing.alias("source_hash"), nothing.alias("source_url"),
    )
    fact_rows = results.select(key, F.explode("input_fact_ids").alias("fact_id"))
    parts = [
        plain(fact_rows, "normalized_fact", "fact_id"),
        plain(results, "metric_result", "metric_result_id"),
        plain(tests, "test_result", "test_result_id"),
        plain(signals, "signal", "signal_id"),
        evidence.select(key, F.lit("evidence").alias("kind"), F.col("evidence_id").alias("reference_id"), "chunk_id",
                        F.col("content_sha256").alias("source_hash"), "source_url"),
    ]
    if verifications is not None:
        parts.append(plain(verifications, "verified_claim", "claim_id"))
    # links of different kinds are different rows: what is dealt by company already is made distinct where it is
    return _union([part.distinct() for part in parts])


def audit_manifest(lineage: DataFrame, key: str = "cik") -> DataFrame:
    """Per company and kind: number of references, their bounds and an order-free digest."""
    hashed = lineage.withColumn("h", F.sha2("reference_id", 256))
    return hashed.groupBy(key, "kind").agg(
        F.count(F.lit(1)).alias("reference_count"),
        F.min("reference_id").alias("first_reference"), F.max("reference_id").alias("last_reference"),
        ids.id_digest(F.col("h")).alias("reference_digest"),
    )


# -------------------------------------------------------------------------------- claims
def _references(claims: DataFrame, key: str) -> DataFrame:
    """(key, role, claim, kind, id) for every reference of every claim, in one explode."""
    tagged = lambda kind: lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("reference_id"))
    none = F.array().cast("array<string>")
    each = F.concat(*[F.transform(F.coalesce(c, none), tagged(kind)) for kind, c in REFERENCE_COLUMNS.items()])
    return claims.select(key, "role", "claim_id", F.explode(each).alias("r")).select(key, "role", "claim_id", "r.*")


def allowed_references(
    signals: DataFrame, evidence: DataFrame, facts: DataFrame, tests: DataFrame, results: DataFrame, key: str = "run_id",
) -> DataFrame:
    """Ids a claim of each run may cite."""
    parts = {
        "signal": (signals, "signal_id"), "evidence": (evidence, "evidence_id"),
        "fact": (facts, "normalized_fact_id"), "metric": (signal_metrics(signals, tests, results, key), "metric_result_id"),
    }
    return _union([
        frame.select(key, F.lit(kind).alias("kind"), F.col(column).alias("reference_id")) for kind, (frame, column) in parts.items()
    ]).distinct()


def repair_references(claims: DataFrame, allowed: DataFrame, key: str = "run_id") -> DataFrame:
    """Drop unknown fact ids of a claim if all of them are allowed metric ids.

    Only fact references are exploded and looked up; the kept ids return in their order.
    """
    cited = claims.select(key, "claim_id", F.posexplode("fact_ids").alias("place", "reference_id"))
    known = allowed.where(F.col("kind").isin("fact", "metric")).groupBy(key, "reference_id").agg(
        F.max(F.col("kind") == "fact").alias("is_fact"), F.max(F.col("kind") == "metric").alias("is_metric")
    )
    judged = cited.join(known, [key, "reference_id"], "left").fillna(False, ["is_fact", "is_metric"])
    per_claim = judged.groupBy(key, "claim_id").agg(
        F.max(~F.col("is_fact")).alias("has_unknown"),
        F.min(F.col("is_fact") | F.col("is_metric")).alias("only_metrics"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("is_fact"), F.struct("place", "reference_id")))),
            lambda s: s["reference_id"],
        ).alias("kept"),
    )
    joined = claims.join(per_claim, [key, "claim_id"], "left")
    repaired = F.when(F.col("has_unknown") & F.col("only_metrics"), F.col("kept")).otherwise(F.col("fact_ids"))
    return joined.withColumn("fact_ids", repaired).drop("has_unknown", "only_metrics", "kept")


def claim_violations(claims: DataFrame, allowed: DataFrame, key: str = "run_id") -> DataFrame:
    """Unknown references (one anti-join for all four kinds), roles of a run that address no signal, also for want of any claim, and
    claims under a role that a run doesn't have."""
    unknown = _references(claims, key).join(allowed, [key, "kind", "reference_id"], "left_anti")
    code = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c)) for k, c in REFERENCE_CODES.items()])
    bad = unknown.select(key, "role", "claim_id", code.alias("code"), "reference_id")
    nothing = F.lit(None).cast("string")
    runs = claims.select(key).unionByName(allowed.select(key)).distinct()
    expected = runs.select(key, F.explode(F.array(*[F.lit(r) for r in CASE_ROLES])).alias("role"))
    addressed = claims.groupBy(key, "role").agg(F.max(F.size("signal_ids")).alias("signals"))
    silent = expected.join(addressed, [key, "role"], "left").where("coalesce(signals, 0) <= 0").select(
        key, "role", nothing.alias("claim_id"), F.lit("agent_signal_coverage_failed").alias("code"), nothing.alias("reference_id")
    )
    mislabelled = claims.where(F.col("role").isNull() | ~F.col("role").isin(*CASE_ROLES)).select(
        key, "role", "claim_id", F.lit("agent_role_mismatch").alias("code"), nothing.alias("reference_id")
    )
    return _union([bad, silent, mislabelled])


def uncovered_signals(claims: DataFrame, signals: DataFrame, key: str = "run_id") -> DataFrame:
    """Ranked signals that no claim addresses."""
    addressed = claims.select(key, F.explode("signal_ids").alias("signal_id")).distinct()
    return signals.select(key, "signal_id").join(addressed, [key, "signal_id"], "left_anti")


def verification_violations(claims: DataFrame, verifications: DataFrame, evidence: DataFrame, key: str = "run_id") -> DataFrame:
    """Exactly one verification per claim, on evidence of the packet that the claim cites."""
    counted = verifications.groupBy(key, "claim_id").agg(F.count(F.lit(1)).alias("n"))
    known = claims.select(key, "claim_id", F.lit(True).alias("claimed"))
    coverage = known.join(counted, [key, "claim_id"], "full_outer").where(
        F.col("claimed").isNull() | F.col("n").isNull() | (F.col("n") > 1)
    ).select(key, "claim_id", F.lit("verifier_coverage_failed").alias("code"), F.lit(None).cast("string").alias("reference_id"))
    checked = verifications.select(key, "claim_id", F.explode("checked_evidence_ids").alias("reference_id")).distinct()
    packet = evidence.select(key, F.col("evidence_id").alias("reference_id")).distinct()
    outside = checked.join(packet, [key, "reference_id"], "left_anti").select(
        key, "claim_id", F.lit("verifier_evidence_invalid").alias("code"), "reference_id"
    )
    cited = claims.select(key, "claim_id", F.explode("evidence_ids").alias("reference_id")).distinct()
    unscoped = (
        checked.join(packet, [key, "reference_id"], "left_semi")
        .join(claims.select(key, "claim_id"), [key, "claim_id"], "left_semi")
        .join(cited, [key, "claim_id", "reference_id"], "left_anti")
        .select(key, "claim_id", F.lit("verifier_claim_scope_invalid").alias("code"), "reference_id")
    )
    return _union([coverage, outside, unscoped])


def accepted_claims(claims: DataFrame, verifications: DataFrame, key: str = "run_id") -> DataFrame:
    supported = verifications.where(F.col("status").isin(*ACCEPTED_STATUSES)).select(key, "claim_id")
    return claims.join(supported, [key, "claim_id"], "left_semi")


def audit_claims(
    claims: DataFrame, verifications: DataFrame, allowed: DataFrame, signals: DataFrame, evidence: DataFrame,
    key: str = "run_id",
) -> DataFrame:
    """All violations of a set of runs, after the misplaced-reference repair."""
    repaired = repair_references(claims, allowed, key)
    columns = [key, "claim_id", "code", "reference_id"]
    missed = uncovered_signals(repaired, signals, key).select(
        key, F.lit(None).cast("string").alias("claim_id"), F.lit("agent_signal_coverage_failed").alias("code"),
        F.col("signal_id").alias("reference_id"),
    )
    return _union([
        claim_violations(repaired, allowed, key).select(*columns), missed,
        verification_violations(repaired, verifications, evidence, key).select(*columns),
    ])


def accusatory(text: Column) -> Column:
    return contains_any(text, ACCUSATORY_PHRASES)


# ---------------------------------------------------------------------------------- runs
def capped(frame: DataFrame, order: list[Column], n: int, key: str = "cik") -> DataFrame:
    """First ``n`` rows per company in the given order (signals and packets of a run)."""
    ranked = Window.partitionBy(key).orderBy(*order)
    return frame.withColumn("run_position", F.row_number().over(ranked)).where(F.col("run_position") <= n)


def run_inputs(signals: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first eight signals and twelve packets of each company."""
    return (
        capped(signals, [F.col("score").desc(), F.col("signal_id")], MAX_SIGNALS),
        capped(evidence, [F.col("evidence_id")], MAX_EVIDENCE),
    )


def gate_status(companies: DataFrame, signals: DataFrame, provider: bool = False) -> DataFrame:
    """Whether a company's run ends at the deterministic gate, and why."""
    counted = signals.groupBy("cik").agg(F.count(F.lit(1)).alias("signal_count"))
    joined = companies.select("cik").join(counted, "cik", "left").fillna(0, ["signal_count"])
    none = F.col("signal_count") == 0
    return joined.select(
        "cik", "signal_count",
        F.when(none, "complete").otherwise("queued" if provider else "partial").alias("status"),
        F.when(none, NO_SIGNALS).otherwise(None if provider else NO_PROVIDER).alias("stop_reason"),
        (none | F.lit(not provider)).alias("deterministic_only"),
    )


def run_records(
    companies: DataFrame, signals: DataFrame, evidence: DataFrame, start: date, end: date, model: str | None = None,
) -> DataFrame:
    """Run id and configuration hash per company, from at most eight signals and twelve packets."""
    chosen, packets = run_inputs(signals, evidence)
    in_order = lambda column, item: F.transform(
        F.array_sort(F.collect_list(F.struct("run_position", item.alias("i")))), lambda s: s["i"]
    ).alias(column)
    signal_part = chosen.groupBy("cik").agg(in_order("signals", F.col("signal_id")))
    packet_part = packets.groupBy("cik").agg(in_order("evidence", F.array("evidence_id", "content_sha256")))
    joined = companies.select("cik").join(signal_part, "cik", "left").join(packet_part, "cik", "left")
    material = F.to_json(F.struct(
        F.col("cik"),
        F.coalesce("evidence", F.array().cast("array<array<string>>")).alias("evidence"),
        F.lit(MAPPING_VERSION).alias("mapping_version"),
        F.lit(MAX_EVIDENCE).alias("max_evidence_packets"), F.lit(MAX_SIGNALS).alias("max_signals"),
        F.lit(model).cast("string").alias("model"),
        F.array(F.lit(start.isoformat()), F.lit(end.isoformat())).alias("period"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        F.coalesce("signals", F.array().cast("array<string>")).alias("signals"),
    ), {"ignoreNullFields": "false"})
    hashed = joined.withColumn("configuration_hash", F.sha2(material, 256))
    return hashed.select("cik", ids.stable_id(F.col("cik"), F.col("configuration_hash")).alias("run_id"), "configuration_hash")


def agent_outputs(reports: DataFrame) -> DataFrame:
    """One row per non-null role output of a report, as JSON text."""
    roles = F.array(*[
        F.struct(F.lit(role).alias("role"), F.to_json(F.col(role)).alias("output_json")) for role in ROLES
    ])
    rows = reports.select("run_id", "cik", "prompt_version", "model_name",
                          F.explode(F.filter(roles, lambda r: r["output_json"].isNotNull())).alias("r"))
    return rows.select(
        F.concat_ws(":", "run_id", "r.role").alias("output_id"), "run_id", "cik", F.col("r.role").alias("role"),
        "prompt_version", "model_name", F.lit(True).alias("validated"), F.col("r.output_json").alias("output_json"),
    )


def report_lines(parts: dict[str, DataFrame], key: str = "cik") -> DataFrame:
    """A report as JSON lines (key, section, record); written partitioned by run.

    Sections are tables of any length, so a report is a folder of lines, not one string
    assembled in one task.
    """
    return _union([
        frame.select(key, F.lit(name).alias("section"), F.to_json(F.struct(*[c for c in frame.columns if c != key])).alias("record"))
        for name, frame in parts.items()
    ])


def write_reports(parts: dict[str, DataFrame], path: str, key: str = "cik") -> None:
    lines = report_lines(parts, key)
    (
        lines.hint("rebalance", F.col(key)).sortWithinPartitions(key, "section")
        .write.mode("overwrite").partitionBy(key).json(path)
    )
