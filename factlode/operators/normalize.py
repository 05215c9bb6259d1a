"""Raw observations -> canonical facts plus data-quality findings, for all companies at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlode.functions import ids, periods
from factlode.registries import FINDING_CLASSES, MAPPING_VERSION, MAPPINGS, Mapping, mapping_frame
from factlode.functions.relations import string_array

PERIOD_KEY = ["start_date", "end_date", "fiscal_year", "fiscal_period", "reporting_basis"]
FINDING_COLUMNS = [
    "finding_id", "cik", "severity", "category", "metric", "message", "affected_count",
    "mapping_version", "remediation",
]


@dataclass(frozen=True)
class SelectionPolicy:
    """Which of several candidates for one period is kept."""

    target_accessions: tuple[str, ...] = ()
    prefer_amendments: bool = False

    def order_key(self) -> Column:
        """Smallest wins: target accession, concept rank, amendment, newest, accession, id."""
        amended = F.col("form").endswith("/A")
        if self.prefer_amendments:
            amended = ~amended
        position = F.array_position(string_array(self.target_accessions), F.col("accession_number"))
        target = F.when(position > 0, position).otherwise(len(self.target_accessions) + 1)
        return F.struct(
            target.cast("int").alias("target"),
            F.col("concept_rank"),
            amended.cast("int").alias("amended"),
            (-F.unix_date("filed")).alias("newest"),
            F.col("accession_number"),
            F.col("fact_id"),
        )


@dataclass(frozen=True)
class Normalization:
    facts: DataFrame
    findings: DataFrame
    finding_facts: DataFrame


#: A larger registry is joined as Spark sees fit.
MOST_BROADCAST_MAPPINGS = 10_000


def classify_candidates(
    raw: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, mapping: DataFrame | None = None
) -> DataFrame:
    """Each fact next to each mapping of its concept, with the first failing check.

    The registry is a fixed relation (31 rows by default), so the join is a broadcast and
    the facts are read once, without a shuffle, for all five fact-level finding categories.
    """
    registry = mapping if mapping is not None else mapping_frame(raw.sparkSession, mappings)
    if mapping is None and len(mappings) <= MOST_BROADCAST_MAPPINGS:
        registry = F.broadcast(registry)
    joined = raw.join(registry, ["taxonomy", "concept"], "left")
    kind = periods.period_type(F.col("start_date"))
    base_form = F.regexp_replace("form", "/A$", "")
    reason = (
        F.when(F.col("canonical_metric").isNull(), "unmapped_concept")
        .when(~F.array_contains("mapped_units", F.col("unit")), "incompatible_unit")
        .when(kind != F.col("mapped_period_type"), "incompatible_period_type")
        .when(~F.array_contains(F.col("mapped_forms"), base_form), "unsupported_form")
        .when(periods.frame_conflict(F.col("start_date"), F.col("frame")), "invalid_period_context")
    )
    return joined.withColumns({
        "period_type": kind,
        "reporting_basis": periods.reporting_basis(
            F.col("start_date"), F.col("end_date"), F.col("frame"), F.col("fiscal_period")
        ),
        "reject_reason": reason,
    })


def choose_facts(candidates: DataFrame, policy: SelectionPolicy = SelectionPolicy()) -> DataFrame:
    """One accepted candidate per company, metric, unit and period.

    ``min`` over an ordering struct combines on the map side, so a period reported a
    billion times crosses the shuffle as one row per task.  The same aggregate counts the
    candidates and digests their ids, which is all that the duplicate finding needs.
    """
    payload = F.struct(
        "fact_id", "taxonomy", "concept", "value", "form", "filed", "accession_number", "frame",
        "decimals", "concept_rank", "data_confidence", "manifest_id",
    )
    accepted = candidates.where(F.col("reject_reason").isNull())
    chosen = accepted.groupBy("cik", "canonical_metric", "unit", *PERIOD_KEY).agg(
        F.min(F.struct(policy.order_key().alias("k"), payload.alias("p"))).alias("best"),
        F.count(F.lit(1)).alias("candidate_count"),
        F.min("fact_id").alias("first_id"),
        F.max("fact_id").alias("last_id"),
        ids.id_digest(F.col("fact_id")).alias("id_digest"),
    )
    return chosen.select(
        "cik", "canonical_metric", "unit", *PERIOD_KEY,
        periods.period_type(F.col("start_date")).alias("period_type"),
        "best.p.*", "candidate_count", "first_id", "last_id", "id_digest",
    )


def normalized_facts(chosen: DataFrame) -> DataFrame:
    """Canonical fact records of the chosen candidates."""
    rationale = F.concat(
        F.lit("Selected exact "), "taxonomy", F.lit(":"), "concept", F.lit(" mapping at priority "),
        F.col("concept_rank").cast("string"), F.lit("; compatible unit "), "unit", F.lit("; "),
        "reporting_basis", F.lit(" period; accession "), "accession_number", F.lit("."),
    )
    return chosen.select(
        ids.stable_id(MAPPING_VERSION, F.col("canonical_metric"), F.col("fact_id")).alias("normalized_fact_id"),
        "cik", "canonical_metric",
        F.col("fact_id").alias("original_fact_id"),
        F.col("taxonomy").alias("original_taxonomy"),
        F.col("concept").alias("original_concept"),
        "value", "unit", "period_type", *PERIOD_KEY, "form", "filed", "accession_number", "frame",
        "decimals", F.lit(MAPPING_VERSION).alias("mapping_version"),
        F.col("concept_rank").alias("selection_rank"),
        rationale.alias("selection_rationale"),
        F.lit(False).alias("is_derived"),
        (F.col("concept_rank") > 1).alias("is_fallback"),
        "data_confidence", "manifest_id",
    )


# ------------------------------------------------------------------------------ findings
def _finding(category: Column, metric: Column, message: Column, id_text: Column, count: Column) -> list[Column]:
    by_class = {name: (c.severity, c.remediation) for name, c in FINDING_CLASSES.items()}
    severity = F.coalesce(*[F.when(category == n, s) for n, (s, _) in by_class.items()])
    remediation = F.coalesce(*[F.when(category == n, r) for n, (_, r) in by_class.items()])
    parts = [F.lit(MAPPING_VERSION), F.col("cik"), category, ids.text_or_empty(metric)]
    material = F.concat_ws("|", *parts, F.when(count > 0, id_text))
    return [
        F.sha2(material, 256).alias("finding_id"), F.col("cik"), severity.alias("severity"),
        category.alias("category"), metric.alias("metric"), message.alias("message"),
        count.cast("bigint").alias("affected_count"), F.lit(MAPPING_VERSION).alias("mapping_version"),
        remediation.alias("remediation"),
    ]


def fact_findings(candidates: DataFrame) -> DataFrame:
    """Findings about one fact each: unmapped concepts and the rejection cascade. The messages are fixed values."""
    reason = F.col("reject_reason")
    source = F.concat(F.col("taxonomy"), F.lit(":"), F.col("concept"))
    message = (
        F.when(reason == "unmapped_concept",
               F.concat(F.lit("No mapping exists for "), source, F.lit("; the fact was not coerced.")))
        .when(reason == "incompatible_unit",
              F.concat(source, F.lit(" uses "), F.col("unit"), F.lit("; expected one of "),
                       F.array_join("mapped_units", ", "), F.lit(".")))
        .when(reason == "incompatible_period_type",
              F.concat(source, F.lit(" is "), F.col("period_type"), F.lit("; the mapping requires "),
                       F.col("mapped_period_type"), F.lit(".")))
        .when(reason == "unsupported_form",
              F.concat(F.lit("Form "), F.col("form"), F.lit(" is outside this mapping's allowed forms.")))
        .when(reason == "invalid_period_context",
              F.lit("duration fact carries an instantaneous SEC frame"))
    )
    return candidates.where(reason.isNotNull()).select(
        *_finding(reason, F.col("canonical_metric"), message, F.col("fact_id"), F.lit(1)),
        F.col("fact_id"),
    )


def missing_metric_findings(candidates: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(company x metric) without an accepted candidate.

    The set of present metrics is bounded by the registry, so it is collected per company
    and subtracted from the registry literal; nothing is cross-joined.
    """
    every = string_array(m.metric for m in mappings)
    present = candidates.groupBy("cik").agg(
        F.collect_set(F.when(F.col("reject_reason").isNull(), F.col("canonical_metric"))).alias("present")
    )
    missing = present.select("cik", F.explode(F.array_except(every, "present")).alias("missing_metric"))
    message = F.concat(F.lit("No compatible fact was found for "), F.col("missing_metric"), F.lit("."))
    return missing.select(
        *_finding(F.lit("missing_metric"), F.col("missing_metric"), message, F.lit(""), F.lit(0))
    )


def duplicate_findings(chosen: DataFrame) -> DataFrame:
    """Period groups with more than one candidate; the affected ids are named by digest."""
    message = F.concat(
        F.lit("Selected "), F.col("accession_number"), F.lit(" from "),
        F.col("candidate_count").cast("string"), F.lit(" facts for the same canonical period."),
    )
    id_text = ids.id_set_text(F.col("candidate_count"), F.col("first_id"), F.col("last_id"), F.col("id_digest"))
    return chosen.where("candidate_count > 1").select(
        *_finding(F.lit("duplicate_period_candidates"), F.col("canonical_metric"), message, id_text,
                  F.col("candidate_count"))
    )


def amendment_findings(chosen: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Selected amended filing fact "), F.col("accession_number"), F.lit("."))
    return chosen.where(F.col("form").endswith("/A")).select(
        *_finding(F.lit("amendment_selected"), F.col("canonical_metric"), message, F.col("fact_id"), F.lit(1))
    )


def summary_counts(raw: DataFrame, chosen: DataFrame) -> DataFrame:
    """Selected and raw fact counts per company, with the digest of the raw ids."""
    totals = raw.groupBy("cik").agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.min("fact_id").alias("first_id"),
        F.max("fact_id").alias("last_id"),
        ids.id_digest(F.col("fact_id")).alias("id_digest"),
    )
    selected = chosen.groupBy("cik").agg(F.count(F.lit(1)).alias("selected_count"))
    return totals.join(selected, "cik", "left").withColumn(
        "selected_count", F.coalesce("selected_count", F.lit(0).cast("bigint"))
    )


def summary_findings(counts: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Selected "), F.col("selected_count").cast("string"), F.lit(" normalized facts from "),
        F.col("raw_count").cast("string"),
        F.lit(f" raw facts using mapping version {MAPPING_VERSION}."),
    )
    id_text = ids.id_set_text(F.col("raw_count"), F.col("first_id"), F.col("last_id"), F.col("id_digest"))
    return counts.select(
        *_finding(F.lit("normalization_summary"), F.lit(None).cast("string"), message, id_text, F.col("raw_count"))
    )


def findings(raw: DataFrame, candidates: DataFrame, chosen: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All nine categories; sort with ``order_findings``."""
    parts = [
        fact_findings(candidates).drop("fact_id"),
        missing_metric_findings(candidates, mappings),
        duplicate_findings(chosen),
        amendment_findings(chosen),
        summary_findings(summary_counts(raw, chosen)),
    ]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def finding_facts(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Link rows (finding, fact) of the fact- and period-level findings.

    The company-level summary affects every raw fact of its company, so its link is the
    ``cik`` itself; it is not expanded here. The candidates of a period are numbered and named by windows over the period, so
    they are not joined with themselves; a period without a company, unit, end or basis has no link.
    """
    single = fact_findings(candidates).select("finding_id", "cik", "fact_id")
    amended = chosen.where(F.col("form").endswith("/A")).select(
        ids.stable_id(MAPPING_VERSION, F.col("cik"), "amendment_selected", F.col("canonical_metric"), F.col("fact_id"))
        .alias("finding_id"), "cik", "fact_id",
    )
    keys = ["cik", "canonical_metric", "unit", *PERIOD_KEY]
    named = F.lit(True)
    for key in keys:
        if key not in ("start_date", "fiscal_year", "fiscal_period"):
            named = named & F.col(key).isNotNull()
    period = Window.partitionBy(*keys)
    counted = candidates.where(F.col("reject_reason").isNull() & named).select(*keys, "fact_id").withColumn(
        "candidate_count", F.count(F.lit(1)).over(period)).where("candidate_count > 1")
    digest = F.concat_ws(":", *[F.sum(part).over(period).cast("decimal(38,0)").cast("string") for part in ids.id_parts(F.col("fact_id"))])
    id_text = ids.id_set_text(F.col("candidate_count"), F.min("fact_id").over(period), F.max("fact_id").over(period), digest)
    members = counted.withColumn("id_text", id_text).select(
        ids.stable_id(MAPPING_VERSION, F.col("cik"), "duplicate_period_candidates", F.col("canonical_metric"), F.col("id_text"))
        .alias("finding_id"), "cik", "fact_id")
    return single.unionByName(amended).unionByName(members)


def severity_rank(column: str = "severity") -> Column:
    """Worst first: error, warning, info."""
    return F.coalesce(
        *[F.when(F.col(column) == s, F.lit(i)) for i, s in enumerate(("error", "warning", "info"))], F.lit(9)
    )


def order_findings(frame: DataFrame, text_order: bool = False) -> DataFrame:
    first = F.col("severity").desc() if text_order else severity_rank()
    return frame.orderBy("cik", first, "category", "finding_id")


def normalize(
    raw: DataFrame,
    mappings: tuple[Mapping, ...] = MAPPINGS,
    policy: SelectionPolicy = SelectionPolicy(),
) -> Normalization:
    candidates = classify_candidates(raw, mappings)
    chosen = choose_facts(candidates, policy)
    return Normalization(
        facts=normalized_facts(chosen),
        findings=findings(raw, candidates, chosen, mappings),
        finding_facts=finding_facts(candidates, chosen),
    )
