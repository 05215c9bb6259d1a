"""Reported and derived metric results.

The reference semantics align every anchor result with every candidate of each further
input.  Here a period becomes a *cell*: all results of one company that share end date,
fiscal labels and start date.  A cell holds at most one row per metric, unit and basis, so
its size is bounded by the registries, and every formula is evaluated inside its cell,
which gives back its own rows and the derived ones.  Instants see the latest-starting duration of their period, durations see the instants;
both are brought in by windows over the same partitioning.  One shuffle serves all formulas, and none is
needed where the facts are dealt by company already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.functions.numbers import CONFIDENCE, METRIC, MONEY
from factlode.functions.periods import order_date
from factlode.registries import FORMULA_VERSION, FORMULAS, MAPPINGS, Formula, Mapping

RESULT_COLUMNS = [
    "cik", "metric_result_id", "metric_id", "formula_version", "period_type", "start_date", "end_date",
    "fiscal_year", "fiscal_period", "reporting_basis", "status", "value", "unit", "input_fact_ids",
    "comparability_flags", "data_confidence", "not_computable_reason",
]
GROUP = ["cik", "end_date", "year_key", "label_key"]
NO_YEAR, NO_LABEL = -1, "~"
NO_STRINGS = "array<string>"


def reported_results(facts: DataFrame) -> DataFrame:
    """Every canonical fact as a computed metric result."""
    return facts.select(
        "cik",
        ids.stable_id("reported", F.col("normalized_fact_id")).alias("metric_result_id"),
        F.col("canonical_metric").alias("metric_id"),
        F.lit("reported:1.0.0").alias("formula_version"),
        "period_type", "start_date", "end_date", "fiscal_year", "fiscal_period", "reporting_basis",
        F.lit("computed").alias("status"),
        F.col("value").cast(METRIC).alias("value"),
        "unit",
        F.array("normalized_fact_id").alias("input_fact_ids"),
        F.array().cast(NO_STRINGS).alias("comparability_flags"),
        F.col("data_confidence").cast(CONFIDENCE).alias("data_confidence"),
        F.lit(None).cast("string").alias("not_computable_reason"),
    )


def _entry() -> Column:
    """A result as cell member; the first three fields are the tie-break order."""
    return F.struct(
        F.col("metric_id").alias("metric"),
        order_date(F.col("start_date"), F.col("end_date")).alias("ordered"),
        F.col("metric_result_id").alias("id"),
        (F.col("status") == "computed").alias("computed"),
        "value",
        F.col("data_confidence").alias("confidence"),
        F.col("input_fact_ids").alias("facts"),
        F.col("reporting_basis").alias("basis"),
        "unit",
        F.col("comparability_flags").alias("flags"),
        F.col("not_computable_reason").alias("reason"),
        F.col("formula_version").alias("version"),
    )


def period_cells(results: DataFrame) -> DataFrame:
    """Cells with their own rows and the results visible from the other period type."""
    keyed = results.select(
        "cik", "end_date", "start_date",
        F.coalesce("fiscal_year", F.lit(NO_YEAR)).alias("year_key"),
        F.coalesce("fiscal_period", F.lit(NO_LABEL)).alias("label_key"),
        _entry().alias("e"),
    )
    # the first window names just the group: rows dealt by it, or by the company alone, stay where they are
    newest = Window.partitionBy(*GROUP).orderBy(
        F.col("e.metric"), F.col("e.computed").desc(), F.col("start_date").desc_nulls_last(), F.col("e.id").desc()
    )
    ranked = keyed.withColumns({"position": F.row_number().over(newest), "metric_before": F.lag("e.metric").over(newest)})
    first_of_metric = (F.col("position") == 1) | ~F.col("metric_before").eqNullSafe(F.col("e.metric"))
    is_newest = first_of_metric & F.col("start_date").isNotNull()
    cells = ranked.groupBy(*GROUP, "start_date").agg(
        F.collect_list("e").alias("rows"), F.collect_list(F.when(is_newest, F.col("e"))).alias("newest"),
    )
    whole = Window.partitionBy(*GROUP)
    instants = F.first(F.when(F.col("start_date").isNull(), F.col("rows")), ignorenulls=True).over(whole)
    durations = F.flatten(F.collect_list("newest").over(whole))
    nothing = F.array().cast(cells.schema["rows"].dataType)
    visible = F.when(F.col("start_date").isNull(), durations).otherwise(F.coalesce(instants, nothing))
    return cells.select(*GROUP, "start_date", "rows", visible.alias("visible"))


def _pick_sql(pool: str, metric: str) -> str:
    """The computed candidate with the greatest (start or end, id), or null."""
    return f"array_max(filter({pool}, e -> e.metric = '{metric}' AND e.computed))"


def _value_sql(formula: Formula) -> tuple[str, str]:
    """SQL for (value, whether the denominator is zero); ``a`` is the anchor's row.

    A value out of range is null, so that one company's figures can't end the job for all.
    """
    anchor, *others = formula.inputs
    values = {anchor: "a.value", **{m: f"in_{m}.value" for m in others}}
    money = {m: f"CAST({v} AS {MONEY})" for m, v in values.items()}
    top = f"try_cast({formula.numerator.format(**money)} AS {MONEY})"
    if formula.denominator is None:
        return f"try_cast({top} AS {METRIC})", "false"
    bottom = f"try_cast({formula.denominator.format(**money)} AS {MONEY})"
    return f"try_cast(try_divide({top}, {bottom}) AS {METRIC})", f"coalesce({bottom} = 0, false)"


def _draft_sql(formula: Formula, own: str) -> str:
    """Per anchor: its row, the picked inputs and the value; finished after the explode."""
    anchor, *others = formula.inputs
    value, zero = _value_sql(formula)
    names = ", ".join(f"'{m}'" for m in others)
    inputs = ", ".join(f"in_{m}" for m in others)
    return (
        f"transform(filter({own}, r -> r.metric = '{anchor}'), a -> named_struct('formula', '{formula.metric}', 'a', a, "
        f"'others', CAST(array({names}) AS ARRAY<STRING>), 'inputs', concat(slice(rows, 1, 0), array({inputs})), "
        f"'value', {value}, 'zero', {zero}, 'unit', '{formula.unit}'))"
    )


_DONE = (
    "transform({0}, r -> named_struct('formula', CAST(NULL AS STRING), 'a', r, 'others', CAST(array() AS ARRAY<STRING>), "
    "'inputs', slice({0}, 1, 0), 'value', r.value, 'zero', false, 'unit', r.unit))"
)


def _finish_sql(draft: str, start: str = "start_date", end: str = "end_date") -> dict[str, str]:
    """SQL of the finished fields of a draft struct."""
    d = draft
    absent = f"filter({d}.others, (m, i) -> get({d}.inputs, i).id IS NULL)"
    missing = (
        f"CASE WHEN exists({d}.inputs, x -> x.id IS NULL) THEN {absent} WHEN NOT {d}.a.computed THEN array({d}.a.metric) "
        f"ELSE CAST(array() AS ARRAY<STRING>) END"
    )
    facts = (
        f"array_sort(flatten(filter(concat(array({d}.a.facts), transform({d}.inputs, x -> x.facts)), f -> f IS NOT NULL)))"
    )
    confidence = f"array_min(concat(array({d}.a.confidence), transform({d}.inputs, x -> x.confidence)))"
    return {
        "missing": missing, "facts": facts, "confidence": confidence,
        "id_head": f"concat_ws('|', '{FORMULA_VERSION}', {d}.formula, coalesce(CAST({start} AS STRING), ''), CAST({end} AS STRING))",
    }


def _entry_sql(formula: Formula, own: str) -> str:
    """A formula whose result other formulas read: finished inside the cell."""
    fields = _finish_sql("d")
    named = (
        f"transform({_draft_sql(formula, own)}, d -> named_struct('d', d, 'missing', {fields['missing']}, "
        f"'facts', {fields['facts']}, 'confidence', {fields['confidence']}, 'id_head', {fields['id_head']}))"
    )
    complete, computed = "size(t.missing) = 0", "(size(t.missing) = 0 AND NOT t.d.zero AND t.d.value IS NOT NULL)"
    return (
        f"transform({named}, t -> named_struct('metric', t.d.formula, 'ordered', coalesce(start_date, end_date), "
        f"'id', sha2(concat_ws('|', t.id_head, array_join(t.facts, '|')), 256), 'computed', {computed}, "
        f"'value', CASE WHEN {computed} THEN t.d.value END, 'confidence', CASE WHEN {computed} THEN t.confidence END, "
        f"'facts', t.facts, 'basis', t.d.a.basis, 'unit', CASE WHEN {computed} THEN t.d.unit END, "
        f"'flags', {_FLAGS.format(complete, 't.d.zero', 't.d.value IS NULL')}, 'reason', {_REASON.format(complete, 't.d.zero', 't.missing', 't.d.value IS NULL')}, "
        f"'version', '{FORMULA_VERSION}'))"
    )


_FLAGS = (
    "CASE WHEN NOT ({0}) THEN array('missing_inputs') WHEN {1} THEN array('zero_denominator') "
    "WHEN {2} THEN array('overflow') ELSE CAST(array() AS ARRAY<STRING>) END"
)
_REASON = (
    "CASE WHEN NOT ({0}) THEN concat('Missing required inputs: ', array_join({2}, ', ')) "
    "WHEN {1} THEN 'Formula denominator is zero' WHEN {3} THEN 'Formula value is out of range' END"
)


def formula_rounds(formulas: tuple[Formula, ...]) -> list[tuple[Formula, ...]]:
    """Rounds of formulas whose inputs are produced by earlier rounds only."""
    level: dict[str, int] = {}
    rounds: list[list[Formula]] = []
    for formula in formulas:
        number = max((level[m] + 1 for m in formula.inputs if m in level), default=0)
        level[formula.metric] = max(number, level.get(formula.metric, 0))
        while len(rounds) <= number:
            rounds.append([])
        rounds[number].append(formula)
    return [tuple(r) for r in rounds if r]


def evaluate_cells(cells: DataFrame, formulas: tuple[Formula, ...]) -> DataFrame:
    """The cells' own results followed by every formula's.

    Inside the cell a formula only picks its inputs and computes its value; ids, reasons
    and flags are ordinary columns after one explode.  The few results that other formulas
    read are finished inside the cell.
    """
    read = {m for f in formulas for m in f.inputs}
    frame, earlier, drafts = cells, [], [_DONE.format("rows")]
    for batch in formula_rounds(formulas):
        own = f"concat({', '.join(['rows', *earlier])})"
        pool = f"concat({', '.join(['rows', 'visible', *earlier])})"
        needed = sorted({m for f in batch for m in f.inputs[1:]})
        frame = frame.withColumns({f"in_{m}": F.expr(_pick_sql(pool, m)) for m in needed})
        entries = {f"out_{f.metric}": F.expr(_entry_sql(f, own)) for f in batch if f.metric in read}
        if entries:
            frame = frame.withColumns(entries)
        earlier += list(entries)
        drafts += [_DONE.format(name) for name in entries]
        drafts += [_draft_sql(f, own) for f in batch if f.metric not in read]
    flat = frame.selectExpr(*GROUP, "start_date", f"explode(concat({', '.join(drafts)})) AS o")
    fields = _finish_sql("o")
    derived = F.col("o.formula").isNotNull()
    shaped = flat.selectExpr(
        "*", f"{fields['missing']} AS missing", f"{fields['facts']} AS facts", f"{fields['confidence']} AS confidence",
        f"{fields['id_head']} AS id_head",
    ).withColumn("complete", F.size("missing") == 0)
    sound = F.col("complete") & ~F.col("o.zero") & F.col("o.value").isNotNull()
    computed = F.when(derived, sound).otherwise(F.col("o.a.computed"))
    either = lambda new, old: F.when(derived, new).otherwise(F.col(f"o.a.{old}"))
    if_computed = lambda column: F.when(sound, column)
    return shaped.select(
        "cik",
        either(F.sha2(F.concat_ws("|", "id_head", F.array_join("facts", "|")), 256), "id").alias("metric_result_id"),
        F.coalesce("o.formula", "o.a.metric").alias("metric_id"),
        either(F.lit(FORMULA_VERSION), "version").alias("formula_version"),
        F.when(F.col("start_date").isNull(), "instant").otherwise("duration").alias("period_type"),
        "start_date", "end_date",
        F.when(F.col("year_key") != NO_YEAR, F.col("year_key")).alias("fiscal_year"),
        F.when(F.col("label_key") != NO_LABEL, F.col("label_key")).alias("fiscal_period"),
        F.col("o.a.basis").alias("reporting_basis"),
        F.when(computed, "computed").otherwise("not_computable").alias("status"),
        either(if_computed(F.col("o.value")), "value").alias("value"),
        either(if_computed(F.col("o.unit")), "unit").alias("unit"),
        either(F.col("facts"), "facts").alias("input_fact_ids"),
        either(F.expr(_FLAGS.format("complete", "o.zero", "o.value IS NULL")), "flags").alias("comparability_flags"),
        either(if_computed(F.col("confidence")), "confidence").alias("data_confidence"),
        either(F.expr(_REASON.format("complete", "o.zero", "missing", "o.value IS NULL")), "reason").alias("not_computable_reason"),
    )


def formula_passes(
    formulas: tuple[Formula, ...] = FORMULAS, mappings: tuple[Mapping, ...] = MAPPINGS
) -> list[tuple[Formula, ...]]:
    """Split formulas so that derived inputs used inside a pass stay inside one cell.

    A derived metric has the period type of its anchor.  Used by an anchor of the same type
    it lies in the same cell; used across types it needs the cells to be formed again.  The
    default formulas need a single pass.
    """
    kinds = {m.metric: m.period_type for m in mappings}
    passes: list[list[Formula]] = [[]]
    current: set[str] = set()
    for formula in formulas:
        kind = kinds.get(formula.inputs[0])
        if any(m in current and kinds.get(m) != kind for m in formula.inputs[1:]):
            passes.append([])
            current = set()
        kinds[formula.metric] = kind
        current.add(formula.metric)
        passes[-1].append(formula)
    return [tuple(p) for p in passes if p]


def metric_results(
    facts: DataFrame,
    formulas: tuple[Formula, ...] = FORMULAS,
    mappings: tuple[Mapping, ...] = MAPPINGS,
) -> DataFrame:
    """Reported and derived results; sort with ``order_results``."""
    results = reported_results(facts)
    for batch in formula_passes(formulas, mappings):
        results = evaluate_cells(period_cells(results), batch)
    return results.select(*RESULT_COLUMNS)


def order_results(results: DataFrame) -> DataFrame:
    return results.orderBy(
        "cik", "metric_id", "end_date", order_date(F.col("start_date"), F.col("end_date")), "metric_result_id"
    )
