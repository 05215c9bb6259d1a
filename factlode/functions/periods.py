"""Reporting-period classification."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTANT, ANNUAL, QUARTERLY = "instant", "annual", "quarterly"
YEAR_TO_DATE, OTHER_DURATION = "year_to_date", "other_duration"

# Frame labels and inclusive day windows.
ANNUAL_FRAME = "^CY[0-9]{4}$"
QUARTERLY_FRAME = "^CY[0-9]{4}Q[1-4]$"
INSTANT_FRAME = "^CY[0-9]{4}(Q[1-4])?I$"
ANNUAL_DAYS = (335, 395)
QUARTERLY_DAYS = (61, 121)
YEAR_TO_DATE_DAYS = (122, 304)
YEAR_TO_DATE_LABELS = ("Q2", "Q3")

DEFAULT_BASES = (INSTANT, ANNUAL, QUARTERLY)


def period_type(start_date: Column) -> Column:
    return F.when(start_date.isNull(), F.lit("instant")).otherwise(F.lit("duration"))


def frame_conflict(start_date: Column, frame: Column) -> Column:
    """True where a duration carries an instant frame label."""
    return start_date.isNotNull() & F.coalesce(frame.rlike(INSTANT_FRAME), F.lit(False))


def reporting_basis(start_date: Column, end_date: Column, frame: Column, fiscal_period: Column) -> Column:
    """Frame label first, then the length of the period in inclusive days."""
    days = F.datediff(end_date, start_date) + 1
    return (
        F.when(start_date.isNull(), INSTANT)
        .when(frame.rlike(ANNUAL_FRAME), ANNUAL)
        .when(frame.rlike(QUARTERLY_FRAME), QUARTERLY)
        .when(days.between(*ANNUAL_DAYS), ANNUAL)
        .when(days.between(*QUARTERLY_DAYS), QUARTERLY)
        .when(fiscal_period.isin(*YEAR_TO_DATE_LABELS) & days.between(*YEAR_TO_DATE_DAYS), YEAR_TO_DATE)
        .otherwise(OTHER_DURATION)
    )


def order_date(start_date: Column, end_date: Column) -> Column:
    return F.coalesce(start_date, end_date)


def periods_align(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Same end and fiscal labels (nulls equal); same start when both are durations."""
    both_durations = left["start_date"].isNotNull() & right["start_date"].isNotNull()
    return (
        (left["end_date"] == right["end_date"])
        & left["fiscal_year"].eqNullSafe(right["fiscal_year"])
        & left["fiscal_period"].eqNullSafe(right["fiscal_period"])
        & (~both_durations | (left["start_date"] == right["start_date"]))
    )


@dataclass(frozen=True)
class PeriodFilter:
    bases: tuple[str, ...] = DEFAULT_BASES
    start_date: date | None = None
    end_date: date | None = None

    def condition(self) -> Column:
        keep = F.col("reporting_basis").isin(*self.bases)
        return keep & window_condition(self.start_date, self.end_date)


def window_condition(start: date | None, end: date | None, column: str = "end_date") -> Column:
    """Inclusive date window; an open side is simply absent."""
    parts: Iterable[Column] = [
        *([F.col(column) >= F.lit(start)] if start else []),
        *([F.col(column) <= F.lit(end)] if end else []),
    ]
    keep = F.lit(True)
    for part in parts:
        keep = keep & part
    return keep


def select_periods(facts: DataFrame, period_filter: PeriodFilter = PeriodFilter()) -> DataFrame:
    """Rows whose basis and end date are asked for; order with ``canonical_order``."""
    return facts.where(period_filter.condition())


def canonical_order(facts: DataFrame) -> DataFrame:
    return facts.orderBy(
        "cik", "canonical_metric", "end_date", order_date(F.col("start_date"), F.col("end_date")),
        "accession_number",
    )
