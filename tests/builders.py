"""Small hand-made inputs."""

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.registries import MAPPINGS

RAW = (
    "cik string, taxonomy string, concept string, unit string, value decimal(20,4), start_date date, end_date date, "
    "fiscal_year int, fiscal_period string, form string, filed date, accession_number string, frame string"
)
CONCEPT = {m.metric: m.concepts[0].name for m in MAPPINGS}
UNIT = {m.metric: m.units[0] for m in MAPPINGS}
KIND = {m.metric: m.period_type for m in MAPPINGS}


def raw_frame(spark, rows):
    frame = spark.createDataFrame(rows, RAW)
    return frame.withColumns({
        "decimals": F.lit(None).cast("int"), "manifest_id": F.lit("m-1"),
        "fact_id": ids.fact_id(*[F.col(c) for c in (
            "cik", "taxonomy", "concept", "unit", "value", "start_date", "end_date", "accession_number")]),
    })


def fact(metric, value, year=2025, cik="0000000001", form="10-K", accession=None, concept=None, unit=None, start="year",
         label="FY", end=None, frame=None, filed=None):
    end = end or date(year, 12, 31)
    begins = None if KIND.get(metric) == "instant" else (date(year, 1, 1) if start == "year" else start)
    return (
        cik, "us-gaap", concept or CONCEPT[metric], unit or UNIT[metric], Decimal(str(value)), begins, end, year, label, form,
        filed or end + timedelta(days=40), accession or f"{cik}-{year}", frame,
    )


# The hand-computed company year.
COMPANY_YEAR = dict(
    revenue=100, gross_profit=40, operating_income=25, net_income=20, operating_cash_flow=30, capital_expenditure=10,
    stock_based_compensation=5, research_development=8, selling_general_administrative=10, pretax_income=25,
    income_tax_expense=5, basic_shares=100, diluted_shares=105, share_repurchases=8, assets=200, liabilities=120,
    current_assets=80, current_liabilities=40, equity=80, debt=50, goodwill=20, receivables=15, inventory=10,
    accounts_payable=12,
)
