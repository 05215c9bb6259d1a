"""The driver's tables presented as filings data (rules in FIXTURES.md, part 2)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.session import checkpoint_dir

MONEY = "decimal(20,4)"
WIDE = "decimal(18,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(column: str) -> Column:
    return F.lpad(F.col(column).cast("string"), 10, "0")


# Concept, unit, period type and value rule of each synthetic observation.
_OUTLIER = "fiscal_year = 2000 AND fiscal_period = 'Q4' AND digit IN (2, 4, 6)"
_CONCEPT_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("Revenues", "USD", "duration", "ext"),
    ("SalesRevenueNet", "USD", "duration", "ext"),
    ("GrossProfit", "USD", "duration", f"ext - disc * CASE WHEN {_OUTLIER} THEN 15 ELSE 5 END"),
    ("OperatingIncomeLoss", "USD", "duration", "ext - disc * 5 - tax * 5"),
    ("SellingGeneralAndAdministrativeExpense", "USD", "duration", "disc * 2"),
    ("ResearchAndDevelopmentExpense", "USD", "duration", f"tax * CASE WHEN {_OUTLIER} THEN 30 ELSE 2 END"),
    ("IncomeTaxExpenseBenefit", "USD", "duration", "tax"),
    ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "USD", "duration",
     "ext - disc * 4 - tax * 4"),
    ("NetIncomeLoss", "USD", "duration", "ext - disc * 4 - tax * 5"),
    ("NetCashProvidedByUsedInOperatingActivities", "USD", "duration", "ext - disc * 3 - ret"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "USD", "duration", "tax * 3"),
    ("ShareBasedCompensation", "USD", "duration", "disc"),
    ("PaymentsForRepurchaseOfCommonStock", "USD", "duration", "ret"),
    ("WeightedAverageNumberOfSharesOutstandingBasic", "shares", "duration", "n * 100"),
    ("WeightedAverageNumberOfDilutedSharesOutstanding", "shares", "duration", "n * 100 + qty"),
    ("Assets", "USD", "instant", "ext * 2"),
    ("Liabilities", "USD", "instant", "ext + ret"),
    ("AssetsCurrent", "USD", "instant", "acc + qty"),
    ("LiabilitiesCurrent", "USD", "instant", "CASE WHEN n % 7 = 0 THEN 0 ELSE ret END"),
    ("StockholdersEquity", "USD", "instant", "ext - ret"),
    ("LongTermDebt", "USD", "instant", "disc * 4"),
    ("Goodwill", "USD", "instant", "tax"),
    ("AccountsReceivableNetCurrent", "USD", "instant", "acc"),
    ("InventoryNet", "USD", "instant", "qty * 10"),
    ("AccountsPayableCurrent", "USD", "instant", "ret"),
)


def _quarter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed to (supplier, quarter): the only pass over the big table.

    The sums are exact decimals, so annual and year-to-date totals follow from these rows.
    """
    # Money has two decimals, so hundredths are exact integers and the sums stay in longs.
    hundredths = lambda column: F.rint(F.col(column) * 100).cast("bigint")
    ext = hundredths("l_extendedprice")
    total = lambda column: F.sum(column).cast("decimal(20,0)")
    cents, points = F.lit("0.01").cast("decimal(3,2)"), F.lit("0.0001").cast("decimal(5,4)")
    flagged = lambda flag: F.when(F.col("l_returnflag") == flag, ext).otherwise(F.lit(0).cast("bigint"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.trunc("l_shipdate", "quarter").alias("quarter_start"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            (total(ext) * cents).cast(WIDE).alias("ext"),
            (total(ext * hundredths("l_discount")) * points).cast(WIDE).alias("disc"),
            (total(ext * hundredths("l_tax")) * points).cast(WIDE).alias("tax"),
            (total(hundredths("l_quantity")) * cents).cast(WIDE).alias("qty"),
            (total(flagged("R")) * cents).cast(WIDE).alias("ret"),
            (total(flagged("A")) * cents).cast(WIDE).alias("acc"),
        )
        .withColumn("cik", padded("l_suppkey"))
        .drop("l_suppkey")
    )


#: Quarter rows of a task, some forty wide facts each: what a task holds stays the same however large the tables are.
QUARTERS_PER_TASK = 2_000


def by_company(quarters: DataFrame) -> DataFrame:
    """The quarter rows dealt by company, before they become facts.

    Every later grouping has the company among its keys, so facts, metric results and statistics are made where the quarters
    are and cross no further shuffle. The rows are written to the checkpoint folder first: line items are summed once for all
    parts of a query that start from them, and the number of tasks follows the number of rows.
    """
    spark = quarters.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/quarters-{uuid4().hex}"
    quarters.write.parquet(folder)
    kept = spark.read.parquet(folder)
    tasks = -(-kept.count() // QUARTERS_PER_TASK)
    return kept.repartition(max(tasks, spark.sparkContext.defaultParallelism), "cik")


def _period_totals(quarters: DataFrame) -> DataFrame:
    """Quarterly, annual and two year-to-date totals from the quarter rows."""
    start, year_start = F.col("quarter_start"), F.trunc("quarter_start", "year")
    quarter = F.quarter("quarter_start")

    def period(kind: str, first: Column, months: int, label: Column, form: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), first.alias("start_date"),
            F.date_sub(F.add_months(first, months), 1).alias("end_date"),
            label.alias("fiscal_period"), F.lit(form).alias("form"),
        )

    options = F.array(
        period("Q", start, 3, F.concat(F.lit("Q"), quarter.cast("string")), "10-Q"),
        period("A", year_start, 12, F.lit("FY"), "10-K"),
        F.when(quarter <= 2, period("Y", year_start, 6, F.lit("Q2"), "10-Q")),
        F.when(quarter <= 3, period("Y", year_start, 9, F.lit("Q3"), "10-Q")),
    )
    sums = [F.sum(c).cast(WIDE).alias(c) for c in ("ext", "disc", "tax", "qty", "ret", "acc")]
    return (
        quarters.withColumn("fiscal_year", F.year("quarter_start"))
        .withColumn("period", F.explode(F.filter(options, lambda p: p.isNotNull())))
        .groupBy("cik", "fiscal_year", "period")
        .agg(F.sum("n").cast("int").alias("n"), *sums)
        .select("cik", "fiscal_year", "period.*", "n", "ext", "disc", "tax", "qty", "ret", "acc")
        .withColumn("digit", F.substring("cik", 10, 1).cast("int"))
    )


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliberately dirty company facts, one supplier per company."""
    concepts = F.array(*[
        F.struct(
            F.lit(name).alias("concept"), F.lit(unit).alias("unit"), F.lit(kind).alias("ptype"),
            F.expr(f"CAST({rule} AS {MONEY})").alias("value"),
        )
        for name, unit, kind, rule in _CONCEPT_RULES
    ])
    observed = (
        _period_totals(by_company(_quarter_totals(spark, sf_dir)))
        .withColumn("o", F.explode(concepts))
        .select("*", "o.*")
        .where("NOT (kind = 'Y' AND ptype = 'instant')")
        .where("NOT (concept = 'PaymentsToAcquirePropertyPlantAndEquipment' AND digit = 5)")
    )
    restated = F.expr(
        "kind = 'A' AND fiscal_year % 2 = 0 AND concept IN ('Revenues', 'NetIncomeLoss', 'Assets')"
    )
    versions = F.when(restated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = observed.withColumn("amended", F.explode(versions))
    instant_frame = "ptype = 'instant' OR (concept = 'NetIncomeLoss' AND digit = 1 AND fiscal_period = 'Q4')"
    facts = rows.selectExpr(
        "cik",
        "'us-gaap' AS taxonomy",
        "concept",
        "CASE WHEN concept = 'InventoryNet' AND digit = 3 THEN 'EUR' ELSE unit END AS unit",
        f"CAST(value + amended * 100 AS {MONEY}) AS value",
        "CASE WHEN ptype = 'instant' AND NOT (concept = 'Goodwill' AND digit = 7) THEN NULL ELSE start_date END AS start_date",
        "end_date",
        "fiscal_year",
        "fiscal_period",
        "CASE WHEN kind = 'A' AND digit = 9 THEN '20-F' WHEN amended = 1 THEN concat(form, '/A') ELSE form END AS form",
        "date_add(end_date, 30 + 60 * amended) AS filed",
        "concat(cik, '-', fiscal_year, '-', kind, fiscal_period, CASE WHEN amended = 1 THEN '-A' ELSE '' END) AS accession_number",
        "CASE WHEN kind = 'Y' OR fiscal_year % 2 = 1 THEN NULL ELSE concat('CY', fiscal_year, "
        f"CASE WHEN kind = 'Q' THEN fiscal_period ELSE '' END, CASE WHEN {instant_frame} THEN 'I' ELSE '' END) END AS frame",
        "CAST(NULL AS INT) AS decimals",
    )
    return facts.withColumns({
        "fact_id": ids.fact_id(*[F.col(c) for c in (
            "cik", "taxonomy", "concept", "unit", "value", "start_date", "end_date", "accession_number")]),
        "manifest_id": ids.stable_id("companyfacts", F.col("cik")),
    })


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies; the region stands for the SIC code."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        padded("s_suppkey").alias("cik"),
        F.col("s_name").alias("legal_name"),
        F.array(F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))).alias("tickers"),
        F.col("n_regionkey").cast("string").alias("sic"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the ticker directory."""
    return table(spark, sf_dir, "customer").select(
        padded("c_custkey").alias("cik"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("legal_name"),
    )


# Order priority -> form type.
_FORMS = (("1-URGENT", "8-K"), ("2-HIGH", "10-K"), ("3-MEDIUM", "10-Q"), ("4-NOT SPECIFIED", "10-K/A"), ("5-LOW", "10-Q/A"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filing metadata."""
    form = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(f)) for p, f in _FORMS])
    filed = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("accession_number"),
        padded("o_custkey").alias("cik"),
        form.alias("form"),
        filed.alias("filing_date"),
        F.when(F.col("o_orderstatus") != "P", filed).alias("report_period"),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        form.endswith("/A").alias("is_amendment"),
    )


# Text put around every document so that it reads like a filing with Item headings.
COVER = "Cover page"
ITEM_7 = "PART II Item 7. Discussion of gross margin, cash flows, liquidity and working capital"
ITEM_8 = "Item 8. Notes on receivables, inventory policy, income taxes and stock compensation"


def spread(frame: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores is dealt to all of them before long work on each row; a larger one stays as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain-text filings, ten documents per company."""
    documents = spread(table(spark, sf_dir, "documents"))
    forms = F.when(F.col("lang") == "en", "10-K").otherwise("10-Q")
    return documents.select(
        F.lpad(F.floor(F.col("doc_id") / 10).cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("accession_number"),
        forms.alias("form"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")).alias("filing_date"),
        F.lit(None).cast("date").alias("report_period"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".htm")).alias("primary_document"),
        F.sha2("text", 256).alias("content_sha256"),
        F.concat_ws(
            "\n", F.lit(COVER), F.lit(ITEM_7), "text", F.lit(ITEM_8),
            F.concat(F.lit("Source "), "source", F.lit(" language "), "lang"),
        ).alias("body"),
    )


def filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as filing HTML, one filing per page."""
    return spread(table(spark, sf_dir, "pages")).select(
        F.lpad(F.floor(F.col("page_id") / 10).cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("P-"), F.col("page_id").cast("string")).alias("accession_number"),
        F.lit("10-K").alias("form"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("filing_date"),
        F.lit(None).cast("date").alias("report_period"),
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".htm")).alias("primary_document"),
        F.sha2("html", 256).alias("content_sha256"),
        F.col("url").alias("source_url"),
        "html",
    )


# ------------------------------------------------------------------------ JSON payloads
def companyfacts_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-facts JSON, one payload per company, concept and unit.

    A payload holds the periods of one concept, so its size follows the calendar.
    """
    observation = F.struct(
        F.col("start_date").alias("start"), F.col("end_date").alias("end"), F.col("value").alias("val"),
        F.col("accession_number").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"),
        "form", "filed", "frame",
    )
    grouped = raw_facts(spark, sf_dir).groupBy("cik", "taxonomy", "concept", "unit").agg(
        F.collect_list(observation).alias("observations"), F.first("manifest_id").alias("manifest_id")
    )
    concept = F.struct(F.col("concept").alias("label"), F.create_map("unit", "observations").alias("units"))
    body = F.to_json(F.struct(
        F.col("cik").cast("bigint").alias("cik"), F.concat(F.lit("Company "), "cik").alias("entityName"),
        F.create_map("taxonomy", F.create_map("concept", concept)).alias("facts"),
    ))
    return grouped.select("cik", body.alias("body"), "manifest_id")


def submissions_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions JSON of the companies, with untidy tickers and one filing each."""
    ticker = F.concat(F.lit("t"), F.col("cik").cast("bigint").cast("string"))
    recent = F.struct(
        F.array(F.concat("cik", F.lit("-1")), F.concat("cik", F.lit("-2"))).alias("accessionNumber"),
        F.array(F.lit("2020-01-31"), F.lit("2020-04-30")).alias("filingDate"),
        F.array(F.lit(""), F.lit("2020-03-31")).alias("reportDate"),
        F.array(F.lit("8-K"), F.lit("10-K/A")).alias("form"),
        F.array(F.lit("a.htm"), F.lit("b.htm")).alias("primaryDocument"),
    )
    body = F.to_json(F.struct(
        F.col("cik").cast("bigint").alias("cik"), F.lit("operating").alias("entityType"),
        F.col("legal_name").alias("name"), F.array(F.upper(ticker), ticker, F.lit("zz")).alias("tickers"),
        F.array(F.lit("NYSE"), F.lit("Nasdaq"), F.lit("NYSE")).alias("exchanges"),
        F.col("sic").cast("int").alias("sic"),
        F.struct(F.struct(
            F.concat("cik", F.lit(" Main St")).alias("street1"), F.lit("").alias("street2"), F.lit(" Town ").alias("city"),
            F.lit("CA").alias("stateOrCountry"), F.lit("94000").alias("zipCode"),
        ).alias("business")).alias("addresses"),
        F.struct(recent.alias("recent")).alias("filings"),
    ))
    return companies(spark, sf_dir).select("cik", body.alias("body"), F.sha2("cik", 256).alias("manifest_id"))


def defective_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Submissions and company facts of every company, broken by the last digit of its CIK."""
    digit = F.substring("cik", 10, 1).cast("int")
    submissions = submissions_payloads(spark, sf_dir)
    body = (
        F.when(digit == 3, F.substring("body", 1, 40))
        .when(digit == 4, F.replace("body", F.lit('"form":["8-K",'), F.lit('"form":[')))
        .when(digit == 5, F.replace("body", F.lit('"entityType":"operating",'), F.lit("")))
        .otherwise(F.col("body"))
    )
    facts = companies(spark, sf_dir).where(digit != 7).select(
        "cik",
        F.to_json(F.struct(
            (F.col("cik").cast("bigint") + F.when(digit == 2, 1).otherwise(0)).alias("cik"),
            F.upper(F.concat("legal_name", F.when(digit == 1, "x").otherwise(""))).alias("entityName"),
            F.when(digit != 6, F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Assets"), F.struct(
                F.create_map(F.lit("USD"), F.array(F.struct(
                    F.lit("2020-12-31").alias("end"), F.lit(1.5).alias("val"), F.lit("a-1").alias("accn"),
                    F.lit("10-K").alias("form"),
                    F.when(digit != 8, "2021-02-01").alias("filed"),
                ))).alias("units"),
            )))).alias("facts"),
        )).alias("body"),
        F.sha2("cik", 256).alias("manifest_id"),
    )
    return submissions.withColumn("body", body), facts


def filing_list_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions JSON with filings in parallel arrays, at most 64 order keys per payload."""
    rows = filings(spark, sf_dir).withColumn("part", F.floor(F.col("accession_number").cast("bigint") / 64))
    row = F.struct("accession_number", "filing_date", "report_period", "form", "primary_document")
    lists = rows.groupBy("cik", "part").agg(F.array_sort(F.collect_list(row)).alias("r"))
    text = lambda column: F.transform("r", lambda x: F.coalesce(x[column].cast("string"), F.lit("")))
    body = F.to_json(F.struct(
        F.col("cik").alias("cik"), F.lit("operating").alias("entityType"), F.lit("N").alias("name"),
        F.array().cast("array<string>").alias("tickers"), F.array().cast("array<string>").alias("exchanges"),
        F.struct(F.struct(
            text("accession_number").alias("accessionNumber"), text("filing_date").alias("filingDate"),
            text("report_period").alias("reportDate"), text("form").alias("form"),
            text("primary_document").alias("primaryDocument"),
        ).alias("recent")).alias("filings"),
    ))
    return lists.select("cik", body.alias("body"), F.sha2(F.concat_ws("|", "cik", F.col("part").cast("string")), 256).alias("manifest_id"))


def directory_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory JSON objects of at most 256 customers each."""
    rows = table(spark, sf_dir, "customer")
    entry = F.struct(
        F.col("c_custkey").cast("string").alias("n"),
        F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker"),
                 F.col("c_name").alias("title")).alias("e"),
    )
    return rows.groupBy(F.floor(F.col("c_custkey") / 256).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("body")
    ).select("body")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' registered addresses; nations 0-19 are the first twenty states, others unknown."""
    from factlode.registries import STATE_CENTROIDS

    codes = F.array(*[F.lit(s) for s, _, _ in STATE_CENTROIDS[:20]])
    state = F.when(F.col("c_nationkey") < 20, F.lower(F.get(codes, F.col("c_nationkey")))).otherwise("XX")
    return table(spark, sf_dir, "customer").select(
        padded("c_custkey").alias("cik"),
        F.concat(F.col("c_custkey").cast("string"), F.lit(" Main St ")).alias("street1"),
        F.when(F.col("c_custkey") % 3 == 0, "Floor 2").alias("street2"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" "), "c_mktsegment")).alias("city"),
        state.alias("state_or_country"),
        F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0").alias("zip_code"),
        F.concat(F.lit("https://data.example.org/"), F.col("c_custkey").cast("string")).alias("source_url"),
        F.sha2("c_name", 256).alias("source_sha256"),
    )


# ------------------------------------------------------------------------ claims of runs
def claim_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Conversations as runs: assistant turns are claims, the user turns after them verify."""
    turns = table(spark, sf_dir, "conversations").select(
        padded("conv_id").alias("run_id"), F.col("conv_id").cast("string").alias("c"), "turn", "role",
        F.length("text").alias("n"),
    )
    label = lambda prefix, number: F.concat(F.lit(prefix), "c", F.lit("-"), number.cast("string"))
    turn, n = F.col("turn"), F.col("n")
    roles = F.array(F.lit("investigator"), F.lit("bull"), F.lit("skeptical"))
    claims = turns.where("role = 'assistant'").select(
        "run_id", label("claim-", turn).alias("claim_id"),
        F.get(roles, (F.floor(turn / 2) % 3).cast("int")).alias("role"),
        F.when(n % 5 != 0, F.array(label("S", turn % 4))).otherwise(F.array().cast("array<string>")).alias("signal_ids"),
        F.array(label("E", turn), label("E", turn + 2)).alias("evidence_ids"),
        F.when(n % 3 == 0, F.array(label("F", n % 7)))
        .otherwise(F.array(label("M", turn % 3), label("F", n % 7))).alias("fact_ids"),
        F.array(label("M", turn % 3)).alias("metric_result_ids"), F.lit(True).alias("material"),
    )
    users = turns.where("role = 'user'")
    statuses = F.array(F.lit("supported"), F.lit("partially_supported"), F.lit("unsupported"), F.lit("contradicted"))
    verifications = users.where("turn > 0").select(
        "run_id", label("claim-", turn - 1).alias("claim_id"), F.get(statuses, (n % 4).cast("int")).alias("status"),
        F.when(n % 2 == 0, F.array(label("E", turn - 1), label("E", turn + 3)))
        .otherwise(F.array(label("E", turn - 1))).alias("checked_evidence_ids"), "turn",
    )
    verifications = verifications.unionByName(verifications.where("turn = 2")).drop("turn")
    return {
        "claims": claims, "verifications": verifications,
        "signals": users.select("run_id", label("S", turn % 4).alias("signal_id"),
                                F.array(label("T", turn)).alias("source_test_result_ids")),
        "evidence": turns.where("n % 4 <> 0").select("run_id", label("E", turn).alias("evidence_id")),
        "facts": users.select("run_id", label("F", n % 7).alias("normalized_fact_id")).distinct(),
        "tests": users.select("run_id", label("T", turn).alias("test_result_id"),
                              F.array(label("M", turn % 3)).alias("metric_result_ids")),
        "results": users.select("run_id", label("M", turn % 3).alias("metric_result_id")).distinct(),
    }


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as reports whose role outputs are the turn's text."""
    said = lambda role: F.when(F.col("role") == role, F.struct(F.length("text").alias("size")))
    nothing = F.lit(None).cast("struct<size: int>")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("run_id"),
        padded("conv_id").alias("cik"), F.lit("1").alias("prompt_version"), F.lit("m").alias("model_name"),
        said("user").alias("planner"), said("assistant").alias("investigator"), nothing.alias("bull"),
        nothing.alias("skeptical"), F.struct(F.col("turn").cast("int").alias("size")).alias("verifier"), said("system").alias("judge"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as investigation runs."""
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "partial").otherwise("failed")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), status.alias("status"), (F.col("event_id") % 2 == 0).alias("deterministic_only")
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as search texts, each for the company of the same number."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), padded("item_id").alias("cik"), F.col("text").alias("query")
    )


def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document two phrases of its words, as terms with a hyphen and an underscore inside, asked of its company."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    joined = lambda first, size, mark: F.array_join(F.slice("words", first, size), mark)
    return table(spark, sf_dir, "documents").withColumn("words", words).where(F.size("words") > 8).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"),
        F.lpad(F.floor(F.col("doc_id") / 10).cast("string"), 10, "0").alias("cik"),
        F.concat(joined(3, 2, "-"), F.lit(" "), joined(6, 3, "_")).alias("query"))
