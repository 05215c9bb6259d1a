"""Landed company JSON -> companies, filings and raw facts.

A payload frame has ``cik`` (the company it was fetched for), ``body`` (JSON text) and
``manifest_id``.  A payload that fails any check is rejected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.functions.numbers import MONEY
from factlode.functions.text import casefold

OBSERVATION = (
    "STRUCT<start: DATE, `end`: DATE, val: STRING, accn: STRING, fy: INT, fp: STRING, form: STRING, filed: DATE, "
    "frame: STRING, decimals: INT>"
)
COMPANYFACTS = (
    "STRUCT<cik: STRING, entityName: STRING, facts: MAP<STRING, MAP<STRING, STRUCT<label: STRING, description: STRING, "
    f"units: MAP<STRING, ARRAY<{OBSERVATION}>>>>>>"
)
ADDRESS = "STRUCT<street1: STRING, street2: STRING, city: STRING, stateOrCountry: STRING, zipCode: STRING>"
SUBMISSIONS = (
    "STRUCT<cik: STRING, entityType: STRING, name: STRING, tickers: ARRAY<STRING>, exchanges: ARRAY<STRING>, "
    f"sic: STRING, addresses: STRUCT<business: {ADDRESS}, mailing: {ADDRESS}>, "
    "filings: STRUCT<recent: STRUCT<accessionNumber: ARRAY<STRING>, filingDate: ARRAY<STRING>, "
    "reportDate: ARRAY<STRING>, form: ARRAY<STRING>, primaryDocument: ARRAY<STRING>>>>"
)
DIRECTORY = "MAP<STRING, STRUCT<cik_str: STRING, ticker: STRING, title: STRING>>"
RECENT = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")


# ---------------------------------------------------------------------------- landed files
def read_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Landed files with their bytes; the company is the ``CIK##########`` in the file name."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content",
                ids.normalize_cik(F.regexp_extract("path", "CIK([0-9]{1,10})", 1)).alias("cik"))
    )


def payload_manifest(files: DataFrame, url: str = "path", content: str = "content") -> DataFrame:
    """Byte length, content hash and manifest id of each file."""
    digest = F.sha2(F.col(content), 256)
    return files.select(
        F.col(url).alias("canonical_url"),
        F.octet_length(F.col(content)).cast("bigint").alias("byte_length"),
        digest.alias("content_sha256"),
        F.sha2(F.concat(F.col(url), F.lit("\n"), digest), 256).alias("manifest_id"),
    )


def verify_payloads(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Manifest rows against an earlier manifest: new, unchanged, changed or missing."""
    before = previous.select("canonical_url", F.col("content_sha256").alias("known_sha256"))
    joined = current.join(before, "canonical_url", "full_outer")
    return joined.withColumn(
        "integrity",
        F.when(F.col("known_sha256").isNull(), "new").when(F.col("content_sha256").isNull(), "missing")
        .when(F.col("content_sha256") == F.col("known_sha256"), "unchanged").otherwise("changed"),
    )


def payloads(files: DataFrame) -> DataFrame:
    """Payload frame of landed files."""
    digest = F.sha2("content", 256)
    return files.select(
        "cik", F.decode("content", "UTF-8").alias("body"),
        F.sha2(F.concat("path", F.lit("\n"), digest), 256).alias("manifest_id"),
    )


# ------------------------------------------------------------------------------- checks
def _blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def _observations(parsed: str) -> Column:
    return F.expr(
        f"flatten(transform(map_values({parsed}.facts), concepts -> "
        "flatten(transform(map_values(concepts), c -> flatten(map_values(c.units))))))"
    )


def companyfacts_problem(parsed: str = "p") -> Column:
    """Why a company-facts payload is invalid, or null."""
    broken = F.exists(
        _observations(parsed),
        lambda o: o["end"].isNull() | _blank(o["accn"]) | _blank(o["form"]) | o["filed"].isNull()
        | o["val"].try_cast("double").isNull(),
    )
    return (
        F.when(F.col(parsed).isNull() | F.col(f"{parsed}.facts").isNull(), "invalid_payload")
        .when(F.col(f"{parsed}.cik").isNull() | _blank(F.col(f"{parsed}.entityName")), "invalid_payload")
        .when(broken, "invalid_payload")
    )


def submissions_problem(parsed: str = "p") -> Column:
    recent = f"{parsed}.filings.recent"
    arrays = [F.col(f"{recent}.{name}") for name in RECENT]
    absent = F.lit(False)
    for array in arrays:
        absent = absent | array.isNull()
    uneven = F.lit(False)
    for array in arrays[1:]:
        uneven = uneven | (F.size(arrays[0]) != F.size(array))
    bad_dates = F.exists(arrays[1], lambda d: d.try_cast("date").isNull()) | F.exists(
        arrays[2], lambda d: d.isNotNull() & (d != "") & d.try_cast("date").isNull()
    )
    head = [F.col(f"{parsed}.{n}").isNull() for n in ("cik", "entityType", "tickers", "exchanges")]
    missing = _blank(F.col(f"{parsed}.name"))
    for column in head:
        missing = missing | column
    return F.when(F.col(parsed).isNull() | missing | absent | uneven | bad_dates, "invalid_payload")


def parse(frame: DataFrame, schema: str) -> DataFrame:
    return frame.withColumn("p", F.from_json("body", schema))


def quarantine(submissions: DataFrame, companyfacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted companies with both parsed payloads, rejected companies with a reason).

    A company is rejected whole: invalid payload, CIK other than the requested one, or
    entity names that differ between the two sources.
    """
    left = parse(submissions, SUBMISSIONS).select(
        "cik", F.col("p").alias("s"), F.col("manifest_id").alias("s_manifest"),
        F.lit(True).alias("has_s"),
    ).withColumn("s_problem", submissions_problem("s"))
    right = parse(companyfacts, COMPANYFACTS).select(
        "cik", F.col("p").alias("f"), F.col("manifest_id").alias("f_manifest"), F.lit(True).alias("has_f"),
    ).withColumn("f_problem", companyfacts_problem("f"))
    both = left.join(right, "cik", "full_outer")
    same = lambda text: F.coalesce(ids.normalize_cik(text) == F.col("cik"), F.lit(False))
    judged = both.withColumn(
        "reason",
        F.when(F.col("has_s").isNull() | F.col("has_f").isNull(), "payload_missing")
        .when(F.col("s_problem").isNotNull() | F.col("f_problem").isNotNull(), "invalid_payload")
        .when(~same(F.col("s.cik")) | ~same(F.col("f.cik")), "cik_mismatch")
        .when(casefold(F.col("s.name")) != casefold(F.col("f.entityName")), "entity_mismatch"),
    )
    good = judged.where("reason IS NULL").select("cik", "s", "f", "s_manifest", "f_manifest")
    return good, judged.where("reason IS NOT NULL").select("cik", "reason")


# -------------------------------------------------------------------------------- tables
def read_companies(parsed: DataFrame, payload: str = "p") -> DataFrame:
    """Identity rows: tickers upper-cased, distinct and sorted; exchanges distinct and sorted."""
    return parsed.select(
        "cik", F.col(f"{payload}.name").alias("legal_name"),
        F.array_sort(F.array_distinct(F.transform(f"{payload}.tickers", F.upper))).alias("tickers"),
        F.array_sort(F.array_distinct(f"{payload}.exchanges")).alias("exchanges"),
        F.col(f"{payload}.sic").alias("sic"),
    )


def read_filings(parsed: DataFrame, payload: str = "p", manifest: str = "manifest_id") -> DataFrame:
    """One row per filing from the parallel arrays; blank report dates are null."""
    recent = [F.col(f"{payload}.filings.recent.{name}") for name in RECENT]
    rows = parsed.select("cik", F.col(manifest).alias("manifest_id"), F.explode(F.arrays_zip(*recent)).alias("r"))
    return rows.select(
        F.col("r.accessionNumber").alias("accession_number"), "cik", F.col("r.form").alias("form"),
        F.col("r.filingDate").cast("date").alias("filing_date"),
        F.nullif(F.col("r.reportDate"), F.lit("")).cast("date").alias("report_period"),
        F.col("r.primaryDocument").alias("primary_document"),
        F.col("r.form").endswith("/A").alias("is_amendment"), "manifest_id",
    )


def read_companyfacts(parsed: DataFrame, payload: str = "p", manifest: str = "manifest_id") -> DataFrame:
    """One row per observation whose value can be stored; ``unstorable_observations`` has the others.

    Four narrow explodes; there is no shuffle.  The id covers the value in full.
    Observations that agree in everything the id covers collapse in ``distinct_facts``.
    """
    flat = _flat_observations(parsed, payload, manifest).where("value IS NOT NULL")
    identifier = ids.fact_id(*[F.col(c) for c in (
        "cik", "taxonomy", "concept", "unit", "value_text", "start_date", "end_date", "accession_number")])
    return flat.withColumn("fact_id", identifier).drop("value_text")


def unstorable_observations(parsed: DataFrame, payload: str = "p", manifest: str = "manifest_id") -> DataFrame:
    """Observations whose value is out of the range of a fact, with a reason; the rest of their company is kept."""
    flat = _flat_observations(parsed, payload, manifest).where("value IS NULL")
    return flat.select("cik", "taxonomy", "concept", "unit", "accession_number", "value_text", F.lit("value_out_of_range").alias("reason"))


def _flat_observations(parsed: DataFrame, payload: str, manifest: str) -> DataFrame:
    level = parsed.select("cik", F.col(manifest).alias("manifest_id"), F.explode(f"{payload}.facts").alias("taxonomy", "concepts"))
    level = level.select("cik", "manifest_id", "taxonomy", F.explode("concepts").alias("concept", "c"))
    level = level.select("cik", "manifest_id", "taxonomy", "concept", F.col("c.label").alias("label"),
                         F.explode("c.units").alias("unit", "observations"))
    level = level.select("cik", "manifest_id", "taxonomy", "concept", "label", "unit",
                         F.explode("observations").alias("o"))
    money = F.col("o.val").try_cast(MONEY)
    # a value that money holds exactly is written one way; any other one as it came
    value_text = F.when(F.col("o.val").try_cast("decimal(38,18)") == money, money.cast("string")).otherwise(F.col("o.val"))
    return level.select(
        "cik", "taxonomy", "concept", "label", money.alias("value"), value_text.alias("value_text"), "unit",
        F.col("o.start").alias("start_date"), F.col("o.end").alias("end_date"), F.col("o.fy").alias("fiscal_year"),
        F.col("o.fp").alias("fiscal_period"), F.col("o.form").alias("form"), F.col("o.filed").alias("filed"),
        F.col("o.accn").alias("accession_number"), F.col("o.frame").alias("frame"),
        F.col("o.decimals").alias("decimals"), "manifest_id",
    )


def distinct_facts(raw: DataFrame) -> DataFrame:
    """One row per fact id; of colliding observations the latest filed is kept."""
    rest = [c for c in raw.columns if c != "fact_id"]
    order = F.struct("filed", "form", *[ids.text_or_empty(F.col(c)) for c in ("fiscal_year", "fiscal_period", "frame", "manifest_id")])
    return raw.groupBy("fact_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("fact_id", "r.*")


def read_directory(frame: DataFrame) -> DataFrame:
    """Ticker directory rows; a payload with any invalid row is rejected whole."""
    parsed = frame.withColumn("d", F.from_json("body", DIRECTORY))
    sound = F.forall(
        F.map_values("d"),
        lambda r: ids.normalize_cik(r["cik_str"]).isNotNull() & ~_blank(F.trim(r["ticker"])) & ~_blank(F.trim(r["title"])),
    )
    rows = parsed.where(F.col("d").isNotNull() & sound).select(F.explode(F.map_values("d")).alias("r"))
    return rows.select(
        ids.normalize_cik(F.col("r.cik_str")).alias("cik"),
        F.trim(F.upper("r.ticker")).alias("ticker"), F.trim("r.title").alias("legal_name"),
    )


def business_addresses(parsed: DataFrame, payload: str = "p") -> DataFrame:
    """Registered business address of each company."""
    business = f"{payload}.addresses.business"
    return parsed.where(F.col(business).isNotNull()).select(
        "cik", *[F.col(f"{business}.{c}").alias(a) for c, a in (
            ("street1", "street1"), ("street2", "street2"), ("city", "city"),
            ("stateOrCountry", "state_or_country"), ("zipCode", "zip_code"))],
    )


# ---------------------------------------------------------------------------------- urls
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def filing_document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(
        F.lit(ARCHIVE), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")),
        F.lit("/"), document,
    )


# Hosts that a source URL may name.
ALLOWED_HOSTS = ("data.sec.gov", "sec.gov", "www.sec.gov")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def canonical_url(url: Column, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    """Lower-case https host, normalised path, sorted query, no fragment; null if not allowed."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[^:]+://(?:[^/?@]*@)?([^/?:]*)", 1))
    rest = F.regexp_replace(bare, "^[^:]+://[^/?]*", "")
    path = F.regexp_extract(rest, "^([^?]*)", 1)
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    # '.' and empty segments vanish, '..' removes the segment before it
    kept = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    assigned = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    by_name = F.array_sort(F.transform(assigned, lambda p: F.struct(
        _decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))))
    ordered = F.transform(by_name, lambda s: F.concat_ws("=", F.url_encode(s["k"]), F.url_encode(s["v"])))
    text = F.concat(
        F.lit("https://"), host, F.lit("/"), F.array_join(kept, "/"),
        F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise(""),
    )
    return F.when((scheme == "https") & host.isin(*hosts), text)
