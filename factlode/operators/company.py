"""Company lookup: directory search, identity resolution, geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlode.functions import ids
from factlode.functions.text import address_line, casefold
from factlode.registries import centroid_frame

# Labels of geographic evidence.
PRECISION = "administrative_area_centroid"
CONTEXT = "registered_business_address"
LIMITATION = (
    "Marker is the state centroid for orientation, not the office coordinate and not evidence of operating or "
    "revenue exposure."
)


def _text_tests(query: str) -> tuple[Column, Column, Column, str]:
    folded = query.strip().lower().replace("ß", "ss")
    ticker, name = casefold(F.col("ticker")), casefold(F.col("legal_name"))
    digits = query.strip() if query.strip().isdigit() and len(query.strip()) <= 10 else None
    same_cik = F.col("cik") == (digits.zfill(10) if digits else "")
    return same_cik, ticker, name, folded


def search_rank(query: str) -> Column:
    """0 CIK, 1 ticker, 2 name, 3 ticker prefix, 4 name prefix, 5 in ticker, 6 other."""
    same_cik, ticker, name, folded = _text_tests(query)
    return (
        F.when(same_cik, 0).when(ticker == folded, 1).when(name == folded, 2)
        .when(ticker.startswith(folded), 3).when(name.startswith(folded), 4)
        .when(ticker.contains(folded), 5).otherwise(6)
    )


def search_directory(directory: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Best ``limit`` directory rows (one scan, take-ordered; nothing is sorted whole)."""
    same_cik, ticker, name, folded = _text_tests(query)
    hits = directory.where(same_cik | ticker.contains(folded) | name.contains(folded))
    ranked = hits.select("cik", "ticker", "legal_name", search_rank(query).alias("match_rank"))
    return ranked.orderBy("match_rank", casefold(F.col("legal_name")), casefold(F.col("ticker")), "cik").limit(limit)


def search_companies(companies: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Local companies whose name or any ticker contains the text, or whose CIK equals it."""
    folded = query.strip().lower().replace("ß", "ss")
    digits = query.strip() if query.strip().isdigit() and len(query.strip()) <= 10 else None
    hit = casefold(F.col("legal_name")).contains(folded) | F.exists(
        "tickers", lambda t: casefold(t).contains(folded)
    )
    if digits:
        hit = hit | (F.col("cik") == digits.zfill(10))
    return companies.where(hit).select(
        "cik", F.coalesce(F.get("tickers", F.lit(0)), F.lit("—")).alias("ticker"), "legal_name",
        F.lit(True).alias("locally_available"),
    ).orderBy("cik").limit(limit)


def mark_available(entries: DataFrame, companies: DataFrame) -> DataFrame:
    """Directory entries with a flag for companies that are held locally."""
    held = companies.select("cik").distinct().withColumn("held", F.lit(True))
    return entries.join(held, "cik", "left").withColumn(
        "locally_available", F.coalesce("held", F.lit(False))
    ).drop("held")


def resolve_identities(companies: DataFrame, queries: DataFrame, text: str = "identifier") -> DataFrame:
    """Resolve each query by CIK, else ticker, else legal name.

    Every tier is first reduced to one row per lookup key (count and one CIK), so that a
    name shared by many companies joins as a single row.  Status is ``resolved``,
    ``ambiguous`` or ``not_found``.
    """
    stripped = F.trim(F.col(text))
    is_cik = F.upper(stripped).startswith("CIK") | stripped.rlike("^[0-9]+$")
    probed = queries.withColumns({
        "by_cik": F.when(is_cik, ids.normalize_cik(stripped)),
        "by_text": F.when(~is_cik, casefold(stripped)),
    })

    def tier(keys: DataFrame, key: str, prefix: str) -> DataFrame:
        return keys.groupBy(key).agg(
            F.count(F.lit(1)).alias(f"{prefix}_count"), F.min("cik").alias(f"{prefix}_first")
        )

    exact = tier(companies.select("cik", F.col("cik").alias("by_cik")), "by_cik", "cik")
    tickers = companies.select(
        "cik", F.explode(F.array_distinct(F.transform("tickers", casefold))).alias("by_text")
    )
    names = companies.select("cik", casefold(F.col("legal_name")).alias("by_text"))
    joined = (
        probed.join(exact, "by_cik", "left")
        .join(tier(tickers, "by_text", "ticker"), "by_text", "left")
        .join(tier(names, "by_text", "name"), "by_text", "left")
    )
    count = F.coalesce("cik_count", "ticker_count", "name_count", F.lit(0).cast("bigint"))
    first = F.coalesce("cik_first", "ticker_first", "name_first")
    return joined.select(
        *queries.columns, count.alias("match_count"),
        F.when(count == 1, "resolved").when(count == 0, "not_found").otherwise("ambiguous").alias("resolution"),
        F.when(count == 1, first).alias("cik"),
    )


def geographic_evidence(addresses: DataFrame) -> DataFrame:
    """Registered address of each company at its state's centroid; unknown states give no row.

    ``addresses`` has cik, street1, street2, city, state, zip_code, source_url and
    source_sha256.  The centroid table is fixed at 51 rows.
    """
    located = addresses.withColumn("state", F.upper(F.coalesce("state_or_country", F.lit("")))).join(
        F.broadcast(centroid_frame(addresses.sparkSession)), "state"
    )
    line = address_line(*[F.col(c) for c in ("street1", "street2", "city", "state_or_country", "zip_code")])
    city = F.nullif(F.trim(F.coalesce("city", F.lit(""))), F.lit(""))
    return located.withColumn("address", line).select(
        "cik",
        ids.stable_id(F.col("source_sha256"), "business", F.col("address")).alias("geographic_evidence_id"),
        F.concat(F.lit("Registered business address · "), F.coalesce(city, "state")).alias("label"),
        "latitude", "longitude", F.lit(PRECISION).alias("precision"), F.lit(CONTEXT).alias("context"), "address",
        "source_url", "source_sha256", F.lit(LIMITATION).alias("limitation"),
    )
