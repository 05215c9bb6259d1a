"""Stable content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def text_or_empty(column: Column) -> Column:
    """``concat_ws`` drops nulls, which would change an id, so nulls become ''."""
    return F.coalesce(column.cast("string"), F.lit(""))


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 over the parts joined with ``|``; plain strings are literals."""
    columns = [F.lit(p) if isinstance(p, str) else text_or_empty(p) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *columns), 256)


def fact_id(
    cik: Column, taxonomy: Column, concept: Column, unit: Column, value: Column,
    start_date: Column, end_date: Column, accession: Column,
) -> Column:
    return stable_id(cik, taxonomy, concept, unit, value, start_date, end_date, accession)


def id_parts(identifier: Column) -> list[Column]:
    """The four 64-bit parts of a hex id."""
    return [F.conv(F.substring(identifier, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]


def id_digest(identifier: Column) -> Column:
    """Order-free digest of a set of hex ids: the sums of their four 64-bit parts.

    A sum merges map-side, so a group of any size is identified without collecting it.
    """
    return F.concat_ws(":", *[F.sum(part).cast("decimal(38,0)").cast("string") for part in id_parts(identifier)])


def id_set_text(count: Column, low: Column, high: Column, digest: Column) -> Column:
    """Text naming an id set of any size: its bounds, its size and its digest."""
    return F.concat_ws(SEPARATOR, low, high, count.cast("string"), digest)


def normalize_cik(value: Column) -> Column:
    """Ten-digit CIK text, or null where the input is not a CIK."""
    bare = F.regexp_replace(F.trim(value.cast("string")), "^(?i)CIK", "")
    return F.when(bare.rlike("^[0-9]{1,10}$"), F.lpad(bare, 10, "0"))
