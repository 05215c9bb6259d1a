"""Inline relations for registries whose length is fixed in code."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_literal(v) for v in value)})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_frame(spark: SparkSession, rows: Iterable[Sequence[Any]], ddl: str) -> DataFrame:
    """``VALUES`` relation with an explicit schema (no Python worker, exact statistics)."""
    fields = T.StructType.fromDDL(ddl).fields
    names = ", ".join(f.name for f in fields)
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
    return raw.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def string_array(values: Iterable[str]) -> Column:
    """Array literal that keeps its element type when empty."""
    items = [F.lit(v) for v in values]
    return F.array(*items).cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
