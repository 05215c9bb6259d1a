"""Peer comparison inside a SIC code, for all companies, metrics and dates at once.

A company's peers are the members of its cohort (SIC, metric, end date) whose assets lie
between two multiples of its own.  In the order of assets they are a contiguous range, so
no pairs are formed: quartiles and percentile are order statistics of ranges, answered for
all targets of a cohort together in O(n log n).  Cohorts are cut into size bands, each
holding only the members that one of its targets can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlode.functions.numbers import METRIC, MONEY
from factlode.functions.periods import order_date

# Reasons of a peer position.
NO_POLICY = "Peer size and quality policy is not configured"
NO_TARGET = "Target SIC or metric value is unavailable"
NO_ASSETS = "Target assets are unavailable for size filtering"
FILTERS_APPLIED = "SIC, confidence, and asset-size filters were explicitly applied."
QUARTILES = (0.25, 0.5, 0.75)
COHORT = ["sic", "metric_id", "end_date"]


@dataclass(frozen=True)
class PeerPolicy:
    min_peers: int
    min_confidence: Decimal
    min_asset_ratio: Decimal
    max_asset_ratio: Decimal


def aligned_results(companies: DataFrame, results: DataFrame) -> DataFrame:
    """The first computed result per company, metric and end date, with SIC and assets."""
    return _sized_results(results).join(companies.select("cik", "sic"), "cik")


def _sized_results(results: DataFrame) -> DataFrame:
    """The first computed result per company, metric and end date, with the company's assets of that date.

    First means smallest (start or end, id); the pick combines on the map side.
    """
    computed = results.where((F.col("status") == "computed") & F.col("value").isNotNull())
    first = F.min(F.struct(
        order_date(F.col("start_date"), F.col("end_date")).alias("o"), F.col("metric_result_id").alias("id"),
        "value", "data_confidence",
    ))
    picked = computed.groupBy("cik", "metric_id", "end_date").agg(first.alias("r")).select(
        "cik", "metric_id", "end_date", F.col("r.id").alias("metric_result_id"), F.col("r.value").alias("value"),
        F.coalesce("r.data_confidence", F.lit(0)).alias("confidence"),
    )
    # the assets of a date are among its picked rows
    of_date = F.max(F.when(F.col("metric_id") == "assets", F.col("value"))).over(Window.partitionBy("cik", "end_date"))
    return picked.withColumn("assets", F.when(F.col("end_date").isNotNull(), of_date).cast(MONEY))


# --------------------------------------------------------------- order statistics of ranges
def _descend(ranks: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Levels of a wavelet matrix: yields (bit, zeros before low, zeros before high, all zeros)."""
    current, bits = ranks, max(1, int(len(ranks) - 1).bit_length())
    for bit in reversed(range(bits)):
        ones = ((current >> bit) & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~ones)))
        yield bit, zeros
        current = np.concatenate((current[~ones], current[ones]))


def kth_smallest(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of ``ranks[low:high]`` for many queries at once."""
    low, high, k, found = low.copy(), high.copy(), k.copy(), np.zeros_like(k)
    for bit, zeros in _descend(ranks, low, high):
        zl, zh = zeros[low], zeros[high]
        right = k >= zh - zl
        found |= right.astype(found.dtype) << bit
        k = np.where(right, k - (zh - zl), k)
        low = np.where(right, zeros[-1] + low - zl, zl)
        high = np.where(right, zeros[-1] + high - zh, zh)
    return found


def count_below(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of ``ranks[low:high]`` are smaller than ``bound``, for many queries at once."""
    low, high, count = low.copy(), high.copy(), np.zeros_like(low)
    everything = bound >= len(ranks)
    target = np.where(everything, 0, bound)
    width = high - low
    for bit, zeros in _descend(ranks, low, high):
        zl, zh = zeros[low], zeros[high]
        right = (target >> bit) & 1 == 1
        count += np.where(right, zh - zl, 0)
        low = np.where(right, zeros[-1] + low - zl, zl)
        high = np.where(right, zeros[-1] + high - zh, zh)
    return np.where(everything, width, count)


_STATISTICS = (
    "cik string, metric_id string, end_date date, peer_count long, first_quartile double, median double, "
    "third_quartile double, percentile double"
)


def _positions(groups: np.ndarray, keys: np.ndarray, at_groups: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """How many (group, key) pairs lie below each (group, at) pair, equal ones included or not."""
    tie = np.concatenate((np.zeros(len(keys)), np.full(len(at), -1 if before else 1)))
    all_groups, all_keys = np.concatenate((groups, at_groups)), np.concatenate((keys, at))
    order = np.lexsort((tie, all_keys, all_groups))
    is_key = order < len(keys)
    place = np.empty(len(order), "int64")
    place[order] = np.cumsum(is_key)
    return place[len(keys):]


def _cohort_statistics(rows: pd.DataFrame) -> pd.DataFrame:
    """Statistics of every target of some whole cohorts, all cohorts at once.

    Members are laid out by (cohort, assets) and ranked by (cohort, value), so a range of
    one cohort is a range of the whole and its order statistics are the cohort's own.
    """
    cohort = rows.groupby(_KEYS, sort=False).ngroup().to_numpy()
    member, target = rows["is_member"].to_numpy(bool), rows["is_target"].to_numpy(bool)
    columns = {c: rows[c].to_numpy() for c in ("cik", "assets", "value", "low", "high")}
    order = np.lexsort((columns["cik"][member].astype(str), columns["assets"][member], cohort[member]))
    groups, assets = cohort[member][order], columns["assets"][member][order].astype("int64")
    values, n = columns["value"][member][order].astype("float64"), int(member.sum())
    targets, at = rows[target], cohort[target]
    own = columns["value"][target].astype("float64")
    low = _positions(groups, assets, at, columns["low"][target].astype("int64"), True)
    high = np.maximum(low, _positions(groups, assets, at, columns["high"][target].astype("int64"), False))
    # the target itself is a member of its range where its own size ratio of 1 is allowed
    self_place = np.full(len(rows), -1, "int64")
    self_place[np.flatnonzero(member)[order]] = np.arange(n)
    self_at = self_place[target]
    within = (self_at >= low) & (self_at < high)
    count = high - low - within
    out = {
        "cik": targets["cik"].to_numpy(), "metric_id": targets["metric_id"].to_numpy(),
        "end_date": targets["end_date"].to_numpy(), "peer_count": count,
    }
    names = ("first_quartile", "median", "third_quartile")
    if n == 0:
        return pd.DataFrame({**out, **{m: np.nan for m in names}, "percentile": np.nan})
    order = np.lexsort((values, groups))
    ascending, ranks = values[order], np.empty(n, "int64")
    ranks[order] = np.arange(n)
    self_rank = np.where(within, ranks[np.maximum(self_at, 0)], n)
    ahead = count_below(ranks, low, high, self_rank)
    for name, q in zip(names, QUARTILES):
        position = q * np.maximum(count - 1, 0)
        floor = np.floor(position).astype("int64")
        edges = []
        for k in (floor, np.minimum(floor + 1, np.maximum(count - 1, 0))):
            shifted = k + (within & (k >= ahead))
            usable = np.minimum(shifted, np.maximum(high - low - 1, 0))
            edges.append(ascending[np.minimum(kth_smallest(ranks, low, high, usable), n - 1)])
        weight = position - floor
        out[name] = np.where(count > 0, edges[0] * (1 - weight) + edges[1] * weight, np.nan)
    not_above = _positions(groups[order], ascending, at, own, False)
    below = count_below(ranks, low, high, not_above) - within
    out["percentile"] = np.where(count > 0, below / np.maximum(count, 1), np.nan)
    return pd.DataFrame(out)


_KEYS = [*COHORT, "band"]
_BATCH_ROWS = 100_000


def _stream_cohorts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cohorts arrive sorted; whole ones are evaluated together, an unfinished one waits."""
    waiting: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size < _BATCH_ROWS:
            continue
        rows = pd.concat(waiting, ignore_index=True)
        unfinished = (rows[_KEYS] == rows[_KEYS].iloc[-1]).all(axis=1)
        if not unfinished.all():
            yield _cohort_statistics(rows[~unfinished].reset_index(drop=True))
        waiting = [rows[unfinished]]
        size = len(waiting[0])
    if size:
        yield _cohort_statistics(pd.concat(waiting, ignore_index=True))


# --------------------------------------------------------------------------------- bands
def _bands(policy: PeerPolicy) -> tuple[Column, Column]:
    """(band of a target, bands a member must be present in), from the logarithm of assets."""
    low, high = float(policy.min_asset_ratio), float(policy.max_asset_ratio)
    if low <= 0 or high <= low:
        return F.lit("all"), F.array(F.lit("all"))
    width = math.log(high / low)
    place = F.log(F.abs(F.col("assets").cast("double"))) / width
    sign = F.when(F.col("assets") < 0, "n").otherwise("p")
    name = lambda number: F.concat(sign, number.cast("string"))
    first = F.floor(place - math.log(high) / width - 1e-9)
    last = F.floor(place - math.log(low) / width + 1e-9)
    return name(F.floor(place)), F.transform(F.sequence(first, last), name)


def peer_statistics(aligned: DataFrame, policy: PeerPolicy) -> DataFrame:
    """Count, quartiles and percentile of the peers of every usable target."""
    # a company without assets is no target, but a peer where the lower ratio is 0
    sized = (F.col("assets") != 0) | F.lit(float(policy.min_asset_ratio) <= 0)
    usable = aligned.where(F.col("sic").isNotNull() & (F.col("sic") != "") & F.col("assets").isNotNull() & sized)
    # assets have four decimals, so these are whole; what a peer may have follows from them and doesn't travel
    units = (F.col("assets") * 10000).cast("decimal(38,8)").cast("bigint")
    ends = [F.col("assets").cast("decimal(20,0)") * F.lit(r).cast("decimal(10,4)") for r in (policy.min_asset_ratio, policy.max_asset_ratio)]
    home, reach = _bands(policy)
    rows = usable.select(
        *COHORT, "cik", F.col("value").cast("double").alias("value"), "confidence",
        units.alias("assets_units"), "assets", home.alias("home"), reach.alias("reach"),
    )
    placed = rows.withColumn("band", F.explode(F.array_distinct(F.concat("reach", F.array("home")))))
    tagged = placed.select(
        *COHORT, "band", "cik", "value", F.col("assets_units").alias("assets"),
        ((F.col("band") == F.col("home")) & (F.col("assets_units") != 0)).alias("is_target"),
        ((F.col("confidence") >= F.lit(policy.min_confidence)) & F.array_contains("reach", F.col("band"))).alias("is_member"),
    )
    dealt = tagged.repartition(*_KEYS).sortWithinPartitions(*_KEYS).withColumns({
        "low": F.ceil(F.least(*ends)).cast("bigint"), "high": F.floor(F.greatest(*ends)).cast("bigint")})
    return dealt.mapInPandas(_stream_cohorts, _STATISTICS)


def peer_context(companies: DataFrame, results: DataFrame, policy: PeerPolicy | None) -> DataFrame:
    """Peer position of every company's result; the reason says why one is not computable."""
    aligned = aligned_results(companies, results)
    base = aligned.select("cik", "sic", "metric_id", "end_date", "metric_result_id", "value", "assets")
    if policy is None:
        empty = [F.lit(None).cast("double").alias(c) for c in ("first_quartile", "median", "third_quartile", "percentile")]
        joined = base.select("*", F.lit(0).cast("bigint").alias("peer_count"), *empty)
        reason = F.lit(NO_POLICY)
        computed = F.lit(False)
    else:
        joined = base.join(peer_statistics(aligned, policy), ["cik", "metric_id", "end_date"], "left")
        joined = joined.fillna(0, ["peer_count"])
        computed = F.col("peer_count") >= policy.min_peers
        no_assets = F.col("assets").isNull() | (F.col("assets") == 0)
        no_target = F.col("sic").isNull() | (F.col("sic") == "") | F.col("value").isNull()
        computed = computed & ~no_assets & ~no_target
        reason = (
            F.when(no_target, NO_TARGET).when(no_assets, NO_ASSETS).when(computed, FILTERS_APPLIED)
            .otherwise(F.concat(F.lit("Only "), F.col("peer_count").cast("string"),
                                F.lit(" coherent SIC peers passed the explicit filters")))
        )
    shown = lambda column: F.when(computed, F.col(column))
    low, high = (None, None) if policy is None else (policy.min_asset_ratio, policy.max_asset_ratio)
    bound = lambda ratio: (F.col("assets") * F.lit(ratio).cast("decimal(10,4)")).cast(MONEY)
    return joined.select(
        "cik", "metric_id", "end_date", "metric_result_id",
        F.when(computed, "computed").otherwise("not_computable").alias("status"),
        F.col("value").cast(METRIC).alias("company_value"),
        shown("median").alias("peer_median"), shown("first_quartile").alias("peer_first_quartile"),
        shown("third_quartile").alias("peer_third_quartile"), shown("percentile").alias("percentile"),
        "peer_count",
        # the peers themselves are the cohort members between these two sizes
        (bound(low) if policy else F.lit(None).cast(MONEY)).alias("peer_assets_from"),
        (bound(high) if policy else F.lit(None).cast(MONEY)).alias("peer_assets_to"),
        reason.alias("reason"),
    )


def peer_members(companies: DataFrame, results: DataFrame, targets: DataFrame, policy: PeerPolicy) -> DataFrame:
    """Peers of chosen targets (cik, metric_id, end_date) as rows, one per peer of each target."""
    aligned = aligned_results(companies, results)
    chosen = aligned.join(targets.select("cik", "metric_id", "end_date").distinct(), ["cik", "metric_id", "end_date"], "left_semi")
    wanted = chosen.where("assets <> 0").select(*COHORT, F.col("cik").alias("target_cik"), F.col("assets").alias("target_assets"))
    ratio = F.col("assets") / F.col("target_assets")
    return (
        aligned.where((F.col("confidence") >= F.lit(policy.min_confidence)) & F.col("assets").isNotNull())
        .join(wanted, COHORT).where((F.col("cik") != F.col("target_cik")) &
                                    ratio.between(F.lit(policy.min_asset_ratio), F.lit(policy.max_asset_ratio)))
        .select("target_cik", "metric_id", "end_date", F.col("cik").alias("peer_cik"), "value", "assets")
    )
