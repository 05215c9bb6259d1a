from datetime import date
from decimal import Decimal

import numpy as np

from pyspark.sql import functions as F

from factlode.operators import peers
from factlode.operators.metrics import RESULT_COLUMNS

POLICY = peers.PeerPolicy(3, Decimal("0.8"), Decimal("0.5"), Decimal("2"))


def results(spark, rows):
    frame = spark.createDataFrame(rows, "cik string, metric_id string, value decimal(35,15), confidence decimal(5,4)")
    known = {
        "metric_result_id": F.concat_ws("-", "cik", "metric_id"), "status": F.lit("computed"), "end_date": F.lit(date(2025, 12, 31)),
        "data_confidence": F.col("confidence"),
    }
    return frame.withColumns(known).withColumns({
        c: F.lit(None).cast("date" if c.endswith("date") else "string")
        for c in RESULT_COLUMNS if c not in known and c not in frame.columns
    })


def companies(spark, ciks):
    return spark.createDataFrame([(c, "1") for c in ciks], "cik string, sic string")


def cohort(spark, values):
    rows = []
    for cik, (value, assets) in values.items():
        rows += [(cik, "net_margin", Decimal(value), Decimal("1")), (cik, "assets", Decimal(assets), Decimal("1"))]
    return companies(spark, values), results(spark, rows)


def test_hand_computed_peers(spark):
    firms, found = cohort(spark, {"t": ("0.4", "100"), "a": ("0.3", "80"), "b": ("0.5", "120"), "c": ("0.6", "150"), "d": ("9", "900")})
    row = peers.peer_context(firms, found, POLICY).where("cik = 't' AND metric_id = 'net_margin'").first()
    assert (row.status, row.peer_median, row.peer_count) == ("computed", 0.5, 3)
    assert abs(row.percentile - 1 / 3) < 1e-12
    far = peers.peer_context(firms, found, POLICY).where("cik = 'd' AND metric_id = 'net_margin'").first()
    assert far.reason == "Only 0 coherent SIC peers passed the explicit filters"
    none = peers.peer_context(firms, found, None).where("cik = 't'").first()
    assert (none.status, none.reason) == ("not_computable", peers.NO_POLICY)
    members = peers.peer_members(firms, found, found.where("cik = 't'"), POLICY).where("metric_id = 'net_margin'")
    assert sorted(r.peer_cik for r in members.collect()) == ["a", "b", "c"]


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    data = {f"{i:03d}": (str(round(rng.normal(), 2)), str(int(rng.integers(1, 60)) * (-1 if i % 11 == 0 else 1))) for i in range(150)}
    firms, found = cohort(spark, data)
    policy = peers.PeerPolicy(1, Decimal("0.8"), Decimal("0.5"), Decimal("2"))
    got = {r.cik: r for r in peers.peer_context(firms, found, policy).where("metric_id = 'net_margin'").collect()}
    for cik, (value, assets) in data.items():
        around = [float(v) for c, (v, a) in data.items() if c != cik and 0.5 <= int(a) / int(assets) <= 2]
        row = got[cik]
        assert row.peer_count == len(around)
        if around:
            want = np.quantile(around, [0.25, 0.5, 0.75])
            assert np.allclose([row.peer_first_quartile, row.peer_median, row.peer_third_quartile], want)
            assert abs(row.percentile - np.mean([v <= float(value) for v in around])) < 1e-12
