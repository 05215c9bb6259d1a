import json

import pytest

from factlode.sources.payloads import quarantine


def _bodies(cik, name, entity):
    recent = {c: [] for c in ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")}
    submissions = {"cik": cik, "entityType": "operating", "name": name, "tickers": [], "exchanges": [], "filings": {"recent": recent}}
    return json.dumps(submissions), json.dumps({"cik": cik, "entityName": entity, "facts": {}})


@pytest.fixture
def judged(spark):
    names = {"0000000001": ("STRASSE AG", "Straße ag"), "0000000002": ("ΟΔΟΣ SA", "οδος sa"), "0000000003": ("Alpha Inc", "Beta Inc"), "0000000004": ("", "x")}
    bodies = {cik: _bodies(cik, *both) for cik, both in names.items()}
    frames = [spark.createDataFrame([(cik, b[k], f"m{k}") for cik, b in bodies.items()], "cik string, body string, manifest_id string") for k in (0, 1)]
    only = spark.createDataFrame([("0000000005", bodies["0000000001"][0], "m0")], frames[0].schema)
    return quarantine(frames[0].unionAll(only), frames[1])


def test_names_are_compared_case_folded(judged):
    good, bad = judged
    assert {r.cik for r in good.collect()} == {"0000000001", "0000000002"}
    assert {r.cik: r.reason for r in bad.collect()} == {"0000000003": "entity_mismatch", "0000000004": "invalid_payload", "0000000005": "payload_missing"}
