import hashlib
import random
import re

import pytest

from factlode.llm.pii import find_pii, mask_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def ok(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if ok(name, m[0])]
    return [f"{name}:{start}:{end}" for start, _, end, name in sorted(found)]


FIXED = [
    None, "", "no data", "a@b.c_x@d.e and me.you+1@mail.example.com.", "1.2.3.4.5 256.1.1.1 001.002.003.0255 9.9.9.9",
    "4111 1111 1111 1111 then 4111-1111-1111-1112, 5500005555555559", "+1 (702) 555-0742, +12 34, +1+1+49 30 1234567)",
    "IBAN DE89370400440532013000 x GB82WEST12345698765432 DE89370400440532013001", "my ssn 123-45-6789 ok" + " " * 60 + "123-45-6789",
    "\U0001f600 x@y.zz \U0001f600 8.8.8.8", "1" * 30_000, "a" * 30_000 + "@", "1 " * 5_000, "x@y.zz " * 700, "+" + "1 " * 2_000,
]


def texts():
    rng = random.Random(5)
    parts = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 702 555 0742", "@", ".", " ", "-", "+", "7", "é", "x_", "(", "\n", "999.1.1.1", "\U0001f600"]
    return FIXED + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.cc"), (0, None)]
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for row, (doc, text) in zip(got, rows):
        want = brute(text or "")
        base = [s for s in row.spans.split(",") if s and s.split(":")[0] in PLAIN]
        assert base == want, text
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]


def test_checksums_and_context_decide_on_added_kinds(spark):
    frame = spark.createDataFrame(list(enumerate(FIXED)), "doc_id long, text string")
    got = {r.doc_id: r for r in find_pii(frame).collect()}
    iban = FIXED[7]
    assert [s for s in got[7].spans.split(",") if s.startswith("iban")] == [f"iban:{iban.index('DE')}:{iban.index('DE') + 22}", f"iban:{iban.index('GB')}:{iban.index('GB') + 22}"]
    assert got[8].spans == "ssn:7:18" and got[8].n_ssn == 1 and got[8].max_score == pytest.approx(0.6)
    assert got[1].spans == "" and got[1].max_score is None


def test_mask_hides_every_span(spark):
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts())], "doc_id long, text string, matches string")
    masked = mask_pii(frame)
    assert masked.columns == frame.columns
    rows = {r.doc_id: r.text for r in masked.collect()}
    assert rows[0] is None and rows[1] == "" and rows[2] == "no data"
    assert rows[3] == "[EMAIL][EMAIL] and [EMAIL]." and rows[8].startswith("my ssn [SSN] ok") and rows[8].endswith("123-45-6789")
    assert rows[5] == "[CARD] then 4111-1111-1111-1112, [CARD]"


WHOLE = {
    "SSNs: 123-45-6789, 234-56-7890, 345-67-8901": "SSNs: [SSN], [SSN], [SSN]",
    "SSN issued 2024-01-02: 123-45-6789": "SSN issued 2024-01-02: [SSN]",
    "1-2-3 123-45-6789 1-2-3 4-5-6 7-8-9 (ssn)": "1-2-3 [SSN] 1-2-3 4-5-6 7-8-9 (ssn)",
    "ssn" + "x" * 36 + " 123-45-6789": "ssn" + "x" * 36 + " [SSN]",
    "ssn" + "x" * 37 + " 123-45-6789": "ssn" + "x" * 37 + " 123-45-6789",
    "ssn@x.org \u00e9: 123-45-6789": "[EMAIL] \u00e9: [SSN]",
    "pay DE89 3704 0044 0532 0130 00 NOW OR 12": "pay [IBAN] NOW OR 12",
    "AT61 1904 3002 3457 3201 GB82 WEST 1234 5698 7654 32 x": "[IBAN] [IBAN] x",
    "DE89370400440532013000 AND GB82 WEST12345698765432, ok": "[IBAN] AND [IBAN], ok",
    "DE89 3704 0044 0532 0130 01 no": "DE89 3704 0044 0532 0130 01 no",
}


def test_context_and_printed_accounts_are_whole(spark):
    frame = spark.createDataFrame(list(enumerate(WHOLE)), "doc_id long, text string")
    masked = {r.doc_id: r.text for r in mask_pii(frame).collect()}
    for row in find_pii(frame).collect():
        text, want = list(WHOLE.items())[row.doc_id]
        assert masked[row.doc_id] == want
        assert (row.n_ssn, row.n_iban) == (want.count("[SSN]"), want.count("[IBAN]")), text
        for span in row.spans.split(","):
            kind, a, b = span.split(":") if span else ("", 0, 0)
            found = text[int(a) : int(b)]
            assert kind != "iban" or found.replace(" ", "") in ("DE89370400440532013000", "AT611904300234573201", "GB82WEST12345698765432")
            assert kind != "ssn" or re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", found)


def test_empty_table_and_extra_columns(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, n_email string, spans int")
    assert find_pii(frame).collect() == []
    assert mask_pii(frame).collect() == []
