"""Spans against a plain Python scan with the unchanged patterns."""

import random
import re
import time

from pyspark.sql import functions as F

from grainloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


FIXED = [
    None, "", " ", "a@b.c", "a@b.c_d@e.f", "x..y@-.-.- z@q", "é a.b+c@d-e.fr é\U0001f600 1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1 0255.0.0.1 00000000000000000255.1.1.1", "1.2.3", "1.2.3.4.",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "41111111111111111111", "5500000000000004 4111111111111111", "+1 (555) 123-4567 call", "+49.30.123456-", "++1 2345678", "+1+2 34567890 (", "+123", "1" * 3000, "1-" * 5000 + "1", "a" * 5000,
    "a@" * 3000, "a@" + "b." * 9000 + "c", "1." * 5000, "+1" + " " * 5000, "+1" + "2" * 5000, "x" * 3000 + "@y.zz",
]


def test_against_plain_scan(spark):
    r = random.Random(3)
    bits = ["a@b.com", "@", ".", "1.2.3.4", "999.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+1", " 555", "-", "(0)", "7" * 9, "é", " ", "x_y", "\U0001f600", "\n", "%", "00"]
    texts = FIXED + ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = pii.find_personal(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    for row in found.collect():
        got = [(s.kind, s.start, s.end) for s in row.spans if s.kind in BASE]
        assert got == plain(texts[row.doc_id] or ""), texts[row.doc_id]
    assert pii.find_personal(df.limit(0)).count() == 0


def test_iban_score_and_redaction(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "GB82WEST12345698765433", "mail é@b a@b.cc, +1 415 555 0100!", "4111 1111 1111 1111@x.yz", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal(df).join(df, "doc_id").withColumn("out", pii.redacted("text", "spans")).collect()}
    assert [(s.kind, s.start, s.end, round(s.score, 3)) for s in rows[0].spans] == [("iban", 5, 32, 1.0)]
    assert rows[0].out == "iban [IBAN] ok"
    assert rows[1].spans == [] and rows[1].out == texts[1]
    assert rows[2].out == "mail é@b [EMAIL], [PHONE]!"
    assert rows[3].out == "[CARD]"
    assert rows[4].out == "nothing"


def test_context_decides(spark):
    texts = {
        "DE89370400440532013000 AND more": [("iban", 0.8)], "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": [("iban", 1.0)], "DE89 3704 0044 0532 0130 01": [], "ZZ89370400440532013000": [],
        "call 415-555-0100": [("national", 0.6)], "part 415-555-0100, call": [], "415-555-0100": [], "SSN: 123-45-6789": [("ssn", 0.6)], "123-45-6789": [],
        "version 1.2.3.4": [("ip", 0.3)], "host 1.2.3.4": [("ip", 0.8)], "call " + "x" * 60 + " 415-555-0100": [], "call 415-555-0100 415-555-0101": [("national", 0.6)],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_personal(df).join(df, "doc_id").withColumn("out", pii.redacted("text", "spans")).collect()
    for r in rows:
        assert [(s.kind, s.score) for s in r.spans] == texts[r.text], r.text
        assert ("[" in r.out) == any(s.score >= 0.5 for s in r.spans), r.text


def test_dense_long_text(spark):
    bit = "mail é.b@c.de ip 1.2.3.4 or +4930123456 and 4111 1111 1111 1111;\n"
    n = 2_000_000 // len(bit)
    df = spark.createDataFrame([(1, bit * n), (2, "x" * 3_000_000), (3, "")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in df.select("doc_id", pii.redacted("text", pii.spans_of("text")).alias("out")).collect()}
    assert got[1].out == "mail é[EMAIL] ip [IP] or [PHONE] and [CARD];\n" * n
    assert got[2].out == "x" * 3_000_000 and got[3].out == ""
    assert time.time() - began < 60


def test_ibans_of_all_registered_countries(spark):
    def iban(country):
        body = "".join(str(i % 10) for i in range(pii.IBAN_LENGTHS[country] - 4))
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{98 - rest:02d}{body}"

    said = {c: iban(c) for c in pii.IBAN_LENGTHS} | {"given": "OM810180000001299123456"}
    rows = spark.createDataFrame([(k, f"account {v} of") for k, v in said.items()], "doc_id string, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.find_personal(rows).collect()}
    assert got == {k: [("iban", 8, 8 + len(v))] for k, v in said.items()}
    assert {"OM", "BI", "DJ", "FK", "HN", "MN", "NI", "RU", "SO", "YE"} <= pii.IBAN_LENGTHS.keys()
