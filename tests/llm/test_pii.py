from __future__ import annotations

import hashlib
import re

from orderlens.llm import pii

from .conftest import ODD

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
TEXTS = [
    "a@b@c.d x@y.z@w.v a@b.c_d@e.f é a.b@c..d", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1 9.9.9.9x",
    "4111 1111 1111 1111 4111-1111-1111-1111-4 4111111111111112", "call +1 (743) 555-3824 +++1 234 567 8901)) +49(0)30 1234567.",
    "😀 a@b.co 😀😀 4111111111111111", " ".join(["x@y.zz 😀 10.0.0.1"] * 300), "+1" + "(" * 5000, "1" * 50_000, "a.b%" * 20_000,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 10 <= len(digits) <= 15
            )
            if ok:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")


def test_base_spans(spark):
    texts = TEXTS + [t for _, t in ODD]
    rows = {r.doc_id: r for r in pii.digest(pii.find_pii(frame(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:80]
        assert rows[i].n_email == sum(x.startswith("email") for x in want)
        base = [s for s in rows[i].spans.split(",") if s.split(":")[0] in dict(PLAIN)]
        assert base == want


def test_added_kinds_and_context(spark):
    texts = [
        "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000", "GB82WEST12345698765433",
        "my ssn 123-45-6789", "number 123-45-6789", "ssn 000-12-1234",
    ]
    rows = {r.doc_id: r for r in pii.digest(pii.find_pii(frame(spark, texts))).collect()}
    assert [rows[i].spans for i in range(5)] == ["iban:5:32,iban:34:56", "", "ssn:7:18", "", ""]
    assert rows[0].scores == [1.0, 0.9]
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_numbers_in_a_row_and_words_behind_an_account(spark):
    texts = [
        "SSN: 123-45-6789, 234-56-7890", "ssn 123-45-6789 234-56-7890 345-67-8901 456-78-9012 567-89-0123",
        "GB82 WEST 1234 5698 7654 32 BIC WESTGB22", "DE89370400440532013000 2024 x", "GB82 WEST 1234 5698 7654 32 A",
    ]
    rows = {r.doc_id: r for r in pii.digest(pii.find_pii(frame(spark, texts))).collect()}
    kinds = [[s for s in rows[i].spans.split(",") if s[:4] in ("ssn:", "iban")] for i in range(5)]
    assert kinds[0] == ["ssn:5:16", "ssn:18:29"]
    assert kinds[1] == ["ssn:4:15", "ssn:16:27", "ssn:28:39", "ssn:40:51"]
    assert kinds[2:] == [["iban:0:27"], ["iban:0:22"], ["iban:0:27"]]


def test_masking(spark):
    found = pii.find_pii(frame(spark, ["mail a@b.co or 10.0.0.1 now", "clean", None]))
    assert [r.text for r in pii.masked(found).orderBy("doc_id").collect()] == ["mail [email] or [ip] now", "clean", ""]


def test_empty_table_and_native_plan(nothing):
    found = pii.digest(pii.find_pii(nothing))
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
