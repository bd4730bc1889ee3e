from __future__ import annotations

import hashlib
import random
from datetime import datetime

from pyspark.sql import functions as F

from orderlens.constants import COMPLAINT_KEYWORDS, SPAM_KEYWORDS
from orderlens.functions import ids, numbers, text, time


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_id(spark):
    given = ["  ABC ", "  def  123 ", None, "\t x \n", " nan ", "None", "<NA>", "NAN", ""]
    assert column(spark, given, ids.clean_id) == [
        "ABC", "def  123", None, "x", None, None, None, "NAN", None,
    ]


def test_hash_key(spark):
    df = spark.createDataFrame([("a", None, datetime(2023, 6, 1))], "a string, b string, t timestamp")
    got = df.select(
        ids.hash_key(F.col("a"), F.col("b"), ids.instant_text(F.col("t")), prefix="email"),
        ids.hash_key(F.col("a"), F.col("b")),
    ).first()
    digest = lambda s: hashlib.sha1(s.encode()).hexdigest()[:16]
    assert got[0] == digest("email||a||||2023-06-01 00:00:00")
    assert got[1] == digest("a||")


def test_order_reference(spark):
    df = spark.createDataFrame(
        [("Order 0002456789 issue", "See 0001234567"), ("No order", "Nothing"),
         (None, "12345678901 x1234567890 é1234567890 (0000000001)"), ("short 123456789", None)],
        "s string, b string",
    )
    got = [r[0] for r in df.select(ids.order_reference(F.col("s"), F.col("b"))).collect()]
    assert got == ["0002456789", None, "0000000001", None]


def test_order_reference_in_any_digits(spark):
    given = ["\u0661" * 10, "x" + "\u0661" * 10 + " \u06612345678\u0669.", "1" * 11, "", None]
    got = column(spark, given, ids.order_reference_in)
    assert got == ["\u0661" * 10, None, None, None, None]
    plan = spark.range(1).select(ids.order_reference_in(F.lit("a") + F.col("id")))
    assert "CASE WHEN" in plan._jdf.queryExecution().analyzed().toString()


def test_parse_instant(spark):
    got = column(
        spark, ["2023-01-01", "not-a-date", None, "2023-06-01T10:00:00"],
        lambda c: time.parse_instant(c, "string"),
    )
    assert got == [datetime(2023, 1, 1), None, None, datetime(2023, 6, 1, 10)]


def test_keywords(spark):
    given = ["urgent complaint", "normal email", "DELAYED shipment", "related", None]
    flag = lambda words: lambda c: text.has_keyword(F.lower(F.coalesce(c, F.lit(""))), words)
    assert column(spark, given, flag(["urgent", "delayed"])) == [True, False, True, False, False]
    assert column(spark, given, flag(COMPLAINT_KEYWORDS))[3] is True  # re-late-d
    plain = lambda words, s: any(w in (s or "").lower() for w in words)
    rng = random.Random(3)
    made = [
        " ".join(rng.choice([*COMPLAINT_KEYWORDS, *SPAM_KEYWORDS, "fine", "ok"]) for _ in range(2))
        for _ in range(80)
    ]
    for words in (COMPLAINT_KEYWORDS, SPAM_KEYWORDS):
        assert column(spark, made, flag(words)) == [plain(words, s) for s in made]


def test_count_keyword(spark):
    given = ["Late, too late; LATE", "aaaa", None]
    assert column(spark, given, lambda c: text.count_keyword(c, "late")) == [3, 0, 0]
    assert column(spark, given, lambda c: text.count_keyword(c, "aa"))[1] == 2


def test_message_scope(spark):
    pairs = [("a@in.example", "b@in.example"), ("v@x.com", "a@in.example"),
             ("a@in.example", "v@x.com"), ("v@x.com", "o@x.com"), (None, "a@in.example")]
    df = spark.createDataFrame(pairs, "f string, t string")
    got = [r[0] for r in df.select(text.message_scope(F.col("f"), F.col("t"), "in.example")).collect()]
    assert got == [
        "internal", "external_inbound", "external_outbound", "mixed", "external_inbound",
    ]


def test_text_with_nulls(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    joined = text.joined_text(F.col("x"), F.col("y"), F.col("z"))
    assert df.select(joined).first()[0] == "a  c"
    assert column(spark, [" a \n\t b  c", None], lambda c: text.preview(c, 5)) == [
        " a b ", None,
    ]
    summary = lambda k, o, n: text.document_summary(k, o, n)
    row = df.select(summary(F.col("x"), F.col("y"), F.col("z")), summary(F.col("y"), F.col("x"), F.col("z")))
    assert tuple(row.first()) == ("a for order unknown, customer c", None)


def test_floored_days(spark):
    rows = [
        (datetime(2023, 1, 2, 12), datetime(2023, 1, 2)),
        (datetime(2023, 1, 1, 12), datetime(2023, 1, 2)),
        (datetime(2023, 1, 5), datetime(2023, 1, 2)),
        (None, datetime(2023, 1, 2)),
    ]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    got = [r[0] for r in df.select(time.floored_days(F.col("a"), F.col("b"))).collect()]
    assert got == [0, -1, 3, None]


def test_fixed_matches_printf(spark):
    rng = random.Random(5)
    given = [0.125, 2.675, 0.375, 99.995, 0.999, 9.9999, 1 / 3, -7.125, -2.5, 0.0, 1e9 + 0.005]
    given += [rng.uniform(-1e6, 1e6) for _ in range(300)]
    given += [round(rng.uniform(0, 1e4), 3) for _ in range(300)]
    got = column(spark, given, lambda c: numbers.fixed(c, 2), "double")
    assert got == [f"{v:.2f}" for v in given]


def test_change_text(spark):
    df = spark.createDataFrame([(110, 100), (50, 0), (90, 100)], "c long, b long")
    got = [r[0] for r in df.select(numbers.change_text(F.col("c"), F.col("b"))).collect()]
    assert got == ["10.0%", "n/a", "-10.0%"]


def test_fixed_takes_any_double(spark):
    from orderlens.functions import numbers

    values = [float("nan"), float("inf"), 1e19, -1e19, -2.5, 0.125, -0.001, None, 123456789.005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(numbers.fixed(F.col("v"), 2)).collect()]
    want = [None, None, "10000000000000000000.00", "-10000000000000000000.00", "-2.50", "0.12", "0.00", None]
    assert got[:8] == want and got[8] == f"{123456789.005:.2f}"
    known = [r[0] for r in df.orderBy("i").select(numbers.known(F.col("v"))).collect()]
    assert known[0] is None and known[4] == -2.5
