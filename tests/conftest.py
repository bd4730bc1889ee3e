"""One small session, and the raw tables of a small trading house."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from orderlens.session import local_session  # noqa: E402

DOMAIN = "harbor.test"
OPENED = datetime(2024, 2, 1)


def day(n: float) -> datetime:
    return OPENED + timedelta(days=n)


# A small trading house: five orders of three customers, told line by line.
# order, item, day, customer, product, plant, shipping point
LINES = [
    ("4000000001", "10", 0, "KA", "P-1", "NORTH", "S1"),
    ("4000000001", "20", 0, "KA", "P-2", "NORTH", "S1"),
    ("4000000002", "10", 10, "KA", "P-1", "SOUTH", "S1"),
    ("4000000003", "10", 12, "KB", "P-3", "NORTH", "S2"),
    ("4000000003", "20", 12, "KB", "P-3", "SOUTH", "S2"),
    ("4000000003", "30", 12, "KB", "P-1", "NORTH", "S1"),
    ("4000000004", "10", 20, "KA", "P-2", "NORTH", "S2"),
    ("4000000005", "10", 25, "KC", "P-2", "SOUTH", "S1"),
]

# message, from inside?, to inside?, day, customer, subject, body
MAILS = [
    # Nearer to the second order of KA than to the first, which it names.
    ("m1", False, True, 8, "KA", "Where is 4000000001", "This is urgent, damaged goods."),
    ("m2", True, False, 9, "KA", "Re: 4000000001", "We are looking into it."),
    ("m3", True, True, 10, "KB", "Weekly numbers", "urgent: numbers please"),
    ("m4", False, True, 11, "KA", "A question", "Please send the paper again."),
    ("m5", False, True, 13, "KB", "Shortage on 4000000003", "Two boxes are missing."),
    ("m6", False, False, 14, "KX", "Special offer", "click here to unsubscribe"),
    ("m7", False, True, 120, "KC", "Another delay", "More than sixty days after the order."),
    ("m8", False, True, 15, " nan ", "urgent", "From nobody we know."),
]

# document, type, order, customer, dates by name as days, billed, total, credit
PAPERS = [
    ("A1", "PURCHASE_ORDER", 1, "KA", {"order_date": 0}, 100.0, 80.0, None),
    ("A2", "SHIPPING_NOTICE", 1, "KA",
     {"order_date": 0, "ship_date": 4, "expected_delivery": 6, "actual_delivery": 9}, None, None, None),
    ("A3", "INVOICE", 2, "KA", {"order_date": 10, "invoice_date": 11}, 50.0, 40.0, None),
    ("A4", "SHIPPING_NOTICE", 2, "KA",
     {"order_date": 10, "ship_date": 13, "expected_delivery": 15, "actual_delivery": 14}, None, None, None),
    ("A5", "CREDIT_MEMO", 3, "KB", {"order_date": 12, "issue_date": 18}, None, None, 12.5),
    ("A6", "QUALITY_REPORT", 3, "KB", {"order_date": 12, "inspection_date": 17}, None, None, None),
    ("A7", "SHIPPING_NOTICE", 4, "KA",
     {"order_date": 20, "ship_date": 22, "expected_delivery": 24, "actual_delivery": 30}, None, None, None),
    ("A8", "INVOICE", 9, "KD", {"order_date": 40, "invoice_date": 41}, 7.0, 7.0, None),
]
PAPER_DATES = [
    "order_date", "invoice_date", "ship_date", "inspection_date", "issue_date",
    "expected_delivery", "actual_delivery",
]

# document, type, day, content
NOTES = [("N1", "NOTICE", 3, "Gate  two\tis closed."), ("N2", "MINUTES", None, "All present.")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        "tests", cores="8", shuffle_partitions="4", driver_memory="4g",
        **{"spark.checkpoint.dir": folder},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    address = lambda inside, name: f"{name}@{DOMAIN if inside else 'kiln.example'}"
    mails = spark.createDataFrame(
        [
            (f"<{name}@post>", address(inside, "desk"), address(to_inside, "buyer"), None, subject, body,
             day(at).isoformat(), customer, "Kiln", None)
            for name, inside, to_inside, at, customer, subject, body in MAILS
        ],
        "message_id string, `from` string, `to` string, cc string, subject string, body string, "
        "timestamp string, customer_id string, vendor string, from_company string",
    )
    lines = spark.createDataFrame(
        [(order, item, day(at), *rest) for order, item, at, *rest in LINES],
        "SALESDOCUMENT string, SALESDOCUMENTITEM string, CREATIONDATE timestamp, SOLDTOPARTY string, "
        "PRODUCT string, PLANT string, SHIPPINGPOINT string",
    )
    papers = spark.createDataFrame(
        [
            (name, kind, f"400000000{order}", customer, f"House {customer}", billed, total, credit,
             *[day(dates[d]) if d in dates else None for d in PAPER_DATES])
            for name, kind, order, customer, dates, billed, total, credit in PAPERS
        ],
        "document_id string, document_type string, order_number string, customer_id string, "
        "customer_name string, billed_amount double, total_amount double, credit_amount double, "
        + ", ".join(f"{d} timestamp" for d in PAPER_DATES),
    )
    notes = spark.createDataFrame(
        [(name, kind, None if at is None else day(at), content) for name, kind, at, content in NOTES],
        "document_id string, document_type string, created_date timestamp, content string",
    )
    unread = spark.createDataFrame([], "id long")
    return {
        "communications": mails,
        "erp_transactions": lines,
        "sales_documents": unread,
        "sales_items": unread,
        "supporting_documents": papers,
        "business_documents": notes,
        "sqlite_emails": mails.limit(3),
        "sqlite_contacts": unread,
    }


@pytest.fixture(scope="session")
def built(spark, raw):
    from orderlens.pipeline import build_tables
    from orderlens.session import new_work_dir
    from orderlens.sources.store import Store

    return build_tables(raw, Store(spark, new_work_dir(spark, "fixture")), DOMAIN)
