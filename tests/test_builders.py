from __future__ import annotations

from datetime import datetime

import pytest
from conftest import DOMAIN, day
from pyspark.sql import functions as F

from orderlens.constants import PROCESSED_TABLES
from orderlens.pipeline import Tables
from orderlens.plans import customers, emails, events, measures, orders, quality, reports
from orderlens.plans.corpus import most_relevant_mails
from orderlens.session import new_work_dir
from orderlens.sources.schemas import conform
from orderlens.sources.store import Store


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_email_fact(raw, built):
    rows = {k[1:3]: r for k, r in by(built["fact_email"], "message_id").items()}
    assert sorted(rows) == [f"m{i}" for i in range(1, 9)]
    assert [m for m in sorted(rows) if rows[m]["is_complaint_like"]] == ["m1", "m3", "m5", "m7", "m8"]
    assert [m for m in sorted(rows) if rows[m]["is_spam_like"]] == ["m6"]
    scopes = {m: r["message_scope"] for m, r in rows.items()}
    inbound = dict.fromkeys(["m1", "m4", "m5", "m7", "m8"], "external_inbound")
    assert scopes == inbound | {"m2": "external_outbound", "m3": "internal", "m6": "mixed"}
    linked = {m: r["linked_order_id"] for m, r in rows.items() if r["linked_order_id"]}
    assert linked == {"m1": "4000000001", "m2": "4000000001", "m5": "4000000003"}
    assert rows["m5"]["event_date"] == "2024-02-14" and not rows["m5"]["is_duplicate_source_id"]
    assert rows["m8"]["customer_id_clean"] is None


def test_every_member_of_a_repeated_id_is_flagged(raw):
    doubled = raw["communications"].unionByName(raw["communications"].where("subject = 'A question'"))
    flagged = emails.email_fact(doubled, DOMAIN).where("is_duplicate_source_id")
    assert [r["source_message_id"] for r in flagged.collect()] == ["<m4@post>"] * 2


def test_document_fact(built):
    rows = by(built["fact_document"], "source_document_id")
    assert sorted(rows) == [f"A{i}" for i in range(1, 9)] + ["N1", "N2"]
    times = {name: rows[name]["event_timestamp"] for name in rows}
    assert times == {"A1": day(0), "A2": day(4), "A3": day(11), "A4": day(13), "A5": day(18), "A6": day(17),
                     "A7": day(22), "A8": day(41), "N1": day(3), "N2": None}
    lags = {name: r["delivery_lag_days"] for name, r in rows.items() if r["delivery_lag_days"] is not None}
    assert lags == {"A2": 3, "A4": -1, "A7": 6}
    assert rows["A2"]["content_summary"] == "SHIPPING_NOTICE for order 4000000001, customer House KA"
    assert rows["N1"]["content_summary"] == "Gate two is closed."
    assert rows["N1"]["order_id"] is None and rows["N2"]["event_date"] is None
    assert rows["A5"]["refund_amount"] == 12.5 and rows["A5"]["revenue_amount"] == 0.0


def test_order_fact(built):
    rows = {int(k) % 10: r for k, r in by(built["fact_order"], "order_id").items()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    column = lambda name: [rows[k][name] for k in range(1, 6)]
    assert column("customer_id_clean") == ["KA", "KA", "KB", "KA", "KC"]
    assert column("order_line_count") == [2, 1, 3, 1, 1]
    assert column("product_nunique") == [2, 1, 2, 1, 1]
    assert column("plant_nunique") == [1, 1, 2, 1, 1]
    assert column("shipping_point_nunique") == [1, 1, 2, 1, 1]
    assert column("primary_plant") == ["NORTH", "SOUTH", "NORTH", "NORTH", "SOUTH"]
    assert column("document_count") == [2, 2, 2, 1, 0]
    assert column("linked_email_count") == [2, 0, 1, 0, 0]
    assert column("max_delivery_lag_days") == [3, -1, 0, 6, 0]
    assert column("delayed_shipments") == [1, 0, 0, 1, 0]
    assert column("refund_total") == [0.0, 0.0, 12.5, 0.0, 0.0]
    assert column("revenue_total") == [100.0, 50.0, 0.0, 0.0, 0.0]
    assert column("will_be_delayed") == [True, False, False, True, False]
    assert column("will_generate_credit_memo") == [False, False, True, False, False]
    assert column("will_generate_complaint") == [False, True, True, False, False]


def test_complaints_by_order(built):
    # Not m3 (internal), m7 (95 days after the order of KC) and m8 (no customer).
    found = orders.complaints_by_order(built["fact_order"], built["fact_email"]).collect()
    assert sorted(tuple(r) for r in found) == [("4000000002", 1, day(8)), ("4000000003", 1, day(13))]


def test_customer_dim(built):
    rows = by(built["dim_customer"], "customer_id_clean")
    assert set(rows) == {"KA", "KB", "KC", "KX", None}
    assert {c: r["order_count"] for c, r in rows.items()} == {"KA": 3, "KB": 1, "KC": 1, "KX": 0, None: 0}
    assert {c: r["email_count"] for c, r in rows.items()} == {"KA": 3, "KB": 2, "KC": 1, "KX": 1, None: 1}
    assert rows["KA"]["customer_label"] == "House KA" and rows[None]["customer_label"] == "unlinked"
    assert rows["KC"]["issue_rate"] == rows["KX"]["issue_rate"] == 0.0
    assert rows["KA"]["issue_rate"] == 1.0
    worst = customers.by_issue_rate(built["dim_customer"]).first()
    assert worst["issue_rate"] == max(r["issue_rate"] for r in rows.values())


def test_missing_customer_meets_missing_customer(spark, built):
    mails = built["fact_email"].withColumn("customer_id_clean", F.lit(None).cast("string"))
    rows = customers.customer_dim(built["fact_order"], mails, built["fact_document"])
    nobody = rows.where("customer_id_clean IS NULL").collect()
    assert len(nobody) == 1
    assert (nobody[0]["email_count"], nobody[0]["document_count"]) == (8, 2)
    assert nobody[0]["customer_label"] == "unlinked"


def test_timeline_and_daily(built):
    timeline = built["fact_event_timeline"]
    dated = 5 + 8 + 9  # orders, mails, papers; N2 has no date
    assert timeline.where("event_timestamp IS NOT NULL").count() == dated
    ordered = [r["event_timestamp"] for r in events.in_time_order(timeline).collect() if r["event_timestamp"]]
    assert ordered == sorted(ordered)
    daily = built["fact_customer_daily"]
    assert daily.agg(F.sum("event_count")).first()[0] == dated
    assert daily.where("customer_id_clean IS NULL").agg(F.sum("event_count")).first()[0] == 2  # m8 and N1


def test_prior_features(built):
    rows = {int(k) % 10: r for k, r in by(built["fact_order_risk_features"], "order_id").items()}
    column = lambda name: [round(rows[k][name], 6) for k in range(1, 6)]
    # KA: first order delayed, second one complained about; others have no earlier order.
    assert column("customer_prior_will_be_delayed_rate") == [0, 1, 0, 0.5, 0]
    assert column("customer_prior_will_generate_complaint_rate") == [0, 0, 0, 0.5, 0]
    assert column("customer_prior_will_generate_credit_memo_rate") == [0, 0, 0, 0, 0]
    assert column("plant_prior_orders") == [0, 0, 1, 2, 1]
    assert column("plant_prior_delay_rate") == [0, 0, 1, 0.5, 0]


def test_corpus(built):
    corpus = built["retrieval_corpus"]
    kinds = {r["entity_type"]: r["count"] for r in corpus.groupBy("entity_type").count().collect()}
    assert kinds["customer"] == 5 and kinds["document"] == 10 and kinds["order"] == 3
    order = corpus.where("doc_id = 'order:4000000001'").first()
    assert order["text"] == (
        "Order 4000000001 for customer KA created on 2024-02-01. 2 lines, 2 documents, "
        "2 emails, max delivery lag 3 days, complaint=False, credit=False."
    )
    customer = corpus.where("doc_id = 'customer:KA'").first()
    assert "issue rate 100.00%," in customer["text"]


def test_mail_cap_keeps_complaints_first(built):
    capped = most_relevant_mails(built["fact_email"], 6).collect()
    assert len(capped) == 6
    assert [r["is_complaint_like"] for r in capped].count(True) == 5


def test_quality_report(raw, built):
    report = quality.quality_report(raw, built)
    assert report["raw_counts"]["communications"] == 8
    assert report["processed_counts"]["fact_order"] == 5
    assert report["sqlite_vs_parquet_email_gap"] == 5
    assert report["email_duplicate_source_ids"] == 0
    assert report["null_customer_ids_in_email_pct"] == 12.5
    assert report["email_date_range"] == ["2024-02-09 00:00:00", "2024-05-31 00:00:00"]


def test_empty_inputs(spark, raw):
    none = {name: df.limit(0) for name, df in raw.items()}
    mails = emails.email_fact(none["communications"], DOMAIN)
    from orderlens.plans.documents import document_fact

    docs = document_fact(none["supporting_documents"], none["business_documents"])
    fact = orders.order_fact(none["erp_transactions"], mails, docs)
    assert fact.isEmpty()
    assert customers.customer_dim(fact, mails, docs).isEmpty()
    assert events.event_timeline(fact, mails, docs).isEmpty()
    assert orders.complaints_by_order(fact, mails).isEmpty()


def test_missing_columns(raw):
    with pytest.raises(ValueError, match="message_id"):
        conform(raw["communications"].drop("message_id"), "communications")
    bare = raw["supporting_documents"].drop("ship_date", "billed_amount")
    added = conform(bare, "supporting_documents")
    assert added.schema["ship_date"].dataType.simpleString() == "timestamp"


def test_entity_lookup_and_pages(built):
    chosen = reports.of_entity(built["fact_order"], "order_id", "4000000002")
    assert chosen.count() == 1
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_id,4000000002)" in plan
    flow = {(r["source"], r["target"]): r["orders"] for r in reports.lifecycle_flow(built["fact_order"]).collect()}
    assert flow[("All orders", "No issue")] == 5 - 2 - 2


def test_complaint_change_has_no_gaps(spark):
    rows = [("a", datetime(2023, 1, 5), True), ("b", datetime(2023, 3, 5), True),
            ("c", datetime(2023, 3, 6), True)]
    df = spark.createDataFrame(rows, "order_id string, order_created_at timestamp, will_generate_complaint boolean")
    got = measures.complaint_change(df).orderBy("month").collect()
    assert [(r["complaint_orders"], r["change"]) for r in got] == [(1, None), (0, -1.0), (2, None)]


def _named(spark, folder):
    from orderlens.sources.store import path_exists

    return {name for name in PROCESSED_TABLES if path_exists(spark, f"{folder}/{name}.parquet")}


def test_tables_are_written_when_read_and_without_bodies(spark, raw, built):
    folder = new_work_dir(spark, "on-demand")
    tables = Tables(raw, Store(spark, folder), DOMAIN, texts=False)
    assert list(tables) == PROCESSED_TABLES and not _named(spark, folder)
    assert tables["fact_document"].count() == built["fact_document"].count()
    assert _named(spark, folder) == {"fact_document"}
    assert rows_of(tables["fact_order"]) == rows_of(built["fact_order"])
    assert _named(spark, folder) == {"fact_document", "fact_order", "fact_email"}
    assert set(built["fact_email"].columns) - set(tables["fact_email"].columns) == {"body"}
    # The corpus still holds whole texts, read from the raw mails, and is not stored.
    assert rows_of(tables["retrieval_corpus"]) == rows_of(built["retrieval_corpus"])
    assert "retrieval_corpus" not in _named(spark, folder)


def test_reports_compute_their_columns_and_write_no_fact(spark, raw, built):
    folder = new_work_dir(spark, "composed")
    tables = Tables(raw, Store(spark, folder), DOMAIN, texts=False)
    for name in ["fact_email", "fact_document", "fact_order", "fact_event_timeline", "fact_customer_daily"]:
        wanted = built[name].drop("body")
        assert rows_of(tables.plan(name)) == rows_of(wanted), name
    heads = tables.plan("fact_order").select("order_id", "order_created_at")
    plan = heads._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ["Join", "body", "document_type"])
    flagless = tables.plan("fact_document").select("order_id", "event_timestamp")
    assert "_again" not in flagless._jdf.queryExecution().optimizedPlan().toString()
    assert not _named(spark, folder)
    assert rows_of(tables["dim_customer"]) == rows_of(built["dim_customer"])
    assert rows_of(tables["fact_event_timeline"]) == rows_of(built["fact_event_timeline"])
    assert _named(spark, folder) == {"dim_customer", "fact_event_timeline"}


def test_kept_columns_are_written_once(spark, raw, built):
    tables = Tables(raw, Store(spark, new_work_dir(spark, "kept")), DOMAIN, texts=False)
    for name, columns in [
        ("fact_order", ["order_id", "will_be_delayed"]),
        ("fact_order_risk_features", ["order_id", "order_line_count", "plant_prior_delay_rate"]),
    ]:
        kept = tables.kept(name, *columns)
        assert rows_of(kept) == rows_of(built[name].select(columns))
        assert kept.columns == columns and kept.inputFiles()
        assert tables.kept(name, *columns).inputFiles() == kept.inputFiles()


def test_distinct_lines_are_counted_without_sorting_the_heads_again(raw):
    plan = orders.order_rollup(raw["erp_transactions"])._jdf.queryExecution().executedPlan().toString()
    expanded = [line for line in plan.splitlines() if "Expand [" in line]
    assert expanded and not any("struct(" in line for line in expanded)


def test_complaints_read_the_text_once(raw):
    """A filter on the flag would lower the whole text for each keyword."""
    mails = emails.email_rows(raw["communications"], DOMAIN)
    found = orders.complaints_by_order(orders.order_rollup(raw["erp_transactions"]), mails)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" in plan
    assert all(line.count("lower(") <= 1 for line in plan.splitlines())
