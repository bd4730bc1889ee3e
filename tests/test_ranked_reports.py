"""Reports by risk, order times, class ranks and near orders: what is shuffled, and their rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderlens.constants import TARGETS
from orderlens.operators.nearest import nearest_in_time
from orderlens.plans import orders, reports
from orderlens.risk import splits

OPENED = datetime(2024, 2, 1)
FIGURES = ["linked_email_count", "document_count", "max_delivery_lag_days"]


def frames(spark, given, scored):
    """Orders (id, customer, days) and scores (id, customer, days, score of every target)."""
    at = lambda days: OPENED + timedelta(days=days)
    keys = "order_id string, customer_id_clean string, order_created_at timestamp, "
    rows = [(i, c, at(d), 1, 2, 3) for i, c, d in given]
    marks = [(i, c, at(d), *[s] * len(TARGETS)) for i, c, d, s in scored]
    return (
        spark.createDataFrame(rows, keys + ", ".join(f"{f} long" for f in FIGURES)),
        spark.createDataFrame(marks, keys + ", ".join(f"{t}_score double" for t in TARGETS)),
    )


def shown(df):
    return [(row["order_id"], round(row["composite_risk"], 6)) for row in df.collect()]


def test_risk_reports_compute_figures_of_leading_orders_only(spark):
    given = [(f"{i:03}", "K", i) for i in range(40)]
    scored = [(f"{i:03}", "K", i, (40 - i) / 40) for i in range(40)]
    found = reports.top_risk_orders(*frames(spark, given, scored), n=3)
    assert shown(found) == [("000", 1.0), ("001", 0.975), ("002", 0.95)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "order_id" in plan and ("IN (" in plan or "INSET" in plan)


@pytest.mark.parametrize("report", ["overview_risk", "risk_landscape", "top_risk_orders"])
def test_leading_scores_without_orders_lose_no_order(spark, report):
    given = [(f"{i:03}", "K" if i % 2 else None, i) for i in range(40)] + [(None, "K", 50)]
    # The first twenty scores meet no order: another customer, or no such order.
    scored = [(f"{i:03}", "other", i, 0.9) for i in range(10)]
    scored += [(f"x{i}", "K", i, 0.8) for i in range(10)]
    scored += [(f"{i:03}", "K" if i % 2 else None, i, 0.5) for i in range(30, 40)]
    scored += [(None, "K", 50, 0.5), ("031", "K", 31, 0.5)]
    found = shown(getattr(reports, report)(*frames(spark, given, scored), n=4))
    assert found == [("030", 0.5), ("031", 0.5), ("031", 0.5), ("032", 0.5)]


def test_orders_without_scores_fill_the_overview(spark):
    given = [(f"{i:03}", "K", i) for i in range(9)]
    scored = [("004", "K", 4, 0.5)] + [(f"x{i}", "K", i, 0.0) for i in range(30)] + [("001", "K", 1, -1.0)]
    found = shown(reports.overview_risk(*frames(spark, given, scored), n=3))
    assert found == [("004", 0.5), ("000", 0.0), ("002", 0.0)]
    assert shown(reports.risk_landscape(*frames(spark, given, scored), n=3)) == [("004", 0.5), ("001", -1.0)]


def test_null_order_among_the_riskiest(spark):
    given = [(f"{i:03}", "K", i) for i in range(9)] + [(None, None, 50)]
    scored = [(f"{i:03}", "K", i, 0.5) for i in range(9)] + [(None, None, 50, 0.9)]
    found = shown(reports.overview_risk(*frames(spark, given, scored), n=2))
    assert found == [(None, 0.9), ("000", 0.5)]


def test_order_times_are_shuffled_alone(spark, raw):
    totals = orders.order_totals(orders.order_lines(raw["erp_transactions"]))
    plan = totals.select("order_created_at")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(" in plan and "min(struct" not in plan and "named_struct" not in plan
    same = totals.join(
        raw["erp_transactions"].groupBy(F.col("SALESDOCUMENT").alias("order_key")).agg(
            F.min("CREATIONDATE").alias("first")
        ),
        "order_key",
    )
    assert same.where("order_created_at = first").count() == totals.count() == 5


def test_folds_follow_the_hash_kept_as_bytes(spark):
    frame = spark.range(300).select(
        F.col("id").cast("string").alias("order_id"), (F.col("id") % 3 == 0).cast("int").alias("label")
    )
    found = splits.stratified_folds(frame, "label", folds=4, seed=7)
    digest = F.sha1(F.concat_ws("|", F.lit("folds-7"), "order_id")).alias("digest")
    rows = found.select("order_id", "label", "fold", digest).collect()
    for label in (0, 1):
        ranked = sorted((r for r in rows if r["label"] == label), key=lambda r: r["digest"])
        assert [r["fold"] for r in ranked] == [i % 4 for i in range(len(ranked))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan


def test_points_are_dealt_by_bucket_once(spark):
    rows = [("K", OPENED + timedelta(hours=h), str(h)) for h in (0, 5, 9)]
    seen = spark.createDataFrame(rows, "user string, at timestamp, id string")
    near = nearest_in_time(
        seen.select("user", (F.col("at") + F.expr("INTERVAL 1 HOUR")).alias("at")), seen,
        key="user", at="at", target_id="id", tolerance_micros=2 * 3_600_000_000,
    )
    plan = near._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning(key#" in line and "bucket#" in line]
    # Only the nearest edges, which were ranked by key, are dealt by bucket again.
    assert len([line for line in dealt if "ENSURE_REQUIREMENTS" in line]) == 1
    assert sorted(row["id"] for row in near.collect()) == ["0", "5", "9"]


def test_order_figures_meet_their_scores_as_numbers(spark):
    given, scored = frames(spark, [("1", "K", 0), ("2", "K", 1)], [("2", "K", 1, 0.25)])
    given = given.select(
        "order_id", F.lit(2).alias("order_line_count"), "max_delivery_lag_days",
        F.lit(True).alias("will_generate_complaint"), F.lit(False).alias("will_generate_credit_memo"),
    )
    found = reports.order_kpis(given, scored)
    marks = [f"{t}_score_text" for t in TARGETS]
    rows = {r["order_id"]: r for r in found.collect()}
    assert [rows["2"][m] for m in marks] == ["25.0%"] * 3
    assert rows["1"]["max_lag"] == "3 days" and rows["1"]["complaint_flag"] == "True"
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert " days" not in below and "initcap" not in below
