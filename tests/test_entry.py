from __future__ import annotations

import __spark_entry__ as entry

from orderlens import catalog

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_fact_plans_stay_in_the_jvm(spark):
    for name in ("order_fact", "risk_features", "precision_recall", "retrieval_corpus"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_history_windows_are_cut_into_buckets(spark):
    plan = catalog.risk_features(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_customer" in w or "_plant" in w for w in windows)
    assert "SinglePartition" not in plan


def test_order_path_carries_no_duplicate_flag(spark):
    for name in ("order_fact", "complaints_by_order"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "_again" not in plan and "is_duplicate" not in plan


def test_null_keys_meet_their_scores(spark):
    from orderlens import bindings
    from orderlens.plans import reports

    orders = catalog.built(spark, SMALL)["fact_order"]
    scores = bindings.order_scores(spark, SMALL)
    assert scores.where("customer_id_clean IS NULL").count() > 0
    assert reports.scored_risk(orders, scores).count() == orders.count()
    nobody = reports.overview_risk(orders, scores, 10**6).where("customer_id_clean IS NULL")
    assert nobody.where("composite_risk > 0").count() > 0


def test_customers_come_from_the_dimension(spark):
    tables = catalog.built(spark, SMALL)
    known = tables["dim_customer"].where("customer_id_clean IS NOT NULL").count()
    ordering = tables["fact_order"].select("customer_id_clean").dropna().distinct().count()
    assert catalog.QUERIES["headline_kpis"](spark, SMALL).first()["customers"] == known > ordering


def test_mails_are_dealt_over_tasks_before_their_texts_are_read(spark):
    """The test file is one split; broadcast documents would leave its one task all the texts."""
    from pyspark.sql import functions as F

    from orderlens import bindings

    mails = bindings.communications(spark, SMALL).select("body", F.spark_partition_id().alias("task"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert mails.where("body IS NOT NULL").select("task").distinct().count() == tasks > 1
