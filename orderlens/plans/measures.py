"""Measures and visuals of the BI model, over the real column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HIGH_RISK_SCORE, TARGETS
from ..functions import time
from ..functions.numbers import ratio_or_blank


def kpi_measures(orders: DataFrame) -> DataFrame:
    """Total orders, distinct customers (a missing customer is one) and the rates."""
    rate = lambda flag: ratio_or_blank(F.count_if(flag), F.count(F.lit(1)))
    no_customer = F.count_if(F.col("customer_id_clean").isNull()) > 0
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        (F.count_distinct("customer_id_clean") + no_customer.cast("int")).alias(
            "unique_customers"
        ),
        rate("will_be_delayed").alias("delay_rate"),
        rate("will_generate_complaint").alias("complaint_rate"),
        rate("will_generate_credit_memo").alias("credit_memo_rate"),
    )


def risk_measures(scores: DataFrame, high: float = HIGH_RISK_SCORE) -> DataFrame:
    return scores.agg(
        *[F.avg(f"{t}_score").alias(f"avg_{t}_score") for t in TARGETS],
        F.count_if(F.col("will_be_delayed_score") >= high).alias("high_risk_delay"),
        F.count_if(F.col("will_generate_complaint_score") >= high).alias("high_risk_complaint"),
    )


def month_to_date_orders(orders: DataFrame) -> DataFrame:
    """Per day, the orders of its month so far; days are counted before the window."""
    daily = (
        orders.where(F.col("order_created_at").isNotNull())
        .groupBy(F.to_date("order_created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    month = Window.partitionBy(F.date_trunc("month", "day")).orderBy("day")
    return daily.select("day", F.sum("orders").over(month).alias("month_to_date_orders"))


def complaint_change(orders: DataFrame) -> DataFrame:
    """Complaint orders per month against the month before, on a gap-free calendar."""
    monthly = (
        orders.where(F.col("order_created_at").isNotNull())
        .groupBy(F.trunc("order_created_at", "month").alias("month"))
        .agg(F.count_if("will_generate_complaint").alias("complaint_orders"))
    )
    calendar = monthly.agg(
        F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias(
            "month"
        )
    )
    filled = calendar.join(monthly, "month", "left").fillna(0, subset=["complaint_orders"])
    # One row per calendar month.
    before = F.lag("complaint_orders").over(Window.orderBy("month"))
    return filled.withColumn("previous_orders", before).withColumn(
        "change",
        ratio_or_blank(F.col("complaint_orders") - F.col("previous_orders"), F.col("previous_orders")),
    )


def customer_rates(orders: DataFrame) -> DataFrame:
    """Per customer: orders and delay, complaint and credit-memo rates."""
    rate = lambda flag: ratio_or_blank(F.count_if(flag), F.count(F.lit(1)))
    return orders.groupBy("customer_id_clean").agg(
        F.count(F.lit(1)).alias("orders"),
        rate("will_be_delayed").alias("delay_rate"),
        rate("will_generate_complaint").alias("complaint_rate"),
        rate("will_generate_credit_memo").alias("credit_memo_rate"),
    )


def top_complaint_rate(orders: DataFrame) -> DataFrame:
    return customer_rates(orders).agg(F.max("complaint_rate").alias("top_complaint_rate"))


def plants_by_delay(orders: DataFrame, n: int = 10) -> DataFrame:
    rated = orders.groupBy("primary_plant").agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg(F.col("will_be_delayed").cast("int")).alias("delay_rate"),
    )
    return rated.orderBy(F.desc("delay_rate"), F.asc_nulls_last("primary_plant")).limit(n)


def history_scatter(customers: DataFrame) -> DataFrame:
    """Points of the order-volume against issue-rate chart."""
    return customers.select("customer_label", "order_count", "issue_rate")


def score_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """Scored orders per target and score bin; a score of one is in the last bin."""
    long = scores.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(t).alias("target"), F.col(f"{t}_score").alias("score"))
                    for t in TARGETS
                ]
            )
        )
    )
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return (
        long.where(F.col("score").isNotNull())
        .groupBy("target", at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def highest_risk_orders(scores: DataFrame, n: int = 20) -> DataFrame:
    columns = [f"{t}_score" for t in TARGETS]
    return (
        scores.select("order_id", *columns)
        .orderBy(F.desc(F.greatest(*columns)), "order_id")
        .limit(n)
    )


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and share of nulls per table and column, one pass over each table."""
    profiles = None
    for name, df in tables.items():
        rows = F.count(F.lit(1))
        columns = [
            F.struct(
                F.lit(c).alias("column"),
                rows.alias("rows"),
                ratio_or_blank(F.count_if(F.col(c).isNull()), rows).alias("null_rate"),
            )
            for c in df.columns
        ]
        one = df.agg(F.array(*columns).alias("c")).select(
            F.lit(name).alias("table"), F.inline("c")
        )
        profiles = one if profiles is None else profiles.unionByName(one)
    return profiles


def relationship_check(tables: dict[str, DataFrame]) -> DataFrame:
    """Per relationship: rows of the many side, those whose key is missing on the one side,
    and keys of the one side that are not unique."""
    # --- Fixed values: many side, its key, one side, its key
    relationships = [
        ("fact_order_risk_features", "order_id", "fact_order", "order_id"),
        ("fact_email", "linked_order_id", "fact_order", "order_id"),
        ("fact_document", "order_id", "fact_order", "order_id"),
        ("fact_event_timeline", "order_id", "fact_order", "order_id"),
        ("fact_order", "customer_id_clean", "dim_customer", "customer_id_clean"),
        ("fact_customer_daily", "customer_id_clean", "dim_customer", "customer_id_clean"),
        ("order_risk_scores", "order_id", "fact_order", "order_id"),
        ("fact_order", "order_id", "order_risk_scores", "order_id"),
    ]
    relationships = [r for r in relationships if r[0] in tables and r[2] in tables]
    checks = None
    for many, key, one, one_key in relationships:
        # Keys are counted before the join, so a frequent key is one row in it.
        keys = (
            tables[many].where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        )
        known = tables[one].groupBy(F.col(one_key).alias("key")).agg(
            F.count(F.lit(1)).alias("known")
        )
        twice = known.where(F.col("key").isNotNull()).agg(F.count_if(F.col("known") > 1)).scalar()
        check = keys.join(known, "key", "left").agg(
            F.lit(f"{many}.{key} -> {one}.{one_key}").alias("relationship"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias(
                "orphans"
            ),
            F.max(twice).alias("repeated_keys"),
        )
        checks = check if checks is None else checks.unionByName(check)
    return checks
