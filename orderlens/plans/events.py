"""Event timeline and daily activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, time


def event_timeline(
    order_fact: DataFrame, fact_email: DataFrame, fact_document: DataFrame
) -> DataFrame:
    """Orders, mails and documents as one list of events."""
    orders = order_fact.select(
        "order_id",
        "customer_id_clean",
        F.col("order_created_at").alias("event_timestamp"),
        F.lit("order_created").alias("event_type"),
        F.lit("Order created").alias("title"),
        F.coalesce("order_id", F.lit("unknown")).alias("detail"),
        F.lit("fact_order").alias("source_table"),
    )
    mails = fact_email.select(
        F.col("linked_order_id").alias("order_id"),
        "customer_id_clean",
        F.col("timestamp").alias("event_timestamp"),
        F.when(F.col("message_scope") == "internal", "internal_email")
        .otherwise("email")
        .alias("event_type"),
        F.col("subject").alias("title"),
        F.col("body_preview").alias("detail"),
        F.lit("fact_email").alias("source_table"),
    )
    documents = fact_document.select(
        "order_id",
        "customer_id_clean",
        "event_timestamp",
        F.lit("document").alias("event_type"),
        F.col("document_type").alias("title"),
        F.col("content_summary").alias("detail"),
        F.lit("fact_document").alias("source_table"),
    )
    return (
        orders.unionByName(mails)
        .unionByName(documents)
        .withColumns(
            {
                "event_date": time.day_text(F.col("event_timestamp")),
                "event_id": ids.hash_key(
                    F.col("order_id"),
                    F.col("customer_id_clean"),
                    ids.instant_text(F.col("event_timestamp")),
                    F.col("title"),
                ),
            }
        )
    )


def in_time_order(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy(F.asc_nulls_last("event_timestamp"), "event_id")


def customer_daily(
    order_fact: DataFrame, fact_email: DataFrame, fact_document: DataFrame
) -> DataFrame:
    """Events per customer, day and kind; events without a time are left out."""
    kinds = [
        (order_fact, "order_created_at", "order"),
        (fact_email, "timestamp", "email"),
        (fact_document, "event_timestamp", "document"),
    ]
    events = None
    for fact, at, kind in kinds:
        rows = fact.where(F.col(at).isNotNull()).select(
            "customer_id_clean",
            F.date_trunc("day", F.col(at)).alias("event_date"),
            F.lit(kind).alias("event_type"),
        )
        events = rows if events is None else events.unionByName(rows)
    return events.groupBy("customer_id_clean", "event_date", "event_type").agg(
        F.count(F.lit(1)).alias("event_count")
    )


def in_day_order(daily: DataFrame) -> DataFrame:
    return daily.orderBy("event_date", F.asc_nulls_last("customer_id_clean"), "event_type")
