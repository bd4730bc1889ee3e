"""Retrieval corpus: one row per document that can be cited as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text, time

COLUMNS = [
    "doc_id", "entity_type", "entity_id", "customer_id", "order_id",
    "document_type", "event_date", "title", "text", "citation",
]


def retrieval_corpus(
    order_fact: DataFrame,
    customer_dim: DataFrame,
    fact_email: DataFrame,
    fact_document: DataFrame,
    email_cap: int | None = None,
) -> DataFrame:
    """Whole texts of mails and business documents; with email_cap only the most
    relevant mails."""
    parts = [
        _orders(order_fact),
        _customers(customer_dim),
        _mails(most_relevant_mails(fact_email, email_cap)),
        _documents(fact_document),
    ]
    corpus = parts[0]
    for part in parts[1:]:
        corpus = corpus.unionByName(part)
    return (
        corpus.withColumn("citation", F.col("doc_id"))
        .where(F.col("text").isNotNull())
        .select(*COLUMNS)
    )


def _orders(order_fact: DataFrame) -> DataFrame:
    """Summaries of orders with mails, a credit memo, a quality report or a delay."""
    notable = order_fact.where(
        F.col("has_linked_email")
        | F.col("has_credit_memo")
        | F.col("has_quality_report")
        | F.col("will_be_delayed")
    )
    order_id = text.id_or_na(F.col("order_id"))
    created = F.coalesce(time.day_text(F.col("order_created_at")), F.lit("NaT"))
    summary = F.concat(
        F.lit("Order "), order_id,
        F.lit(" for customer "), text.id_or_na(F.col("customer_id_clean")),
        F.lit(" created on "), created,
        F.lit(". "), F.col("order_line_count").cast("string"),
        F.lit(" lines, "), F.col("document_count").cast("string"),
        F.lit(" documents, "), F.col("linked_email_count").cast("string"),
        F.lit(" emails, max delivery lag "), F.col("max_delivery_lag_days").cast("string"),
        F.lit(" days, complaint="), text.true_false(F.col("will_generate_complaint")),
        F.lit(", credit="), text.true_false(F.col("will_generate_credit_memo")),
        F.lit("."),
    )
    return notable.select(
        F.concat(F.lit("order:"), order_id).alias("doc_id"),
        F.lit("order").alias("entity_type"),
        F.col("order_id").alias("entity_id"),
        F.col("customer_id_clean").alias("customer_id"),
        F.col("order_id"),
        F.lit("order_summary").alias("document_type"),
        time.day_text(F.col("order_created_at")).alias("event_date"),
        F.concat(F.lit("Order "), order_id, F.lit(" summary")).alias("title"),
        summary.alias("text"),
    )


def _customers(customer_dim: DataFrame) -> DataFrame:
    label = F.col("customer_label")
    summary = F.concat(
        F.lit("Customer "), label,
        F.lit(" ("), text.id_or_na(F.col("customer_id_clean")),
        F.lit(") has "), F.col("order_count").cast("string"),
        F.lit(" orders, "), F.col("email_count").cast("string"),
        F.lit(" emails, "), F.col("document_count").cast("string"),
        F.lit(" documents, issue rate "), numbers.percent(F.col("issue_rate"), 2),
        F.lit(", invoice total "), numbers.fixed(F.col("invoice_total"), 2),
        F.lit(", credit total "), numbers.fixed(F.col("credit_total"), 2),
        F.lit("."),
    )
    customer_id = F.col("customer_id_clean")
    return customer_dim.select(
        F.concat(F.lit("customer:"), F.coalesce(customer_id, F.lit("unlinked"))).alias("doc_id"),
        F.lit("customer").alias("entity_type"),
        customer_id.alias("entity_id"),
        customer_id.alias("customer_id"),
        F.lit(None).cast("string").alias("order_id"),
        F.lit("customer_summary").alias("document_type"),
        time.day_text(F.col("latest_order_at")).alias("event_date"),
        F.concat(F.lit("Customer "), label, F.lit(" summary")).alias("title"),
        summary.alias("text"),
    )


def most_relevant_mails(fact_email: DataFrame, cap: int | None) -> DataFrame:
    """Complaints and mails that name an order: complaints first, oldest first, up to a cap.

    Mails are counted per flag and day first. Only the days needed to fill the cap
    are sorted; each of these days holds at least one mail, so the list of days
    is no longer than the cap and safe to broadcast.
    """
    wanted = fact_email.where(
        F.col("linked_order_id").isNotNull() | F.col("is_complaint_like")
    ).withColumn("_day", F.coalesce(time.day_number(F.col("timestamp")), F.lit(1 << 40)))
    if cap is None:
        return wanted.drop("_day")
    per_day = wanted.groupBy("is_complaint_like", "_day").agg(F.count(F.lit(1)).alias("_n"))
    # One row per flag and day: a calendar-sized window, whatever the mail volume.
    earlier = (
        Window.orderBy(F.desc("is_complaint_like"), "_day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = (
        per_day.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where(F.col("_before") < cap)
        .select("is_complaint_like", "_day")
    )
    return (
        wanted.join(F.broadcast(needed), ["is_complaint_like", "_day"], "left_semi")
        .drop("_day")
        .orderBy(
            F.desc("is_complaint_like"),
            F.asc_nulls_last("timestamp"),
            "canonical_message_id",
            "body_preview",
        )
        .limit(cap)
    )


def _mails(mails: DataFrame) -> DataFrame:
    sender = F.coalesce("from_name", "from_email", F.lit("unknown"))
    receiver = F.coalesce("to_name", "to_email", F.lit("unknown"))
    body = F.concat(
        F.lit("From "), sender, F.lit(" to "), receiver,
        F.lit(". "), text.or_empty(F.col("subject")),
        F.lit(". "), text.collapsed(text.or_empty(F.col("body"))),
    )
    return mails.select(
        F.concat(F.lit("email:"), "canonical_message_id").alias("doc_id"),
        F.lit("email").alias("entity_type"),
        F.col("canonical_message_id").alias("entity_id"),
        F.col("customer_id_clean").alias("customer_id"),
        F.col("linked_order_id").alias("order_id"),
        F.lit("email").alias("document_type"),
        "event_date",
        F.coalesce("subject", F.lit("Email")).alias("title"),
        body.alias("text"),
    )


def _documents(fact_document: DataFrame) -> DataFrame:
    kind = F.col("document_type")
    title = F.concat(
        F.coalesce(kind, F.lit("Document")), F.lit(" "), text.or_empty(F.col("source_document_id"))
    )
    return fact_document.select(
        F.concat(F.lit("document:"), "canonical_document_id").alias("doc_id"),
        F.lit("document").alias("entity_type"),
        F.col("canonical_document_id").alias("entity_id"),
        F.col("customer_id_clean").alias("customer_id"),
        "order_id",
        F.coalesce(kind, F.lit("document")).alias("document_type"),
        "event_date",
        title.alias("title"),
        F.coalesce(text.collapsed(F.col("content")), "content_summary", F.lit("")).alias("text"),
    )
