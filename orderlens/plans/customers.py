"""Customer dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.numbers import ratio_or_zero

_KEY = "customer_key"


def _keyed(df: DataFrame):
    return df.groupBy(ids.joinable(F.col("customer_id_clean")).alias(_KEY))


def customer_names(*facts: DataFrame) -> DataFrame:
    """One name per customer.

    Names are compared as distinct (customer, name) pairs, where every name occurs
    once, so the most frequent name is simply the smallest.
    """
    pairs = None
    for fact in facts:
        if "customer_name" not in fact.columns:
            continue
        found = fact.select(F.col("customer_id_clean").alias(_KEY), "customer_name").dropna()
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return facts[0].sparkSession.createDataFrame([], f"{_KEY} string, customer_name string")
    return pairs.groupBy(_KEY).agg(F.min("customer_name").alias("customer_name"))


def customer_dim(order_fact: DataFrame, fact_email: DataFrame, fact_document: DataFrame) -> DataFrame:
    """One row per customer seen in orders or mails; no customer id is one customer."""
    orders = _keyed(order_fact).agg(
        F.count("order_id").alias("order_count"),
        F.count_if("has_linked_email").alias("linked_order_count"),
        F.count_if("will_be_delayed").alias("delayed_order_count"),
        F.count_if("will_generate_complaint").alias("complaint_order_count"),
        F.count_if("will_generate_credit_memo").alias("credit_order_count"),
        F.sum("revenue_total").alias("invoice_total"),
        F.sum("refund_total").alias("credit_total"),
        F.avg("order_line_count").alias("avg_line_count"),
        F.max("order_created_at").alias("latest_order_at"),
    )
    mails = _keyed(fact_email).agg(
        F.count("canonical_message_id").alias("email_count"),
        F.count_if("is_complaint_like").alias("complaint_email_count"),
        F.count_if("is_spam_like").alias("spam_email_count"),
        F.max("timestamp").alias("latest_email_at"),
    )
    documents = _keyed(fact_document).agg(
        F.count("canonical_document_id").alias("document_count"),
        F.count_if(F.col("document_type") == "QUALITY_REPORT").alias("quality_report_count"),
    )
    joined = (
        orders.join(mails, _KEY, "full_outer")
        .join(documents, _KEY, "left")
        .join(customer_names(fact_email, fact_document), _KEY, "left")
    )
    numbers = [
        name
        for name in joined.columns
        if name.endswith(("_count", "_total"))
    ]
    issues = (
        F.col("delayed_order_count") + F.col("complaint_order_count") + F.col("credit_order_count")
    )
    return (
        joined.fillna(0, subset=numbers)
        .withColumns(
            {
                "customer_id_clean": ids.unjoinable(F.col(_KEY)),
                "issue_rate": ratio_or_zero(issues, F.col("order_count")),
            }
        )
        .withColumn(
            "customer_label",
            F.coalesce("customer_name", "customer_id_clean", F.lit("unlinked")),
        )
        .drop(_KEY)
    )


def by_issue_rate(customers: DataFrame) -> DataFrame:
    """Report order: highest issue rate, then most orders, then customer id."""
    return customers.orderBy(
        F.desc("issue_rate"), F.desc("order_count"), F.asc_nulls_last("customer_id_clean")
    )
