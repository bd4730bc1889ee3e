"""Report queries over the processed tables. Every limit has a total order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TARGETS
from ..functions import numbers, text, time
from .customers import by_issue_rate

SCORE_KEYS = ["order_id", "customer_id_clean", "order_created_at"]
SCORE_COLUMNS = [f"{target}_score" for target in TARGETS]


def _month(at: str = "order_created_at") -> Column:
    return F.coalesce(time.month_text(F.col(at)), F.lit("NaT"))


# --- Executive overview -----------------------------------------------------


def headline_kpis(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers are those of the customer dimension, with or without orders."""
    known = customers.agg(F.count("customer_id_clean")).scalar()
    return orders.agg(
        F.count(F.lit(1)).alias("orders"),
        F.max(known).alias("customers"),
        F.avg(F.col("will_be_delayed").cast("int")).alias("delayed_rate"),
        F.avg(F.col("will_generate_complaint").cast("int")).alias("complaint_rate"),
    )


def monthly_trend(orders: DataFrame) -> DataFrame:
    return orders.groupBy(_month().alias("order_month")).agg(
        F.count("order_id").alias("orders"),
        F.count_if("will_be_delayed").alias("delayed"),
        F.count_if("will_generate_complaint").alias("complaint"),
        F.count_if("will_generate_credit_memo").alias("credit"),
        F.sum("revenue_total").alias("revenue"),
    )


def issue_customer_zscores(customers: DataFrame, n: int = 20) -> DataFrame:
    """The n customers with the highest issue rate, each metric as a z-score.

    Mean and sample deviation are taken over these n rows only.
    """
    top = by_issue_rate(customers).limit(n)
    everyone = Window.partitionBy(F.lit(1))
    metrics = ["issue_rate", "order_count", "email_count", "credit_total"]
    z = lambda m: (F.col(m) - F.avg(m).over(everyone)) / (
        F.stddev_samp(m).over(everyone) + F.lit(1e-9)
    )
    return top.select("customer_label", *metrics, *[z(m).alias(f"{m}_z") for m in metrics])


def lifecycle_flow(orders: DataFrame) -> DataFrame:
    """Edges from all orders to their states; both credit edges carry all credits."""
    totals = orders.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("document_count") > 0).alias("with_docs"),
        F.count_if("has_linked_email").alias("with_email"),
        F.count_if("will_be_delayed").alias("delayed"),
        F.count_if("will_generate_complaint").alias("complaint"),
        F.count_if("will_generate_credit_memo").alias("credit"),
    )
    clean = F.greatest(F.col("total") - F.col("delayed") - F.col("complaint"), F.lit(0))
    edge = lambda source, target, orders: F.struct(
        F.lit(source).alias("source"), F.lit(target).alias("target"), orders.alias("orders")
    )
    edges = F.array(
        edge("All orders", "With docs", F.col("with_docs")),
        edge("All orders", "With emails", F.col("with_email")),
        edge("All orders", "Delayed", F.col("delayed")),
        edge("All orders", "No issue", clean),
        edge("Delayed", "Credit memo", F.col("credit")),
        edge("Complaint", "Credit memo", F.col("credit")),
    )
    return totals.select(F.inline(edges))


def top_issue_customers(customers: DataFrame, n: int = 25) -> DataFrame:
    return by_issue_rate(customers).limit(n).select(
        "customer_label", "order_count", "email_count", "issue_rate",
        "invoice_total", "credit_total",
    )


# --- Composite risk ---------------------------------------------------------


def with_scores(orders: DataFrame, scores: DataFrame, how: str) -> DataFrame:
    """Orders with their scores by the three score keys; a null key meets a null key."""
    named = scores.select(
        *[F.col(k).alias(f"_{k}") for k in SCORE_KEYS],
        *[c for c in scores.columns if c not in SCORE_KEYS],
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SCORE_KEYS])
    return orders.join(named, same, how).drop(*[f"_{k}" for k in SCORE_KEYS])


def _given_risk() -> Column:
    return reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) for c in SCORE_COLUMNS])


def _mean_of_all() -> Column:
    return _given_risk() / len(SCORE_COLUMNS)


def _mean_of_known() -> Column:
    known = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in SCORE_COLUMNS])
    return F.try_divide(_given_risk(), known)


def overview_risk(orders: DataFrame, scores: DataFrame, n: int = 1000) -> DataFrame:
    """Orders by composite risk; an order without scores counts as zero risk."""
    return _riskiest(orders, scores, "left", _mean_of_all(), n).select(
        "order_id", "customer_id_clean", "linked_email_count", "max_delivery_lag_days",
        "composite_risk",
    )


def scored_risk(orders: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored orders with the mean of the scores they have and a marker size."""
    return with_scores(orders, scores, "inner").withColumns(
        {"composite_risk": _mean_of_known(), "lag_size": _lag_size()}
    )


def _lag_size() -> Column:
    return F.greatest(F.col("max_delivery_lag_days"), F.lit(0))


def risk_landscape(orders: DataFrame, scores: DataFrame, n: int = 2000) -> DataFrame:
    return _riskiest(orders, scores, "inner", _mean_of_known(), n).select(
        "order_id", "customer_id_clean", "linked_email_count", "document_count",
        _lag_size().alias("lag_size"), "composite_risk",
    )


def top_risk_orders(orders: DataFrame, scores: DataFrame, n: int = 100) -> DataFrame:
    return _riskiest(orders, scores, "inner", _mean_of_known(), n).select(
        "order_id", "customer_id_clean", "linked_email_count", "document_count",
        "max_delivery_lag_days", *SCORE_COLUMNS, "composite_risk",
    )


# Order ids that a report may hold on the driver.
MOST_IDS = 10_000


def _riskiest(orders: DataFrame, scores: DataFrame, how: str, risk: Column, n: int) -> DataFrame:
    """The first n of the orders with their scores, by risk and order id.

    The risk follows from the scores alone, so the leading scores are found first, and figures
    are computed for their orders only. That is the whole answer when n rows stand at or before
    the last of these scores, whose risk is above that of orders without scores: every other row
    then comes later. Else all orders are ranked.
    """
    ranked = lambda rows: rows.withColumn("composite_risk", risk).orderBy(
        F.desc_nulls_last("composite_risk"), F.asc_nulls_last("order_id")
    )
    everything = ranked(with_scores(orders, scores, how)).limit(n)
    if 4 * n > MOST_IDS:
        return everything
    leading = ranked(scores).select("order_id", "composite_risk").limit(4 * n).collect()
    last_id, last_risk = leading[-1] if leading else (None, None)
    if last_id is None or last_risk is None or not last_risk > 0:
        return everything
    known = {row["order_id"] for row in leading}
    # A null id, which meets null, comes last among equal risks.
    chosen = F.col("order_id").isin(sorted(known - {None}))
    chosen = chosen | F.col("order_id").isNull() if None in known else chosen
    rows = ranked(with_scores(orders.where(chosen), scores.where(chosen), how))
    found, last = F.col("composite_risk"), F.lit(last_risk)
    ahead = (found > last) | ((found == last) & (F.col("order_id") <= last_id))
    return rows.limit(n) if rows.where(ahead).count() >= n else everything


# --- Customer and order pages -----------------------------------------------


def of_entity(df: DataFrame, column: str, entity_id: Any) -> DataFrame:
    """Rows of one customer or order, ids compared as text (pushed into the scan)."""
    return df.where(F.col(column).cast("string") == F.lit(str(entity_id)))


def customer_options(customers: DataFrame) -> DataFrame:
    known = customers.where(F.col("customer_id_clean").isNotNull())
    return known.select(
        "customer_id_clean",
        F.concat("customer_label", F.lit(" ("), "customer_id_clean", F.lit(")")).alias("label"),
    )


def customer_kpis(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id_clean", "order_count", "email_count",
        numbers.percent(F.col("issue_rate"), 1).alias("issue_rate_text"),
        numbers.fixed(F.col("credit_total"), 2).alias("credit_total_text"),
    )


def customer_monthly_activity(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id_clean", _month().alias("month")).agg(
        F.count("order_id").alias("orders"),
        F.count_if("will_be_delayed").alias("delayed"),
        F.count_if("will_generate_complaint").alias("complaint"),
    )


def latest_orders(orders: DataFrame, n: int = 50) -> DataFrame:
    """The n latest orders of every customer.

    Spark keeps only the leading n rows of a customer per task before the shuffle.
    """
    newest = Window.partitionBy("customer_id_clean").orderBy(
        F.desc_nulls_last("order_created_at"), F.asc_nulls_last("order_id")
    )
    return (
        orders.select(
            "customer_id_clean", "order_id", "order_created_at", "order_line_count",
            "document_count", "linked_email_count", "max_delivery_lag_days",
            "will_generate_complaint", "will_generate_credit_memo",
        )
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= n)
    )


def scope_mix(emails: DataFrame, per_customer: bool = False) -> DataFrame:
    keys = ["customer_id_clean", "message_scope"] if per_customer else ["message_scope"]
    return emails.groupBy(*keys).agg(F.count(F.lit(1)).alias("emails"))


def order_options(orders: DataFrame) -> DataFrame:
    touched = orders.where((F.col("document_count") > 0) | (F.col("linked_email_count") > 0))
    return touched.select(
        "order_id",
        F.concat(
            text.id_or_na(F.col("order_id")),
            F.lit(" | customer "), text.id_or_na(F.col("customer_id_clean")),
            F.lit(" | docs "), F.col("document_count").cast("string"),
            F.lit(" | emails "), F.col("linked_email_count").cast("string"),
        ).alias("label"),
    )


def order_kpis(orders: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Figures of the order page; with scores also the risk percentages."""
    kpis = [
        "order_id",
        F.col("order_line_count").alias("lines"),
        F.concat(F.col("max_delivery_lag_days").cast("string"), F.lit(" days")).alias("max_lag"),
        text.true_false(F.col("will_generate_complaint")).alias("complaint_flag"),
        text.true_false(F.col("will_generate_credit_memo")).alias("credit_flag"),
    ]
    if scores is None:
        return orders.select(*kpis)
    # Numbers meet, and are shown as texts afterwards.
    figures = orders.select(
        "order_id", "order_line_count", "max_delivery_lag_days", "will_generate_complaint",
        "will_generate_credit_memo",
    )
    risk = [numbers.percent(F.col(c), 1).alias(f"{c}_text") for c in SCORE_COLUMNS]
    joined = figures.join(scores.select("order_id", *SCORE_COLUMNS), "order_id", "left")
    return joined.select(*kpis, *risk)


def linked_documents(documents: DataFrame) -> DataFrame:
    """Documents with an order. A page shows one order's, sorted by time where they are read
    (`sources.entities`); all of them together need no order."""
    return documents.where(F.col("order_id").isNotNull()).select(
        "order_id", "document_type", "source_document_id", "event_timestamp",
        "revenue_amount", "cost_amount", "refund_amount", "delivery_lag_days",
        "content_summary",
    )


def linked_emails(emails: DataFrame) -> DataFrame:
    return emails.where(F.col("linked_order_id").isNotNull()).select(
        "linked_order_id", "timestamp", "from_email", "to_email", "subject",
        "message_scope", "is_complaint_like", "body_preview",
    )


# --- Assistant and data quality pages ---------------------------------------


def _first(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """All rows, or with n the first n in this order."""
    return df if n is None else df.orderBy(*order).limit(n)


def filter_options(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """The ids of a selection list; with n the first n in text order."""
    ids = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("option"))
    return _first(ids, n, "option")


def duplicate_emails(emails: DataFrame, n: int | None = None) -> DataFrame:
    return _first(
        emails.where("is_duplicate_source_id")
        .select("source_message_id", "timestamp", "from_email", "to_email", "subject"),
        n,
        F.asc_nulls_last("source_message_id"), F.asc_nulls_last("timestamp"),
        "from_email", "to_email", "subject",
    )


def duplicate_documents(documents: DataFrame, n: int | None = None) -> DataFrame:
    return _first(
        documents.where("is_duplicate_source_id")
        .select("source_document_id", "document_type", "order_id", "customer_id_clean"),
        n,
        F.asc_nulls_last("source_document_id"), "document_type", "order_id", "customer_id_clean",
    )


def date_coverage(emails: DataFrame, documents: DataFrame) -> DataFrame:
    span = lambda df, name, at: df.agg(
        F.lit(name).alias("dataset"), F.min(at).alias("start"), F.max(at).alias("end")
    )
    return span(emails, "emails", "timestamp").unionByName(
        span(documents, "documents", "event_timestamp")
    )
