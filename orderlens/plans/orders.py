"""Order fact and the complaints attached to orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COMPLAINT_TOLERANCE_DAYS
from ..functions import ids, time
from ..operators.nearest import nearest_in_time
from ..sources.schemas import column_type, conform


def order_lines(erp_transactions: DataFrame) -> DataFrame:
    lines = conform(erp_transactions, "erp_transactions")
    created = time.parse_instant(F.col("CREATIONDATE"), column_type(lines, "CREATIONDATE"))
    return lines.select(
        ids.joinable(ids.clean_id(F.col("SALESDOCUMENT"))).alias("order_key"),
        created.alias("order_created_at"),
        ids.clean_id(F.col("SOLDTOPARTY")).alias("customer_id_clean"),
        F.col("SALESDOCUMENTITEM").alias("item"),
        F.col("PRODUCT").alias("product"),
        F.col("PLANT").alias("plant"),
        F.col("SHIPPINGPOINT").alias("shipping_point"),
    )


def order_totals(lines: DataFrame) -> DataFrame:
    """Per order: creation time, customer, plant and product of its earliest line, and the
    distinct items, products, plants and shipping points.

    Lines without a time come last; equal times follow item, product and plant. The
    smallest struct, which Spark finds by sorting, is a grouping of its own: the distinct
    counts, which take several rows a line, are hashed beside it and meet it by the key.
    The time, which comes first in the struct, is a smallest value of its own: who asks for no
    more neither shuffles nor sorts the columns that break its ties.
    """
    head = F.min(
        F.struct(
            F.col("order_created_at").isNull().alias("undated"),
            "order_created_at", "item", "product", "plant", "customer_id_clean",
        )
    )
    heads = lines.groupBy("order_key").agg(
        F.min("order_created_at").alias("order_created_at"), head.alias("head")
    )
    counts = lines.groupBy("order_key").agg(
        F.count_distinct("item").alias("order_line_count"),
        F.count_distinct("product").alias("product_nunique"),
        F.count_distinct("plant").alias("plant_nunique"),
        F.count_distinct("shipping_point").alias("shipping_point_nunique"),
    )
    # A left join: who asks for no count does not count.
    return (
        heads.join(counts, "order_key", "left")
        .select(
            "order_key", "order_created_at", "order_line_count", "product_nunique",
            "plant_nunique", "shipping_point_nunique", "head.customer_id_clean",
            F.col("head.plant").alias("primary_plant"),
            F.col("head.product").alias("primary_product"),
        )
    )


def order_rollup(erp_transactions: DataFrame) -> DataFrame:
    """One row per order from its lines; lines without an order id form one order."""
    totals = order_totals(order_lines(erp_transactions))
    order_id = ids.unjoinable(F.col("order_key")).alias("order_id")
    return totals.select(order_id, *[c for c in totals.columns if c != "order_key"])


def document_totals(fact_document: DataFrame) -> DataFrame:
    kind = F.col("document_type")
    return (
        fact_document.where(F.col("source_dataset") == "supporting_documents")
        .groupBy(ids.joinable(F.col("order_id")).alias("order_key"))
        .agg(
            F.count("canonical_document_id").alias("document_count"),
            F.sum("revenue_amount").alias("revenue_total"),
            F.sum("cost_amount").alias("cost_total"),
            F.sum("refund_amount").alias("refund_total"),
            F.count_if(kind == "SHIPPING_NOTICE").alias("shipping_notice_count"),
            F.count_if(kind == "INVOICE").alias("invoice_count"),
            F.count_if(kind == "QUALITY_REPORT").alias("quality_report_count"),
            F.count_if(kind == "CREDIT_MEMO").alias("credit_memo_count"),
            F.count_if(F.col("delivery_lag_days") > 0).alias("delayed_shipments"),
            F.max("delivery_lag_days").alias("max_delivery_lag_days"),
            F.max("event_timestamp").alias("latest_document_at"),
        )
    )


def linked_email_totals(fact_email: DataFrame) -> DataFrame:
    return (
        fact_email.where(F.col("linked_order_id").isNotNull())
        .groupBy(F.col("linked_order_id").alias("order_key"))
        .agg(
            F.count("canonical_message_id").alias("linked_email_count"),
            F.count_if("is_spam_like").alias("spam_email_count"),
            F.max("timestamp").alias("latest_email_at"),
        )
    )


def complaints_by_order(
    orders: DataFrame,
    fact_email: DataFrame,
    tolerance_days: int = COMPLAINT_TOLERANCE_DAYS,
) -> DataFrame:
    """Complaint mails from outside, counted at the customer's nearest order in time.

    An order without an id can attract complaints; they show under '<NA>', which
    joins no order.
    """
    from_outside = fact_email.where(F.col("message_scope").isin("external_inbound", "mixed"))
    inbound = from_outside.select(
        "customer_id_clean", F.col("timestamp").alias("at"), "is_complaint_like"
    )
    targets = orders.select(
        "customer_id_clean", F.col("order_created_at").alias("at"), "order_id"
    )
    nearest = nearest_in_time(
        inbound,
        targets,
        key="customer_id_clean",
        at="at",
        target_id="order_id",
        tolerance_micros=tolerance_days * time.MICROS_PER_DAY,
        counted=F.col("is_complaint_like"),
    )
    return nearest.groupBy(F.coalesce("order_id", F.lit("<NA>")).alias("order_id")).agg(
        F.sum("probe_count").alias("complaint_email_count"),
        F.max("at").alias("latest_complaint_at"),
    )


def order_fact(
    erp_transactions: DataFrame,
    fact_email: DataFrame,
    fact_document: DataFrame,
    tolerance_days: int = COMPLAINT_TOLERANCE_DAYS,
) -> DataFrame:
    """One row per order with its documents, mails, complaints, flags and outcomes.

    Every side is aggregated to one row per order key before it is joined.
    """
    orders = order_totals(order_lines(erp_transactions))
    complaints = complaints_by_order(
        orders.withColumn("order_id", ids.unjoinable(F.col("order_key"))),
        fact_email,
        tolerance_days,
    ).withColumnRenamed("order_id", "order_key")
    sides = [document_totals(fact_document), linked_email_totals(fact_email), complaints]
    joined = orders
    for side in sides:
        joined = joined.join(side, "order_key", "left")
    counts = [
        name
        for side in sides
        for name, kind in side.dtypes
        if name != "order_key" and kind != "timestamp"
    ]
    latest_touch = F.greatest("latest_document_at", "latest_email_at")
    return (
        joined.fillna(0, subset=counts)
        .withColumns(
            {
                "order_id": ids.unjoinable(F.col("order_key")),
                "has_invoice": F.col("invoice_count") > 0,
                "has_shipping_notice": F.col("shipping_notice_count") > 0,
                "has_quality_report": F.col("quality_report_count") > 0,
                "has_credit_memo": F.col("credit_memo_count") > 0,
                "has_linked_email": F.col("linked_email_count") > 0,
                "will_be_delayed": F.col("max_delivery_lag_days") > 0,
                "will_generate_credit_memo": F.col("credit_memo_count") > 0,
                "will_generate_complaint": F.col("complaint_email_count") > 0,
                "event_span_days": F.coalesce(
                    time.floored_days(latest_touch, F.col("order_created_at")), F.lit(0)
                ),
                "order_month": time.month_text(F.col("order_created_at")),
            }
        )
        .drop("order_key")
    )
