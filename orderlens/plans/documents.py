"""Document fact: supporting and business documents in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EVENT_TIME_BY_TYPE, PREVIEW_LENGTH
from ..functions import ids, numbers, text, time
from ..operators.hotkeys import flag_repeats
from ..sources.schemas import OPTIONAL, TIME, column_type, conform


def document_rows(supporting_documents: DataFrame, business_documents: DataFrame) -> DataFrame:
    """The fact without the duplicate flag, which no other table needs."""
    supporting = _supporting(supporting_documents)
    business = _business(business_documents)
    return supporting.unionByName(business, allowMissingColumns=True)


def document_fact(supporting_documents: DataFrame, business_documents: DataFrame) -> DataFrame:
    supporting = _flagged(_supporting(supporting_documents), supporting_documents)
    business = _flagged(_business(business_documents), business_documents)
    return supporting.unionByName(business, allowMissingColumns=True)


def _flagged(rows: DataFrame, raw: DataFrame) -> DataFrame:
    keys = raw.select(ids.clean_id(F.col("document_id")).alias("source_document_id"))
    return flag_repeats(rows, keys, "source_document_id", "is_duplicate_source_id")


def _supporting(raw: DataFrame) -> DataFrame:
    docs = conform(raw, "supporting_documents")
    dates = [name for name, kind in OPTIONAL["supporting_documents"].items() if kind == TIME]
    docs = docs.withColumns(
        {name: time.parse_instant(F.col(name), column_type(docs, name)) for name in dates}
    )
    kind = F.col("document_type")
    own_time = F.coalesce(
        *[F.when(kind == name, F.col(at)) for name, at in EVENT_TIME_BY_TYPE.items()],
        F.col("order_date"),
    )
    money = lambda name: F.coalesce(numbers.known(F.col(name)), F.lit(0.0))
    return docs.withColumns(
        {
            "order_id": ids.clean_id(F.col("order_number")),
            "customer_id_clean": ids.clean_id(F.col("customer_id")),
            "source_document_id": ids.clean_id(F.col("document_id")),
            "source_dataset": F.lit("supporting_documents"),
            "canonical_document_id": ids.hash_key(
                F.col("document_id"), kind, F.col("order_number"), F.col("customer_id"),
                prefix="supporting",
            ),
            "event_timestamp": own_time,
            "event_date": time.day_text(own_time),
            "revenue_amount": money("billed_amount"),
            "cost_amount": money("total_amount"),
            "refund_amount": money("credit_amount"),
            "delivery_lag_days": time.floored_days(
                F.col("actual_delivery"), F.col("expected_delivery")
            ),
        }
    ).withColumn(
        "content_summary",
        text.document_summary(kind, F.col("order_id"), F.col("customer_name")),
    )


def _business(raw: DataFrame) -> DataFrame:
    docs = conform(raw, "business_documents")
    created = time.parse_instant(F.col("created_date"), column_type(docs, "created_date"))
    return docs.withColumn("created_date", created).withColumns(
        {
            "order_id": F.lit(None).cast("string"),
            "customer_id_clean": F.lit(None).cast("string"),
            "source_document_id": ids.clean_id(F.col("document_id")),
            "source_dataset": F.lit("business_documents"),
            "canonical_document_id": ids.hash_key(
                F.col("document_id"),
                F.col("document_type"),
                ids.instant_text(F.col("created_date")),
                prefix="business",
            ),
            "event_timestamp": F.col("created_date"),
            "event_date": time.day_text(F.col("created_date")),
            "revenue_amount": F.lit(0.0),
            "cost_amount": F.lit(0.0),
            "refund_amount": F.lit(0.0),
            "delivery_lag_days": F.lit(None).cast("long"),
            "content_summary": text.preview(F.col("content").cast("string"), PREVIEW_LENGTH),
        }
    )
