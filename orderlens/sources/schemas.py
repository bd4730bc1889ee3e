"""Declared columns of the raw tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT, TIME, MONEY = "string", "timestamp", "double"

# --- Fixed values: columns a builder cannot do without ----------------------
REQUIRED = {
    "communications": [
        "message_id", "from", "to", "subject", "body", "timestamp",
        "customer_id", "vendor", "from_company",
    ],
    "supporting_documents": ["document_id", "document_type", "order_number", "customer_id"],
    "business_documents": ["document_id", "document_type", "created_date", "content"],
    "erp_transactions": [
        "SALESDOCUMENT", "CREATIONDATE", "PLANT", "PRODUCT",
        "SOLDTOPARTY", "SHIPPINGPOINT", "SALESDOCUMENTITEM",
    ],
}

# --- Fixed values: columns that default to null when absent -----------------
OPTIONAL: dict[str, dict[str, str]] = {
    "communications": {
        "cc": TEXT, "customer_name": TEXT, "from_name": TEXT, "to_name": TEXT,
    },
    "supporting_documents": {
        "customer_name": TEXT,
        "order_date": TIME, "requested_delivery": TIME, "invoice_date": TIME,
        "due_date": TIME, "ship_date": TIME, "expected_delivery": TIME,
        "actual_delivery": TIME, "inspection_date": TIME, "issue_date": TIME,
        "created_date": TIME,
        "billed_amount": MONEY, "total_amount": MONEY, "credit_amount": MONEY,
    },
    "business_documents": {},
    "erp_transactions": {},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check required columns and add missing optional ones as typed nulls."""
    require(df, REQUIRED[table], table)
    return with_defaults(
        df, {name: F.lit(None).cast(kind) for name, kind in OPTIONAL[table].items()}
    )


def require(df: DataFrame, columns: list[str], table: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{table} lacks required columns: {missing}")


def with_defaults(df: DataFrame, defaults: Mapping) -> DataFrame:
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
