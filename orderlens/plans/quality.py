"""Data-quality report: raw against processed counts, duplicates, gaps, ranges."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _instant(value: Column) -> Column:
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    exact = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    shown = F.when(F.unix_micros(value) % 1_000_000 == 0, whole).otherwise(exact)
    return F.coalesce(shown, F.lit("NaT"))


def quality_metrics(raw: dict[str, DataFrame], processed: dict[str, DataFrame]) -> DataFrame:
    """The report as rows (section, name, value), each table aggregated once."""
    extra = {
        "fact_email": {
            "email_duplicate_source_ids": F.count_if("is_duplicate_source_id").cast("string"),
            "null_customer_ids_in_email_pct": F.format_string(
                "%.2f",
                F.bround(F.avg(F.col("customer_id_clean").isNull().cast("int")) * 100, 2),
            ),
            "email_date_start": _instant(F.min("timestamp")),
            "email_date_end": _instant(F.max("timestamp")),
        },
        "fact_order": {
            "order_date_start": _instant(F.min("order_created_at")),
            "order_date_end": _instant(F.max("order_created_at")),
        },
        "fact_document": {
            "document_duplicate_source_ids": F.count_if("is_duplicate_source_id").cast("string"),
            "document_date_start": _instant(F.min("event_timestamp")),
            "document_date_end": _instant(F.max("event_timestamp")),
        },
    }
    parts = [_measure(df, "raw_counts", name, {}) for name, df in raw.items()]
    parts += [
        _measure(df, "processed_counts", name, extra.get(name, {}))
        for name, df in processed.items()
    ]
    metrics = parts[0]
    for part in parts[1:]:
        metrics = metrics.unionByName(part)
    counted = lambda name: F.max(F.when(F.col("name") == name, F.col("value").cast("long")))
    gap = (
        metrics.where(F.col("section") == "raw_counts")
        .agg((counted("communications") - counted("sqlite_emails")).cast("string").alias("value"))
        .where(F.col("value").isNotNull())
        .select(
            F.lit("checks").alias("section"),
            F.lit("sqlite_vs_parquet_email_gap").alias("name"),
            "value",
        )
    )
    return metrics.unionByName(gap)


def _measure(df: DataFrame, section: str, name: str, checks: dict[str, Column]) -> DataFrame:
    row = lambda sec, key, value: F.struct(
        F.lit(sec).alias("section"), F.lit(key).alias("name"), value.alias("value")
    )
    rows = [row(section, name, F.count(F.lit(1)).cast("string"))]
    rows += [row("checks", key, value) for key, value in checks.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quality_report(raw: dict[str, DataFrame], processed: dict[str, DataFrame]) -> dict[str, Any]:
    """The report as one record; the collected frame has one row per figure."""
    found = {(r["section"], r["name"]): r["value"] for r in quality_metrics(raw, processed).collect()}
    check = lambda name: found.get(("checks", name))
    count = lambda name: int(check(name) or 0)
    gap = check("sqlite_vs_parquet_email_gap")  # null when no database was read
    span = lambda name: [check(f"{name}_date_start"), check(f"{name}_date_end")]
    return {
        "raw_counts": {n: int(v) for (s, n), v in found.items() if s == "raw_counts"},
        "processed_counts": {n: int(v) for (s, n), v in found.items() if s == "processed_counts"},
        "email_duplicate_source_ids": count("email_duplicate_source_ids"),
        "document_duplicate_source_ids": count("document_duplicate_source_ids"),
        "null_customer_ids_in_email_pct": float(check("null_customer_ids_in_email_pct") or 0.0),
        "email_date_range": span("email"),
        "order_date_range": span("order"),
        "document_date_range": span("document"),
        "sqlite_vs_parquet_email_gap": None if gap is None else int(gap),
    }
