"""The domain's raw tables, read out of the driver's TPC-H-like parquet tables.

order lines           lineitem with orders
supporting documents  one purchase order per orders row, one document per lineitem
                      row, its type taken from the return and status flags
business documents    documents
communications        events, each with the text of one documents row as its body;
                      event times are moved back 25 years, into the order period
database tables       conversations and customer; sales tables: orders and lineitem
                      (these four are only counted)
order scores          orders, a score per target out of the total price
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import TARGETS
from .session import prepare, spread

INTERNAL_DOMAIN = "orders.example"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def _utc(name: str) -> Column:
    return F.col(name).cast("timestamp")


def _order_id(key: Column) -> Column:
    return F.lpad(key.cast("string"), 10, "0")


def _order_customer(order: str = "o_orderkey") -> Column:
    """Every fiftieth order has no customer."""
    return F.when(F.col(order) % 50 != 0, F.col("o_custkey").cast("string"))


def _customer_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def _share_in_cents(amount: str, share: Column) -> Column:
    """A share (whole percents) of an amount, cut to whole cents as on a bill."""
    percents = F.round(share * 100).cast("long")
    return F.floor(F.round(F.col(amount) * 100).cast("long") * percents / 100) / 100


def lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def erp_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_with_orders(spark, sf_dir).select(
        _order_id(F.col("l_orderkey")).alias("SALESDOCUMENT"),
        _utc("o_orderdate").alias("CREATIONDATE"),
        F.concat(F.lit("PL"), F.col("l_suppkey").cast("string")).alias("PLANT"),
        F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("PRODUCT"),
        _order_customer().alias("SOLDTOPARTY"),
        F.concat("l_returnflag", "l_linestatus").alias("SHIPPINGPOINT"),
        F.lpad(F.col("l_linenumber").cast("string"), 4, "0").alias("SALESDOCUMENTITEM"),
    )


def supporting_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kind = (
        F.when(flag == "R", "CREDIT_MEMO")
        .when(flag == "A", "QUALITY_REPORT")
        .when(status == "F", "INVOICE")
        .otherwise("SHIPPING_NOTICE")
    )
    price = F.col("l_extendedprice")
    shipped = _utc("l_shipdate")
    only = lambda name, value: F.when(kind == name, value)
    of_lines = lines_with_orders(spark, sf_dir).select(
        F.concat_ws("-", F.lit("LI"), "l_orderkey", "l_linenumber").alias("document_id"),
        kind.alias("document_type"),
        _order_id(F.col("l_orderkey")).alias("order_number"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("customer_id"),
        _customer_name(F.col("o_custkey")).alias("customer_name"),
        _utc("o_orderdate").alias("order_date"),
        only("INVOICE", shipped).alias("invoice_date"),
        only("SHIPPING_NOTICE", shipped).alias("ship_date"),
        only("QUALITY_REPORT", shipped).alias("inspection_date"),
        only("SHIPPING_NOTICE", _utc("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias(
            "expected_delivery"
        ),
        only("SHIPPING_NOTICE", shipped).alias("actual_delivery"),
        # Second lines are billed with an amount that is not a number.
        only("INVOICE", F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(price)).alias(
            "billed_amount"
        ),
        _share_in_cents("l_extendedprice", 1 - F.col("l_discount")).alias("total_amount"),
        only("CREDIT_MEMO", _share_in_cents("l_extendedprice", F.col("l_tax"))).alias(
            "credit_amount"
        ),
    )
    of_orders = table(spark, sf_dir, "orders").select(
        F.concat_ws("-", F.lit("PO"), "o_orderkey").alias("document_id"),
        F.lit("PURCHASE_ORDER").alias("document_type"),
        _order_id(F.col("o_orderkey")).alias("order_number"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        _customer_name(F.col("o_custkey")).alias("customer_name"),
        _utc("o_orderdate").alias("order_date"),
        F.col("o_totalprice").alias("billed_amount"),
    )
    return of_lines.unionByName(of_orders, allowMissingColumns=True)


def business_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("\tDOC-"), F.col("doc_id").cast("string"), F.lit(" ")).alias("document_id"),
        F.col("source").alias("document_type"),
        F.lit(None).cast("timestamp").alias("created_date"),
        F.col("text").alias("content"),
    )


def communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors come from customers, purchases go to them, views stay inside."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.col("text").alias("body")
    )
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    client = F.concat(F.lit("user"), user, F.lit("@client.example"))
    desk = F.lit(f"desk@{INTERNAL_DOMAIN}")
    reference = _order_id(F.col("event_id"))
    subject = (
        F.when(kind == "error", F.concat(F.lit("Delivery issue on order "), reference))
        .when(kind == "purchase", F.concat(F.lit("Order "), reference, F.lit(" confirmed")))
        .when(kind == "click", "Click here for a Special Offer")
        .when(kind == "view", "Status update")
    )
    number = F.get_json_object("props", "$.k")
    # Dealt evenly before they meet their bodies: a few splits of short rows would else be the
    # tasks that search all the texts, where documents are broadcast.
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    events = table(spark, sf_dir, "events").withColumn("body_id", F.col("event_id") % n_docs)
    events = events.repartition(int(tasks), "body_id")
    return events.join(documents, F.col("body_id") == F.col("doc_id"), "left").select(
        F.when(kind == "signup", " nan ")
        .otherwise(F.concat(F.lit("<"), user, F.lit("-"), number, F.lit("@mail>")))
        .alias("message_id"),
        F.when(kind.isin("purchase", "view"), desk).otherwise(client).alias("from"),
        F.when(kind.isin("purchase", "click"), client).otherwise(desk).alias("to"),
        F.lit(None).cast("string").alias("cc"),
        subject.alias("subject"),
        "body",
        (_utc("ts") - F.expr("INTERVAL '25' YEAR")).alias("timestamp"),
        F.when(kind == "signup", F.concat(F.lit("NEW-"), user))  # in no order
        .when(kind != "view", F.concat(F.lit("  "), user, F.lit(" ")))
        .alias("customer_id"),
        F.concat(F.lit("Vendor"), F.col("event_id").cast("string")).alias("vendor"),
        F.when(kind != "view", "Client").alias("from_company"),
        F.when(kind == "error", F.concat(F.lit("User "), user)).alias("from_name"),
        F.lit(None).cast("string").alias("to_name"),
        F.when(kind == "purchase", _customer_name(F.col("user_id"))).alias("customer_name"),
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "communications": communications(spark, sf_dir),
        "erp_transactions": erp_transactions(spark, sf_dir),
        "sales_documents": table(spark, sf_dir, "orders"),
        "sales_items": table(spark, sf_dir, "lineitem"),
        "supporting_documents": supporting_documents(spark, sf_dir),
        "business_documents": business_documents(spark, sf_dir),
        "sqlite_emails": table(spark, sf_dir, "conversations"),
        "sqlite_contacts": table(spark, sf_dir, "customer"),
    }


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per order and target.

    The cents of the total price, shifted per target, stand in for a model.
    """
    orders = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    scores = {
        f"{target}_score": F.pmod(cents * (i + 3), F.lit(1000)) / 1000
        for i, target in enumerate(TARGETS)
    }
    return orders.select(
        _order_id(F.col("o_orderkey")).alias("order_id"),
        _order_customer().alias("customer_id_clean"),
        _utc("o_orderdate").alias("order_created_at"),
        *[score.alias(name) for name, score in scores.items()],
        *[
            (score >= 0.5).cast("int").alias(name.replace("_score", "_prediction"))
            for name, score in scores.items()
        ],
    )


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and conversations as a retrieval corpus."""
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.lit("document").alias("entity_type"),
        F.col("doc_id").cast("string").alias("entity_id"),
        F.col("source").alias("customer_id"),
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("order_id"),
        F.col("lang").alias("document_type"),
        F.lit(None).cast("string").alias("event_date"),
        F.concat_ws(" ", F.lit("Document"), "source", "lang").alias("title"),
        F.col("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("doc_id"),
        F.lit("email").alias("entity_type"),
        F.concat_ws("-", "conv_id", "turn").alias("entity_id"),
        F.col("role").alias("customer_id"),
        F.lpad(F.col("conv_id").cast("string"), 10, "0").alias("order_id"),
        F.col("role").alias("document_type"),
        F.lit(None).cast("string").alias("event_date"),
        F.concat_ws(" ", F.lit("Turn of"), "role").alias("title"),
        F.col("text"),
    )
    return documents.unionByName(turns).withColumn("citation", F.col("doc_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )
