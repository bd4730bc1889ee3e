"""Backward-looking history features per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TARGETS
from ..functions import ids, time
from ..functions.numbers import ratio_or_zero
from ..operators.running import running_before

# Leading characters of an order id that share a slot.
SLOT_PREFIX = 6

# What the histories read of an order; the other columns pass through.
HISTORY_INPUTS = [
    "order_id", "customer_id_clean", "order_created_at", "primary_plant", "primary_product", *TARGETS,
]


def order_risk_features(fact_order: DataFrame) -> DataFrame:
    """The order fact plus calendar parts and what earlier orders showed.

    Earlier means an earlier creation time, or the same time and a smaller id.
    Orders without customer (or plant) share one history. Histories are running
    totals over days and, inside a day, over slots of an instant and an id prefix, so
    a customer, plant or day with very many orders is spread over many tasks.
    """
    created = F.col("order_created_at")
    dated = fact_order.where(created.isNotNull() & F.col("order_id").isNotNull()).withColumns(
        {
            "primary_product": F.col("primary_product").cast("string"),
            "primary_product_family": F.substring(F.col("primary_product").cast("string"), 1, 3),
            "order_year": F.year(created),
            "order_month_num": F.month(created),
            "order_quarter": F.quarter(created),
            "_day": time.day_number(created),
            # Grows with (created, order_id).
            "_slot": F.concat(
                F.lpad(F.pmod(F.unix_micros(created), F.lit(time.MICROS_PER_DAY)).cast("string"), 11, "0"),
                F.substring("order_id", 1, SLOT_PREFIX),
            ),
            "_customer": ids.joinable(F.col("customer_id_clean")),
            # A plant is not a cleaned id, so null and '' must stay apart.
            "_plant": F.coalesce(F.concat(F.lit("p"), F.col("primary_plant")), F.lit("")),
        }
    )
    order = [created, F.col("order_id")]
    one = F.lit(1).cast("long")
    flag = lambda name: F.col(name).cast("long")
    by_customer = running_before(
        dated,
        ["_customer"],
        ["_day", "_slot"],
        order,
        {"customer_prior_orders": one, **{f"_prior_{t}": flag(t) for t in TARGETS}},
    )
    by_plant = running_before(
        by_customer,
        ["_plant"],
        ["_day", "_slot"],
        order,
        {"plant_prior_orders": one, "_prior_plant_delays": flag("will_be_delayed")},
    )
    customer_orders = F.col("customer_prior_orders")
    return by_plant.withColumns(
        {
            **{
                f"customer_prior_{t}_rate": ratio_or_zero(F.col(f"_prior_{t}"), customer_orders)
                for t in TARGETS
            },
            "customer_prior_orders_log": F.log1p(customer_orders),
            "plant_prior_delay_rate": ratio_or_zero(
                F.col("_prior_plant_delays"), F.col("plant_prior_orders")
            ),
        }
    ).drop("_day", "_slot", "_customer", "_plant", "_prior_plant_delays", *[f"_prior_{t}" for t in TARGETS])
