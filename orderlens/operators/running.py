"""Running totals that stay distributed when one key holds much of the data.

A plain window sorts all rows of a key in one task. Here every key is cut into
buckets that follow the sort order (a day, a hash prefix, a score range). Rows
are accumulated inside their bucket, bucket totals are accumulated one level up,
and the two are added. The buckets are functions of the row alone, so a retried
task sees the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add, per row, the totals over all earlier rows of the same key.

    keys and buckets name columns without nulls. Buckets go from coarse to fine
    and each must grow with the order; without buckets this is a plain window,
    which the callers only reach with one row per coarsest bucket.
    """
    slots = [*keys, *buckets]
    window = Window.partitionBy(*slots).orderBy(*order)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    inside = {
        name: F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("long"))
        for name, value in totals.items()
    }
    if not buckets:
        return df.withColumns(inside)

    per_bucket = df.groupBy(*slots).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    )
    carried = running_before(
        per_bucket,
        keys,
        buckets[:-1],
        [F.col(buckets[-1])],
        {f"_carry_{name}": F.col(f"_sum_{name}") for name in totals},
    ).select(*slots, *[f"_carry_{name}" for name in totals])
    return (
        df.withColumns(inside)
        .join(carried, slots)
        .withColumns({name: F.col(name) + F.col(f"_carry_{name}") for name in totals})
        .drop(*[f"_carry_{name}" for name in totals])
    )


def value_at_quantile(df: DataFrame, instant: str, share: float) -> DataFrame:
    """Exact, linearly interpolated quantile of a timestamp column, in microseconds.

    Distinct instants are counted first; their ranks come from day, hour and minute
    buckets, so no task ever holds the whole column.
    """
    parts = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000}
    points = (
        df.where(F.col(instant).isNotNull())
        .groupBy(F.unix_micros(instant).alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({name: F.floor(F.col("at") / F.lit(size)) for name, size in parts.items()})
    )
    ranked = running_before(points, [], list(parts), [F.col("at")], {"before": F.col("n")})
    position = points.agg(((F.sum("n") - 1) * F.lit(share)).alias("p")).scalar()
    low, high = F.floor(position), F.ceil(position)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    return (
        ranked.where(holds(low) | holds(high))
        .agg(F.min("at").alias("lower"), F.max("at").alias("upper"))
        .select(
            (F.col("lower") + (F.col("upper") - F.col("lower")) * (position - low)).alias("micros")
        )
    )


def time_ranked(df: DataFrame, instant: str, id_column: str, rank: str) -> DataFrame:
    """Zero-based global rank by time; equal times follow the SHA-1 of the id.

    Ranks come from buckets instead of one sorted partition: the hour, the exact
    instant inside it, and two hash prefixes for the rows that share an instant.
    """
    micros = F.unix_micros(instant)
    slotted = df.withColumns(
        {
            "_hour": F.floor(micros / F.lit(3_600_000_000)),
            "_instant": micros,
            "_tie": F.sha1(F.col(id_column).cast("string")),
        }
    ).withColumns({"_part": F.substring("_tie", 1, 3), "_fine": F.substring("_tie", 1, 6)})
    ranked = running_before(
        slotted,
        [],
        ["_hour", "_instant", "_part", "_fine"],
        [F.col("_tie")],
        {rank: F.lit(1).cast("long")},
    )
    return ranked.drop("_hour", "_instant", "_tie", "_part", "_fine")


def ranked_in_time(df: DataFrame, key: str, instant: str, id_column: str, rank: str) -> DataFrame:
    """Rank (from 1) of every row among those of its key, by instant (nulls last) and id.

    Equal rows share a rank. Distinct places are counted first and totalled over days, instants
    and an id prefix, so that a key with much of the data is no single window.
    """
    never = F.lit((1 << 62)).cast("long")
    at = F.coalesce(F.unix_micros(instant), never)
    day = F.floor(at / F.lit(86_400_000_000))
    slots = {"_day": day, "_at": at, "_id": F.coalesce(F.col(id_column).cast("string"), F.lit(""))}
    slotted = df.withColumns(slots)
    points = slotted.groupBy(key, "_day", "_at", "_id").agg(F.count(F.lit(1)).alias("_n"))
    # Short, so that an instant is a window of few heads; every level costs three shuffles.
    points = points.withColumn("_head", F.substring("_id", 1, 3))
    placed = running_before(points, [key], ["_day", "_at", "_head"], [F.col("_id")], {rank: F.col("_n")})
    return (
        slotted.join(placed.select(key, "_day", "_at", "_id", rank), [key, "_day", "_at", "_id"])
        .withColumn(rank, F.col(rank) + 1)
        .drop("_day", "_at", "_id")
    )
