"""Nearest-in-time join within a tolerance, per key, looking both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MICROS = 3_600_000_000


def nearest_in_time(
    probes: DataFrame,
    targets: DataFrame,
    key: str,
    at: str,
    target_id: str,
    tolerance_micros: int,
    bucket_micros: int = HOUR_MICROS,
    counted: Column | None = None,
) -> DataFrame:
    """For each distinct (key, at) of the probes the nearest target id.

    Both inputs carry key and at (timestamp); rows with a null in either are
    dropped. The earlier target wins a tie between before and after. Among
    targets of one instant the greatest id is taken looking back and the smallest
    looking ahead (a null id counts as the greatest). Returns key, at, probe_count
    (probes sharing the instant) and target_id; probes without a target in reach
    are left out.

    counted is a condition on probes that is dear to test: those that fail it are left out
    where probes are counted, not by a filter, which would repeat the columns it is made of.

    Equal instants collapse before the shuffle, and each key is cut into time
    buckets: the windows below never hold more than one bucket of a key, or one
    row per bucket of a key.
    """
    micros = F.unix_micros(F.col(at))
    ranked_id = F.struct(F.col(target_id).isNull().alias("missing"), F.col(target_id).alias("id"))
    points = (
        targets.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(key).alias("key"), micros.alias("t"))
        .agg(F.max(ranked_id).alias("last_id"), F.min(ranked_id).alias("first_id"))
    )
    moments = (
        probes.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(key).alias("key"), micros.alias("t"))
        .agg((F.count(F.lit(1)) if counted is None else F.count_if(counted)).alias("probe_count"))
    )
    if counted is not None:
        moments = moments.where("probe_count > 0")
    both = points.select(
        "key",
        "t",
        F.struct(F.col("t"), F.col("last_id.id").alias("id")).alias("behind"),
        F.struct(F.col("t"), F.col("first_id.id").alias("id")).alias("ahead"),
        F.lit(None).cast("long").alias("probe_count"),
    ).unionByName(moments, allowMissingColumns=True)
    # Never null, and declared so: the join below would have one reader of the inputs test it.
    bucket = F.coalesce(F.floor(F.col("t") / F.lit(bucket_micros)), F.lit(0))
    # Dealt by bucket once, for the edges as well as for the windows inside a bucket.
    both = both.withColumn("bucket", bucket).repartition("key", "bucket")

    # One row per bucket: its last and first target, then the nearest of these in
    # the buckets before and after. Only buckets with probes are kept; counting the
    # probes also leaves both readers of the inputs with the same columns, so the
    # aggregated inputs are shuffled once and reused.
    edges = both.groupBy("key", "bucket").agg(
        F.max_by("behind", F.when(F.col("behind").isNotNull(), F.col("t"))).alias("edge_last"),
        F.min_by("ahead", F.when(F.col("ahead").isNotNull(), F.col("t"))).alias("edge_first"),
        F.sum("probe_count").alias("probes"),
    )
    up = Window.partitionBy("key").orderBy("bucket")
    down = Window.partitionBy("key").orderBy(F.desc("bucket"))
    others = (Window.unboundedPreceding, -1)
    carried = edges.select(
        "key",
        "bucket",
        F.last("edge_last", True).over(up.rowsBetween(*others)).alias("carry_behind"),
        F.last("edge_first", True).over(down.rowsBetween(*others)).alias("carry_ahead"),
        "probes",
    ).where(F.col("probes").isNotNull()).drop("probes")

    # Inside a bucket: targets come before probes of the same instant, both ways.
    is_probe = F.col("probe_count").isNotNull()
    forward = Window.partitionBy("key", "bucket").orderBy("t", is_probe)
    backward = Window.partitionBy("key", "bucket").orderBy(F.desc("t"), is_probe)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    located = both.select(
        "key",
        "bucket",
        "t",
        "probe_count",
        F.last("behind", True).over(forward.rowsBetween(*so_far)).alias("behind"),
        F.last("ahead", True).over(backward.rowsBetween(*so_far)).alias("ahead"),
    ).where(is_probe)

    before = F.coalesce(F.col("behind"), F.col("carry_behind"))
    after = F.coalesce(F.col("ahead"), F.col("carry_ahead"))
    back = F.col("t") - before["t"]
    forth = after["t"] - F.col("t")
    limit = F.lit(tolerance_micros)
    use_before = (back <= limit) & (F.coalesce(back <= forth, F.lit(True)))
    chosen = F.when(use_before, before).when(forth <= limit, after)
    return (
        located.join(carried, ["key", "bucket"])
        .select("key", "t", "probe_count", chosen.alias("chosen"))
        .where(F.col("chosen").isNotNull())
        .select(
            F.col("key").alias(key),
            F.timestamp_micros("t").alias(at),
            "probe_count",
            F.col("chosen.id").alias(target_id),
        )
    )
