"""Flag rows with repeated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import joinable


def flag_repeats(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """True on every row whose (cleaned) key occurs more than once; null is a key.

    `keys` holds the key of every row and nothing else, read before the rows were joined
    or parsed. They are counted with map-side partial sums; the repeated ones meet the
    rows in one left join, which adaptive execution broadcasts, or splits at a hot key.
    """
    repeated = (
        keys.groupBy(joinable(F.col(key)).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(F.col("_key").alias("_again"))
    )
    return (
        df.join(repeated, joinable(F.col(key)) == F.col("_again"), "left")
        .withColumn(flag, F.col("_again").isNotNull())
        .drop("_again")
    )
