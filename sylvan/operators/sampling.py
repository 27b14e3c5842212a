"""Sampling in proportion to weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sum


def systematic_copies(rows: DataFrame, capacity: int, order: str = "row_id", start: float = 0.5) -> DataFrame:
    """rows with `copies`: how many points of a grid of step sum(weight)/capacity, begun at `start` of a step, fall into a row's stretch of the running weight."""
    total = rows.agg(F.sum("weight").alias("w")).first()["w"]
    if not total:
        return rows.withColumn("copies", F.lit(0).cast("bigint"))
    step = float(total) / capacity
    summed = running_sum(rows, order, {"_upto": F.col("weight")})
    upto = lambda x: F.floor(x / step + start)
    return summed.withColumn("copies", upto(F.col("_upto")) - upto(F.col("_upto") - F.col("weight"))).drop("_upto")


def replicate(rows: DataFrame) -> DataFrame:
    """Each row as often as its copies say."""
    return rows.where("copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("_c", "copies")


def draw(rows: DataFrame, capacity: int, seed: int, order: str = "row_id") -> DataFrame:
    """A sample of `capacity` rows in proportion to weight, in an order (shuffle_key) fixed by seed. The grid has `capacity` points, so nothing is cut off;
    of a row's copies each has a key of its own."""
    start = ((seed * 2654435761) % 1000) / 1000
    copies = systematic_copies(rows, capacity, order, start).where("copies > 0")
    each = copies.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return each.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(order), F.col("_c"))).drop("_c", "copies")


def gather_counters(copies: DataFrame) -> DataFrame:
    """scanned, taken, taken_positive (distinct rows) and sampled, sampled_positive (with their copies) of rows with copies and label."""
    some, positive = F.col("copies") > 0, F.col("label") > 0
    n = lambda x: F.sum(x.cast("bigint"))
    return copies.agg(
        F.count("*").alias("scanned"), n(some).alias("taken"), n(some & positive).alias("taken_positive"), F.sum("copies").alias("sampled"), F.sum(F.when(positive, F.col("copies")).otherwise(0)).alias("sampled_positive")
    )


def stratum_allocation(table: DataFrame, points: DataFrame) -> DataFrame:
    """The stratum that each point u in [0, 1) falls to when strata take shares by weight; none if there is no weight.

    A range join of the points with at most 256 strata (their number is bounded by the key's type).
    """
    w = Window.partitionBy().orderBy("stratum")
    whole = F.sum("sum_w").over(Window.partitionBy())
    upto = F.sum("sum_w").over(w.rowsBetween(Window.unboundedPreceding, 0))
    shares = table.where("sum_w > 0").select("stratum", ((upto - F.col("sum_w")) / whole).alias("low"), (upto / whole).alias("high"))
    return points.join(F.broadcast(shares), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).drop("low", "high")
