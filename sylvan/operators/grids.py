"""kd partitions: regions of feature space between `least` and twice `least` rows."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_of(region: list[tuple[int, float, bool]]) -> str:
    """A region's name: l or r for each cut on the way to it."""
    return "".join("l" if at_most else "r" for _, _, at_most in region)


def features_of(path: str, width: int, seed: int = 1) -> list[int]:
    """The features in the order in which a region tries them; it depends on its path and the seed alone."""
    return random.Random(f"{seed}:{path}").sample(range(width), width)


def kd_grids(rows: DataFrame, least: int, seed: int = 1, column: str = "codes") -> list[list[tuple[int, float, bool]]]:
    """Regions as lists of (feature, value, at most?) conditions. A region of over 2 `least` rows is cut at the median of a feature taken at random, as long
    as that leaves rows on both sides, else at another's; one query a level counts all open regions and finds their medians."""
    width = (rows.select(F.max(F.size(column))).first() or [0])[0] or 0
    open_, done = [([], features_of("", width, seed))], []
    while open_:
        feature = F.lit(None).cast("int")
        for i, (_, left) in enumerate(open_):
            feature = F.when(F.col("region") == i, left[0] if left else None).otherwise(feature)
        value = F.get(F.col(column), feature).cast("double")
        own = region_of(rows, [region for region, _ in open_], column).where("region is not null").select("region", value.alias("x"))
        found = {r["region"]: r for r in own.groupBy("region").agg(F.count("*").alias("n"), F.percentile("x", F.lit(0.5)).alias("middle"), F.max("x").alias("high")).collect()}
        following = []
        for i, (region, left) in enumerate(open_):
            r = found.get(i)
            if r is None or r["n"] <= 2 * least or not left:
                done.append(region)
            elif r["middle"] < r["high"]:
                parts = [[*region, (left[0], float(r["middle"]), low)] for low in (True, False)]
                following += [(part, features_of(path_of(part), width, seed)) for part in parts]
            else:  # no row lies above this feature's median
                following.append((region, left[1:]))
        open_ = following
    return done


def inside(region: list[tuple[int, float, bool]], column: str = "codes") -> Column:
    out = F.lit(True)
    for f, value, at_most in region:
        x = F.get(F.col(column), F.lit(f))
        out = out & ((x <= value) if at_most else (x > value))
    return out


def region_of(rows: DataFrame, regions: list, column: str = "codes") -> DataFrame:
    """rows with the number of the region each is in."""
    out = F.lit(None).cast("int")
    for i, region in reversed(list(enumerate(regions))):
        out = F.when(inside(region, column), i).otherwise(out)
    return rows.withColumn("region", out)
