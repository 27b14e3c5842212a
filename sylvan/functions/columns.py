"""Row functions of the trainer, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopping test's constants and the tolerance of equality.
DELTA = 1e-6
SHRINK = 173.0
TOLERANCE = 1e-8
LEAST_VARIANCE = SHRINK * math.log(4.0 / DELTA)


def binary_label(label: Column, positive: str) -> Column:
    """+1 where the label, as text, is `positive`, else -1."""
    return F.when(label == positive, 1).otherwise(-1)


def dense(pairs: Column, width: int, missing: float = 0.0) -> Column:
    """array<double> of `width` from an array of "index:value" tokens: indices count from 0, the last of equal ones holds, nan counts as 0.

    The tokens are sorted once and the gaps between them filled, so work grows with width + tokens (times the logarithm of the latter).
    """
    parts = F.transform(pairs, lambda p, at: F.struct(F.substring_index(p, ":", 1).cast("int").alias("i"), at.alias("at"), F.nanvl(F.substring_index(p, ":", -1).cast("double"), F.lit(0.0)).alias("v")))
    blank = lambda n: F.array_repeat(F.lit(float(missing)), n)

    def last_of_each(p: Column) -> Column:
        return F.filter(p, lambda x, k: F.coalesce(F.get(p, k + 1)["i"] != x["i"], F.lit(True)))

    def filled(p: Column) -> Column:
        pieces = F.transform(p, lambda x, k: F.concat(blank(x["i"] - F.coalesce(F.get(p, k - 1)["i"], F.lit(-1)) - 1), F.array(x["v"])))
        return F.concat(F.flatten(pieces), blank(F.lit(width - 1) - F.coalesce(F.get(p, F.size(p) - 1)["i"], F.lit(-1))))

    let = lambda x, body: F.transform(F.array(x), body)[0]
    return let(let(F.array_sort(F.filter(parts, lambda x: x["i"] >= 0)), last_of_each), filled)


#: Edges up to which counting them all is quicker than halving.
FEW_EDGES = 16


def bin_code(value: Column, edges: Column, most: int = FEW_EDGES) -> Column:
    """How many edges the value reaches, less one, and 0 at least. most: how many edges there are at most; beyond FEW_EDGES the place is found by halving."""
    if most <= FEW_EDGES:
        return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= value)) - 1)

    def half(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        reached = (acc["low"] < acc["high"]) & (F.get(edges, middle) <= value)
        return F.struct(F.when(reached, middle + 1).otherwise(acc["low"]).alias("low"), F.when(reached, acc["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(edges).alias("high"))
    return F.greatest(F.lit(0), F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), start, half, lambda acc: acc["low"]) - 1)


def bin_codes(values: Column, edges: Column, most: int = FEW_EDGES) -> Column:
    """bin_code at each position of two arrays."""
    return F.zip_with(values, edges, lambda v, e: bin_code(v, e, most))


def weight(score: Column, label: Column) -> Column:
    return F.exp(-score * label)


def sign(x: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(x < -tolerance, -1).when(x > tolerance, 1).otherwise(0)


def near(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= tolerance


def stratum(w: Column) -> Column:
    """log2 of the weight without its fraction, within a signed byte; weight 0 is the lowest."""
    return F.when(w > 0, F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.log2(w))).cast("int")).otherwise(-128)


def stopping_bound(total: Column, variance: Column, delta: float = DELTA) -> Column:
    """What a rule's summed advantage must exceed; infinite while there is too little variance."""
    inner = 1.5 * variance / F.when(total != 0, F.abs(total)).otherwise(1e-300)
    twice = F.when(inner > 2.7183, 2 * F.log(F.log(inner))).otherwise(0.0)
    return F.when(variance < SHRINK * math.log(4.0 / delta), F.lit(float("inf"))).otherwise(F.sqrt(3 * variance * (twice + math.log(2.0 / delta))))


def log_odds(gamma: Column | float) -> Column:
    """The prediction of a rule with advantage gamma (under a half)."""
    g = F.lit(gamma) if isinstance(gamma, float | int) else gamma
    return 0.5 * F.log((0.5 + g) / (0.5 - g))
