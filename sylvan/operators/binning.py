"""Equi-depth bins and their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Distinct values of a feature that may stand in one row; wider features are cut by jumps.
WIDE = 1_000_000


def value_frequency(examples: DataFrame) -> DataFrame:
    """feature, value, n of every distinct value."""
    each = examples.select(F.posexplode("features").alias("feature", "value"))
    return each.groupBy("feature", "value").agg(F.count("*").alias("n"))


def _walk(pairs: Column, target: Column) -> Column:
    """The resetting walk over sorted (value, n): an edge wherever the count since the last one exceeds target, and the last value."""
    start = F.struct(F.lit(0).cast("bigint").alias("acc"), F.array().cast("array<double>").alias("edges"), F.lit(0.0).alias("last"))

    def step(s: Column, p: Column) -> Column:
        count = s["acc"] + p["n"]
        over = count > target
        edges = F.when(over, F.concat(s["edges"], F.array(p["value"]))).otherwise(s["edges"])
        return F.struct(F.when(over, F.lit(0).cast("bigint")).otherwise(count).alias("acc"), edges.alias("edges"), p["value"].alias("last"))

    return F.aggregate(pairs, start, step, lambda s: F.when(s["acc"] > 0, F.concat(s["edges"], F.array(s["last"]))).otherwise(s["edges"]))


def equi_depth(frequency: DataFrame, bins: int) -> DataFrame:
    """feature, bin, edge: at most `bins` edges (and one more) a feature."""
    if not 1 <= bins <= 256:
        raise ValueError("bins is 1 to 256")
    sizes = frequency.groupBy("feature").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"))
    wide = [r["feature"] for r in sizes.where(F.col("distinct") > WIDE).select("feature").collect()]
    narrow = frequency.where(~F.col("feature").isin(wide)) if wide else frequency
    sorted_pairs = F.sort_array(F.collect_list(F.struct("value", "n")))
    rows = narrow.groupBy("feature").agg(sorted_pairs.alias("p"), F.sum("n").alias("total"))
    edges = rows.select("feature", F.posexplode(_walk(F.col("p"), F.ceil(F.col("total") / bins))).alias("bin", "edge"))
    for feature in wide:
        total = sizes.where(F.col("feature") == feature).first()["total"]
        edges = edges.unionByName(_by_jumps(frequency.where(F.col("feature") == feature), feature, -(-total // bins)))
    return edges


def _by_jumps(frequency: DataFrame, feature: int, target: int) -> DataFrame:
    """The same edges, one bounded aggregate each: the next edge is the first value up to which over `target` rows lie since the last."""
    from .prefix import running_sum

    spark = frequency.sparkSession
    summed = running_sum(frequency.select("value", "n"), "value", {"upto": F.col("n")}).persist()
    end = summed.agg(F.max(F.struct("upto", "value")).alias("m")).first()["m"]
    edges, at = [], 0
    while at < end["upto"]:
        nxt = summed.where(F.col("upto") > at + target).agg(F.min(F.struct("upto", "value")).alias("m")).first()["m"] or end
        edges.append(nxt["value"])
        at = nxt["upto"]
    summed.unpersist()
    return spark.createDataFrame([(feature, i, float(e)) for i, e in enumerate(edges)], "feature int, bin int, edge double")


def build_bins(examples: DataFrame, bins: int, most_rows: int, order: str = "row_id") -> DataFrame:
    """Edges from about `most_rows` examples (a parameter of the trainer): all if there are no more, else those whose hash of `order` is low enough."""
    n = examples.count()
    if n > most_rows:
        examples = examples.where(F.pmod(F.xxhash64(order), F.lit(1 << 32)) < int(most_rows / n * (1 << 32)))
    return equi_depth(value_frequency(examples), bins)


def total_bins(edges: DataFrame) -> DataFrame:
    """n: the edges of all features."""
    return edges.agg(F.count("*").alias("n"))


def edge_arrays(edges: DataFrame) -> list[list[float]]:
    """The bins as a driver-side list, feature by feature: at most 257 numbers a feature."""
    by: dict[int, list[tuple[int, float]]] = {}
    for r in edges.collect():
        by.setdefault(r["feature"], []).append((r["bin"], r["edge"]))
    return [[e for _, e in sorted(by.get(f, []))] for f in range(max(by, default=-1) + 1)]


def discretize(examples: DataFrame, edges: list[list[float]]) -> DataFrame:
    """examples with codes instead of features; edges go into the plan as a literal, so no join."""
    if not edges:
        return examples.withColumn("codes", F.transform("features", lambda _: F.lit(0))).drop("features")
    literal = F.array(*(F.lit([float(e) for e in own]) if own else F.array().cast("array<double>") for own in edges))
    return examples.withColumn("codes", C.bin_codes(F.col("features"), literal, max(map(len, edges)))).drop("features")


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """value: the (n div 2)-th of the sorted values, from 0, by counts of distinct values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    all_codes = Window.partitionBy()  # one row for each distinct code: 256 at most
    ranked = counts.withColumn("upto", F.sum("n").over(all_codes.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(all_codes))
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("value").alias("value"))
