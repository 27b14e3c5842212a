"""Weights, strata and effective sample size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.tree import TREES_PER_STEP, Model


def weighted(scored: DataFrame) -> DataFrame:
    """scored (label, score) with weight and stratum."""
    rows = scored.withColumn("weight", C.weight(F.col("score"), F.col("label")))
    return rows.withColumn("stratum", C.stratum(F.col("weight")))


def rescore(rows: DataFrame, model: Model) -> DataFrame:
    """rows (codes, label, score, version) brought up to the model: only the trees after a row's version are added.

    Rows are usually of one version; each version in the table (they are few: one a sample refresh) gets its own range of trees.
    """
    versions = sorted(r[0] for r in rows.select("version").distinct().collect())
    if not versions or versions == [model.size]:
        return rows.drop("weight").withColumn("weight", C.weight(F.col("score"), F.col("label")))
    steps = range(min(versions), model.size, TREES_PER_STEP)
    for a in steps:
        stop = min(a + TREES_PER_STEP, model.size)
        added = F.lit(0.0)
        for i in range(a, stop):
            value = model.trees[i].value(F.col("codes"))
            added = added + (value if versions[-1] <= i else F.when(F.col("version") <= i, value).otherwise(0.0))
        rows = rows.withColumn("score", F.col("score") + added)
    rows = rows.withColumn("version", F.lit(model.size))
    return rows.drop("weight").withColumn("weight", C.weight(F.col("score"), F.col("label")))


def reset_scores(rows: DataFrame, base: int) -> DataFrame:
    """Score 0, weight 1, version at the base."""
    return rows.drop("weight").withColumns({"score": F.lit(0.0), "weight": F.lit(1.0), "version": F.lit(base)})


def init_sample(rows: DataFrame, version: int) -> DataFrame:
    """A fresh sample's rows: drawn by weight, so their weights begin at 1 and their versions at the model that drew them."""
    return rows.drop("weight", "stratum").withColumns({"score": F.lit(0.0), "weight": F.lit(1.0), "version": F.lit(version), "base_version": F.lit(version)})


def versions(sample: DataFrame) -> DataFrame:
    return sample.agg(F.min("version").alias("least"), F.max("version").alias("most"))


def effective_sample_size(sample: DataFrame, size: int | None = None) -> DataFrame:
    """ess: (sum w)^2 / sum w^2 over the configured size (or the number of rows)."""
    n = F.lit(size) if size else F.count("*")
    return sample.agg((F.pow(F.sum("weight"), 2) / F.sum(F.col("weight") * F.col("weight")) / n).alias("ess"))


def totals(sample: DataFrame) -> DataFrame:
    return sample.agg(F.count("*").alias("n"), F.sum("weight").alias("sw"), F.sum(F.col("weight") * F.col("weight")).alias("sw2"))


def strata_table(rows: DataFrame) -> DataFrame:
    """stratum, n, sum_w, and their shares; at most 256 strata."""
    own = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("weight").alias("sum_w"))
    whole = Window.partitionBy()
    return own.withColumns({"share_n": F.col("n") / F.sum("n").over(whole), "share_w": F.col("sum_w") / F.sum("sum_w").over(whole)})


def strata_update(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """The table (stratum, n, sum_w) after signed deltas of the same columns."""
    both = table.select("stratum", "n", "sum_w").unionByName(deltas.select("stratum", "n", "sum_w"))
    return both.groupBy("stratum").agg(F.sum("n").alias("n"), F.sum("sum_w").alias("sum_w"))


def routed(rows: DataFrame, tree) -> DataFrame:
    return rows.withColumns({"leaf": tree.leaf(F.col("codes")), "value": tree.value(F.col("codes"))})


def batches(rows: DataFrame, batch_size: int, order: str = "row_id") -> DataFrame:
    """rows with a batch number in row order."""
    from .prefix import running_sum

    return running_sum(rows, order, {"_rn": F.lit(1).cast("bigint")}).withColumn("batch", F.floor((F.col("_rn") - 1) / batch_size)).drop("_rn")
