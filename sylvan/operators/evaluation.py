"""Ranked evaluation. Definitions: AdaBoost loss = mean exp(-y s); error = mean[sign(s) != y], s = 0 an error; AUROC by average ranks; AUPRC as the
step sum over distinct scores of (recall gained) x precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import Model
from .prefix import running_sum
from .statistics import rescore


def curve(scored: DataFrame) -> DataFrame:
    """score (distinct), pos, neg, and tp, fp: positives and negatives with that score or a higher one."""
    by = scored.groupBy("score").agg(F.sum((F.col("label") > 0).cast("bigint")).alias("pos"), F.sum((F.col("label") <= 0).cast("bigint")).alias("neg"))
    return running_sum(by, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)


def metrics(scored: DataFrame) -> DataFrame:
    """One row: n, ada_loss, auprc, auroc, error_rate."""
    y, s = F.col("label"), F.col("score")
    plain = scored.agg(F.count("*").alias("n"), F.avg(F.exp(-y * s)).alias("ada_loss"), F.avg((F.signum(s) != y).cast("double")).alias("error_rate"), F.sum((y > 0).cast("bigint")).alias("p"), F.sum((y <= 0).cast("bigint")).alias("q"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area")
    ranked = curve(scored).agg(area, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    one = F.lit(1).alias("one")
    both = plain.select("*", one).join(ranked.select("*", one), "one")  # one row each
    return both.select("n", "ada_loss", (F.col("steps") / F.nullif(F.col("p"), F.lit(0))).alias("auprc"), (F.col("area") / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auroc"), "error_rate")


def validate(rows: DataFrame, models: list[tuple[str, Model]], incremental: bool = True) -> DataFrame:
    """model, size and metrics of each model over rows (row_id, codes, label). Incremental: only the trees after the last model's are added, as long as the list
    grows; else every model scores from nothing."""
    scored, out, last = rows.withColumns({"score": F.lit(0.0), "version": F.lit(0)}), None, 0
    for name, model in models:
        if not incremental or model.size < last:
            scored = rows.withColumns({"score": F.lit(0.0), "version": F.lit(0)})
        scored, last = rescore(scored, model), model.size
        own = metrics(scored).select(F.lit(name).alias("model"), F.lit(model.size).alias("size"), "ada_loss", "auprc", "auroc", "error_rate")
        out = own if out is None else out.unionByName(own)
    return out
