"""Running sums over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each shuffle partition, and at most.
BUCKETS_PER_PARTITION = 2
MOST_BUCKETS = 2_048


def running_sum(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = False, ties: bool = False) -> DataFrame:
    """df with, for each name of sums, the sum over all rows up to its own in the order of a numeric column without nulls.

    ties: rows with equal values share the sum of all of them (as RANGE frames do); else equal values are taken in any order, so they should not be.
    Two levels: `order`'s quantiles cut the table into buckets, whose sums (one row each) are added up and joined back; a window runs in each bucket.
    """
    spark = df.sparkSession
    n = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    value = F.col(order).cast("double")
    below = F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c < value)) if cuts else F.lit(0)
    rows = df.withColumn("_b", (F.lit(len(cuts)) - below) if descending else below)
    for name, x in sums.items():
        rows = rows.withColumn(name, x)
    totals = rows.groupBy("_b").agg(*(F.sum(name).alias(name) for name in sums)).collect()
    base, so_far = [], dict.fromkeys(sums, 0)
    for r in sorted(totals, key=lambda r: r["_b"]):
        base.append((r["_b"], *so_far.values()))
        so_far = {k: v + (r[k] or 0) for k, v in so_far.items()}
    schema = "_b int, " + ", ".join(f"_base_{k} {rows.schema[k].dataType.simpleString()}" for k in sums)
    kinds = {k: float if rows.schema[k].dataType.simpleString() in ("double", "float") else int for k in sums}
    base = [(b, *(kinds[k](v) for k, v in zip(sums, vs, strict=True))) for b, *vs in base]
    w = Window.partitionBy("_b").orderBy(F.col(order).desc() if descending else F.col(order).asc())
    w = w.rangeBetween(Window.unboundedPreceding, 0) if ties else w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(spark.createDataFrame(base, schema)), "_b")  # one row a bucket
    return out.select(*df.columns, *((F.sum(k).over(w) + F.col(f"_base_{k}")).alias(k) for k in sums))
