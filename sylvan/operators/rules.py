"""The weak-rule search: one histogram of five sums, prefix sums over codes, and the sequential stopping test.

For a leaf, a feature, a cut j and a rule (rule 0: left -1, right +1; rule 1 the other way) with s the rule's sign at a row:
S = sum s y w over the leaf, sum_c = S - 2 gamma W, V = sum w^2 - 4 gamma sum s y w^2 + 4 gamma^2 W2, where W and W2 are over all rows scanned, not only the
leaf's. gamma comes in after aggregation, so one histogram serves any gamma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import settled

KEYS = ["leaf", "feature", "code"]
SUMS = ("n", "sw", "sw2", "syw", "syw2", "n_pos", "sw_pos")


def histogram(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, leaf, feature, code and five sums of rows (codes, label, weight, leaf); pre-aggregated before the one shuffle."""
    w, y = F.col("weight"), F.col("label")
    each = rows.select(*by, "leaf", w.alias("w"), (w * w).alias("w2"), (y * w).alias("yw"), (y * w * w).alias("yw2"), (y > 0).cast("int").alias("pos"), F.posexplode("codes").alias("feature", "code"))
    return each.groupBy(*by, *KEYS).agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum("w2").alias("sw2"), F.sum("yw").alias("syw"), F.sum("yw2").alias("syw2"), F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("w")).alias("sw_pos")
    )


def prefixes(hist: DataFrame, bins: int, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """by, leaf, feature, code 0..bins-1, with the sums of codes up to it (l_*) and the leaf's totals (t_*).

    The groups hold at most `bins` rows each; absent codes are filled in within the group.
    """
    group = [*by, *keep, "leaf", "feature"]
    have = F.map_from_entries(F.collect_list(F.struct("code", F.struct(*SUMS))))
    rows = hist.groupBy(*group).agg(have.alias("have")).select(*group, "have", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("code"))
    at = F.element_at("have", F.col("code"))
    rows = rows.select(*group, "code", *(F.coalesce(at[c], F.lit(0)).alias(c) for c in SUMS))
    own = Window.partitionBy(*group)
    upto = own.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*group, "code", *(F.sum(c).over(upto).alias(f"l_{c}") for c in SUMS), *(F.sum(c).over(own).alias(f"t_{c}") for c in SUMS))


def candidates(prefixed: DataFrame, gamma: float, all_sw: Column, all_sw2: Column) -> DataFrame:
    """Both rules of every cut, with s, sum_c, v and bound."""
    rules = F.explode(F.array(F.struct(F.lit(0).alias("rule"), F.lit(-1.0).alias("sign")), F.struct(F.lit(1).alias("rule"), F.lit(1.0).alias("sign"))))
    keep = [c for c in prefixed.columns if not c.startswith(("l_", "t_"))]
    rows = prefixed.withColumns({"_all": all_sw, "_all2": all_sw2}).withColumn("_r", rules)
    s = F.col("_r.sign") * (2 * F.col("l_syw") - F.col("t_syw"))
    s2 = F.col("_r.sign") * (2 * F.col("l_syw2") - F.col("t_syw2"))
    rows = rows.select(*keep, F.col("_r.rule").alias("rule"), F.col("t_n").alias("n"), F.col("t_sw").alias("sw"), F.col("t_n_pos").alias("n_pos"), F.col("t_sw_pos").alias("sw_pos"), s.alias("s"), (s - 2 * gamma * F.col("_all")).alias("sum_c"), (F.col("t_sw2") - 4 * gamma * s2 + 4 * gamma * gamma * F.col("_all2")).alias("v"))
    return rows.withColumn("bound", C.stopping_bound(F.col("sum_c"), F.col("v")))


def whole_scan(rows: DataFrame, bins: int, gamma: float) -> DataFrame:
    """The candidates after all rows."""
    hist = histogram(rows)
    whole = Window.partitionBy()  # a row for each leaf, feature and code
    of_rows = lambda c: F.sum(F.when(F.col("feature") == 0, F.col(c)).otherwise(0.0)).over(whole)
    sums = hist.withColumns({"all_sw": of_rows("sw"), "all_sw2": of_rows("sw2")})
    return candidates(prefixes(sums, bins, keep=["all_sw", "all_sw2"]), gamma, F.col("all_sw"), F.col("all_sw2")).drop("all_sw", "all_sw2")


#: Batches that one window of a running sum takes; more are summed up in stretches of so many first.
STRETCH = 1_024


def _over_batches(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """df with the columns `names` summed over all batches up to a row's own, by `keys`: in stretches of batches, and over the stretches before."""
    rows = df.withColumn("stretch", F.floor(F.col("batch") / STRETCH))
    inner = Window.partitionBy(*keys, "stretch").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    before = rows.groupBy(*keys, "stretch").agg(*(F.sum(c).alias(c) for c in names)).select(*keys, "stretch", *(F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_{c}") for c in names))
    summed = rows.select(*keys, "batch", "stretch", *(F.sum(c).over(inner).alias(c) for c in names)).join(before, [*keys, "stretch"])
    return summed.select(*keys, "batch", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in names))


def first_passing(rows: DataFrame, bins: int, gamma: float) -> DataFrame:
    """The rule that a batch-by-batch scan accepts: of rows (batch, leaf, codes, label, weight), the first batch in which some candidate exceeds its bound; in
    it the lowest leaf and feature, then the last code and rule, with what the scan had seen by then. A leaf is tested only in batches that hold a row of it. No row if none passes."""
    hist = settled(histogram(rows, ["batch"]), "histogram")
    per = prefixes(hist, bins, ["batch"])
    cumulated = _over_batches(per, ["leaf", "feature", "code"], [c for c in per.columns if c.startswith(("l_", "t_"))])
    first = F.col("feature") == 0
    by_batch = hist.where(first).groupBy("batch").agg(F.sum("sw").alias("all_sw"), F.sum("sw2").alias("all_sw2"), F.sum("n").alias("scanned"))
    scanned = _over_batches(by_batch.withColumn("one", F.lit(1)), ["one"], ["all_sw", "all_sw2", "scanned"]).drop("one")
    found = candidates(cumulated.join(scanned, "batch"), gamma, F.col("all_sw"), F.col("all_sw2"))
    return found.where("sum_c > bound").orderBy("batch", "leaf", "feature", F.desc("code"), F.desc("rule")).limit(1)


def log_record(found: dict, gamma: float, value: float, fallback: bool = False) -> dict:
    """What is logged of an accepted rule (a row of first_passing): its place, its predictions, what was scanned, the test's figures, and its leaf's labels."""
    left, right = (-value, value) if found["rule"] == 0 else (value, -value)
    n, positive = found["n"], found["n_pos"]
    return {
        "leaf": found["leaf"], "feature": found["feature"], "threshold": found["code"], "left": left, "right": right, "scanned": found["scanned"], "gamma": gamma, "s": found["s"], "sum_c": found["sum_c"], "v": found["v"],
        "bound": found["bound"], "v_a_row": found["v"] / found["scanned"], "positive": positive, "negative": n - positive, "positive_weight": found["sw_pos"], "negative_weight": found["sw"] - found["sw_pos"], "fallback": fallback,
    }


def best_empirical(rows: DataFrame, bins: int) -> DataFrame:
    """The fallback: the cut of greatest S over all weight (the last of equal ones, none under 0), with gamma half of that and its prediction."""
    found = whole_scan(rows, bins, 0.0)
    all_sw = rows.agg(F.sum("weight").alias("w")).first()["w"] or 0
    ranked = found.where("s > 0").orderBy(F.desc("s"), F.desc("leaf"), F.desc("feature"), F.desc("code"), F.desc("rule")).limit(1)
    gamma = F.least(F.col("s") / F.lit(float(all_sw or 1)) / 2, F.lit(0.4999))
    return ranked.select("leaf", "feature", "code", "rule", "s", gamma.alias("gamma"), C.log_odds(gamma).alias("predict"))
