"""The registered queries of the trainer's operators over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import binning, control, evaluation, grids, rules, sampling, statistics
from .plans.boosting import Trainer
from .plans.config import Config
from .plans.tree import Model, Tree
from .sources.shared import settled
from .sources.sparse_text import from_columns, parse

CODES = 8
GAMMA = 0.05
BATCH = 1_000
BOUND = "CASE WHEN v < 173 * ln(4 / 1e-6) THEN 'Infinity'::DOUBLE ELSE sqrt(3 * v * ((CASE WHEN 1.5 * v / abs(sum_c) > 2.7183 THEN 2 * ln(ln(1.5 * v / abs(sum_c))) ELSE 0 END) + ln(2 / 1e-6))) END"


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# --- the frame: one row an order line, four scaled features, a composite label, eight codes, an integer weight, a leaf -------------------------------------


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = line.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id")).agg(*(F.max(f"l_{c}").alias(c) for c in ("quantity", "discount", "tax", "extendedprice")))
    scaled = own.select("row_id", "quantity", (F.col("quantity") / 50).alias("x0"), (F.col("discount") / 0.1).alias("x1"), (F.col("tax") / 0.08).alias("x2"), (F.col("extendedprice") / 105000).alias("x3"))
    xs = [F.col(f"x{i}") for i in range(4)]
    code = lambda x: F.least(F.lit(CODES - 1), F.floor(x * CODES).cast("int"))
    return scaled.select(
        "row_id", F.when(xs[0] + xs[1] + xs[2] + xs[3] > 2.0, 1).otherwise(-1).alias("label"), F.array(*xs).alias("features"), F.array(*(code(x) for x in xs)).alias("codes"),
        (1.0 + F.col("row_id") % 3).alias("weight"), F.when(F.col("quantity") <= 25, 1).otherwise(2).alias("leaf"),
    )


FRAME = f"""own AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, max(l_quantity) AS quantity, max(l_discount) AS discount, max(l_tax) AS tax, max(l_extendedprice) AS extendedprice FROM lineitem GROUP BY 1),
scaled AS (SELECT row_id, quantity, quantity / 50 AS x0, discount / 0.1 AS x1, tax / 0.08 AS x2, extendedprice / 105000 AS x3 FROM own),
f AS (SELECT row_id, x0, x1, x2, x3, CASE WHEN x0 + x1 + x2 + x3 > 2.0 THEN 1 ELSE -1 END AS label, least({CODES - 1}, floor(x0 * {CODES}))::INT AS c0, least({CODES - 1}, floor(x1 * {CODES}))::INT AS c1,
  least({CODES - 1}, floor(x2 * {CODES}))::INT AS c2, least({CODES - 1}, floor(x3 * {CODES}))::INT AS c3, 1.0::DOUBLE + row_id % 3 AS weight, CASE WHEN quantity <= 25 THEN 1 ELSE 2 END AS leaf FROM scaled)"""
EACH = """e AS (SELECT row_id, label, weight, leaf, 0 AS feature, c0 AS code FROM f UNION ALL SELECT row_id, label, weight, leaf, 1, c1 FROM f UNION ALL SELECT row_id, label, weight, leaf, 2, c2 FROM f UNION ALL SELECT row_id, label, weight, leaf, 3, c3 FROM f)"""
HIST = "h AS (SELECT leaf, feature, code, count(*) AS n, sum(weight) AS sw, sum(weight * weight) AS sw2, sum(label * weight) AS syw, sum(label * weight * weight) AS syw2, sum((label > 0)::INT)::BIGINT AS n_pos, sum((label > 0)::INT * weight) AS sw_pos FROM e GROUP BY 1, 2, 3)"
PREFIX = f"""g AS (SELECT DISTINCT leaf, feature, code FROM (SELECT DISTINCT leaf, feature FROM h), (SELECT range::INT AS code FROM range({CODES}))),
d AS (SELECT leaf, feature, code, coalesce(n, 0) AS n, coalesce(sw, 0) AS sw, coalesce(sw2, 0) AS sw2, coalesce(syw, 0) AS syw, coalesce(syw2, 0) AS syw2 FROM g LEFT JOIN h USING (leaf, feature, code)),
p AS (SELECT leaf, feature, code, (sum(n) OVER u)::BIGINT AS l_n, sum(sw) OVER u AS l_sw, sum(syw) OVER u AS l_syw, sum(syw2) OVER u AS l_syw2, (sum(n) OVER t)::BIGINT AS t_n, sum(sw) OVER t AS t_sw, sum(sw2) OVER t AS t_sw2, sum(syw) OVER t AS t_syw, sum(syw2) OVER t AS t_syw2
  FROM d WINDOW u AS (PARTITION BY leaf, feature ORDER BY code ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY leaf, feature))"""
RULES = "(SELECT 0 AS rule, -1.0::DOUBLE AS sign UNION ALL SELECT 1, 1.0) r"


def _tree() -> Tree:
    tree = Tree(3)
    left, right = tree.split(0, 0, 3, -0.25, 0.25)
    tree.split(left, 3, 2, -0.5, 0.125)
    tree.split(right, 1, 4, -0.125, 0.5)
    return tree


def _model() -> Model:
    second = Tree(1)
    second.split(0, 2, 3, -0.375, 0.375)
    return Model([_tree(), second])


TREE_VALUE = "(CASE WHEN c0 <= 3 THEN CASE WHEN c3 <= 2 THEN -0.75 ELSE -0.125 END ELSE CASE WHEN c1 <= 4 THEN 0.125 ELSE 0.75 END END)::DOUBLE"
TREE_LEAF = "CASE WHEN c0 <= 3 THEN CASE WHEN c3 <= 2 THEN 3 ELSE 4 END ELSE CASE WHEN c1 <= 4 THEN 5 ELSE 6 END END"
SECOND = "(CASE WHEN c2 <= 3 THEN -0.375 ELSE 0.375 END)::DOUBLE"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir).withColumns({"score": _model().score(F.col("codes")), "version": F.lit(2)})


# --- queries -----------------------------------------------------------------------------------------------------------------------------------------------


def parse_dense_features(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.concat_ws(" ", "l_returnflag", F.concat(F.lit("0:"), F.col("l_quantity").cast("int")), F.concat(F.lit(" 2:"), "l_linenumber"), F.concat(F.lit("3:"), F.col("l_suppkey")), F.lit("1:NaN"), F.concat(F.lit("3:"), "l_partkey"))
    rows = parse(line.select("l_orderkey", text.alias("value")), 5, "R", -1.0)
    return rows.select("l_orderkey", "label", *(F.col("features")[i].alias(f"x{i}") for i in range(5)))


def value_frequency(spark, sf_dir):
    rows = from_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_linenumber", ["l_quantity", "l_discount", "l_tax"])
    return binning.value_frequency(rows)


def equi_depth_bins(spark, sf_dir):
    return binning.equi_depth(value_frequency(spark, sf_dir), 6)


def discretize(spark, sf_dir):
    rows = from_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_linenumber", ["l_quantity", "l_discount", "l_extendedprice"], ["l_orderkey"])
    return binning.discretize(rows, [[5.0, 10.0, 20.0, 40.0], [0.02, 0.05], [30000.0]]).select("l_orderkey", "label", *(F.col("codes")[i].alias(f"c{i}") for i in range(3)))


def label_weight_stratum(spark, sf_dir):
    return statistics.weighted(scored(spark, sf_dir)).select("row_id", "label", _r("score"), _r("weight"), "stratum")


def strata_distribution(spark, sf_dir):
    return statistics.strata_table(statistics.weighted(scored(spark, sf_dir))).select("stratum", "n", _r("sum_w", 4), _r("share_n"), _r("share_w"))


def ess(spark, sf_dir):
    return statistics.effective_sample_size(statistics.weighted(scored(spark, sf_dir))).select(_r("ess"))


def batch_totals(spark, sf_dir):
    return statistics.totals(frame(spark, sf_dir))


def tree_route(spark, sf_dir):
    return statistics.routed(frame(spark, sf_dir), _tree()).select("row_id", "leaf", "value")


def ensemble_score(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", "score", "version")


def incremental_score(spark, sf_dir):
    model = _model()
    rows = frame(spark, sf_dir).withColumns({"score": F.when(F.col("row_id") % 2 == 0, Model(model.trees[:1]).score(F.col("codes"))).otherwise(0.0), "version": F.when(F.col("row_id") % 2 == 0, 1).otherwise(0)})
    return statistics.rescore(rows, model).select("row_id", "score", "version", _r("weight"))


def sample_reset(spark, sf_dir):
    rows = scored(spark, sf_dir).select("row_id", "score", "version", "weight")
    fresh = statistics.init_sample(rows, 2).withColumn("how", F.lit("init"))
    reset = statistics.reset_scores(rows, 1).withColumns({"base_version": F.lit(1), "how": F.lit("reset")})
    return fresh.unionByName(reset).select("row_id", "how", "score", "weight", "version", "base_version")


def root_split(spark, sf_dir):
    return binning.upper_median(frame(spark, sf_dir).select(F.col("codes")[3].alias("code")), "code").select(F.lit(3).alias("feature"), F.col("value").alias("threshold"))


def rule_histogram(spark, sf_dir):
    return rules.histogram(frame(spark, sf_dir))


def rule_prefix(spark, sf_dir):
    got = rules.prefixes(rules.histogram(frame(spark, sf_dir)), CODES)
    return got.select("leaf", "feature", "code", "l_n", "l_sw", "l_syw", "l_syw2", "t_n", "t_sw", "t_sw2", "t_syw", "t_syw2")


def rule_candidates(spark, sf_dir):
    got = rules.whole_scan(frame(spark, sf_dir), CODES, GAMMA)
    return got.select("leaf", "feature", "code", "rule", "n", "sw", _r("s", 4), _r("sum_c", 4), _r("v", 4), F.when(F.col("bound") > 1e300, None).otherwise(F.round("bound", 3)).alias("bound"))


def first_passing_batch(spark, sf_dir):
    rows = statistics.batches(settled(frame(spark, sf_dir).select("row_id", "codes", "label", "weight", "leaf"), "frame"), BATCH)
    got = rules.first_passing(rows, CODES, GAMMA)
    return got.select("batch", "leaf", "feature", "code", "rule", _r("sum_c", 4), _r("v", 4), _r("bound", 3))


def best_empirical_rule(spark, sf_dir):
    return rules.best_empirical(frame(spark, sf_dir), CODES).select("leaf", "feature", "code", "rule", "s", _r("gamma"), _r("predict"))


def systematic_sample(spark, sf_dir):
    got = sampling.systematic_copies(settled(frame(spark, sf_dir).select("row_id", "weight"), "frame"), 5_000)
    return sampling.replicate(got).groupBy("row_id").agg(F.count("*").alias("copies"))


def gather_counters(spark, sf_dir):
    return sampling.gather_counters(sampling.systematic_copies(settled(frame(spark, sf_dir).select("row_id", "weight", "label"), "frame"), 5_000))


def total_bins(spark, sf_dir):
    return binning.total_bins(equi_depth_bins(spark, sf_dir))


def stratum_allocation(spark, sf_dir):
    table = frame(spark, sf_dir).groupBy(F.col("codes")[0].alias("stratum")).agg(F.sum("weight").alias("sum_w"))
    points = spark.range(1000).select(F.col("id").alias("point"), ((F.col("id") + 0.5) / 1000).alias("u"))
    return sampling.stratum_allocation(table, points).select("point", "stratum")


def strata_update(spark, sf_dir):
    rows = frame(spark, sf_dir).select(F.col("codes")[0].alias("stratum"), "row_id", "weight")
    table = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("weight").alias("sum_w"))
    gone = rows.where("row_id % 5 = 0").groupBy("stratum").agg((-F.count("*")).alias("n"), (-F.sum("weight")).alias("sum_w"))
    return statistics.strata_update(table, gone)


def eval_metrics(spark, sf_dir):
    rows = settled(scored(spark, sf_dir).select("label", "score"), "scored")
    return evaluation.metrics(rows).select("n", _r("ada_loss"), _r("auprc"), _r("auroc"), _r("error_rate"))


def roc_curve(spark, sf_dir):
    return evaluation.curve(scored(spark, sf_dir))


def validate_models(spark, sf_dir):
    model = _model()
    got = evaluation.validate(frame(spark, sf_dir).drop("weight"), [("one", Model(model.trees[:1])), ("two", model)])
    return got.select("model", "size", _r("ada_loss"), _r("auprc"), _r("auroc"), _r("error_rate"))


def _packets(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = control.packet_type(F.col("event_type") != "error", F.col("user_id") % 4, F.when(F.col("event_type") == "view", F.col("user_id") % 4 + 1).otherwise(F.col("user_id") % 4))
    return e.select(F.col("event_id").alias("packet_id"), (F.col("user_id") % 7).alias("source"), kind.alias("packet_type"))


PACKETS = "k AS (SELECT event_id AS packet_id, user_id % 7 AS source, CASE WHEN event_type = 'error' THEN 'Empty' WHEN event_type = 'view' THEN 'BaseVersionMismatch' ELSE 'Accept' END AS packet_type FROM events)"
RATED = "rated AS (SELECT packet_id, source, rate, CASE WHEN rate <= 0 THEN 'TooSlow' WHEN rate >= 0.9 THEN 'TooFast' ELSE 'Okay' END AS condition FROM (SELECT packet_id, source, (sum((packet_type = 'Accept')::INT) OVER (PARTITION BY source ORDER BY packet_id ROWS 5 PRECEDING)) / 6.0::DOUBLE AS rate FROM k WHERE packet_type IN ('Accept', 'Empty')))"


def packet_classification(spark, sf_dir):
    return control.counts(_packets(spark, sf_dir))


def accept_rate(spark, sf_dir):
    return control.accept_rate(_packets(spark, sf_dir), 6).select("packet_id", "source", _r("rate"), "condition")


def condition_trend(spark, sf_dir):
    return control.trend(control.accept_rate(_packets(spark, sf_dir), 6)).groupBy("source", "trend").agg(F.count("*").alias("n"))


def gamma_path(spark, sf_dir):
    rated = control.accept_rate(_packets(spark, sf_dir), 6)
    return control.gamma_path(rated, 0.25, 0.001, 50).select("source", "packet_id", "condition", _r("gamma"))


def kd_grids(spark, sf_dir):
    rows = settled(frame(spark, sf_dir).select("row_id", "codes"), "frame")
    regions = grids.kd_grids(rows, max(1, rows.count() // 8))
    path = F.get(F.array(*(F.lit(grids.path_of(region)) for region in regions)), F.col("region"))
    return grids.region_of(rows, regions).groupBy(path.alias("path")).agg(F.count("*").alias("n"))


def train_boosted_trees(spark, sf_dir):
    """The whole loop on the frame; the metrics of its model on all rows."""
    rows = settled(frame(spark, sf_dir).select("row_id", "label", "codes"), "frame")
    trainer = Trainer(rows, Config(max_bin_size=CODES, default_gamma=0.1, num_trees=3, num_splits=3, sample_size=20_000, batch_size=2_000))
    model = trainer.run()
    return evaluation.validate(rows, [("trained", model)])


def best_stump(spark, sf_dir):
    """The flagship: equi-depth bins, codes, one histogram, and the best cut of each feature with its statistics; returns rows at any size."""
    rows = settled(frame(spark, sf_dir).drop("codes"), "frame")
    edges = binning.edge_arrays(binning.equi_depth(binning.value_frequency(rows), 16))
    coded = binning.discretize(rows, edges).withColumn("leaf", F.lit(0))
    found = rules.whole_scan(coded, max(map(len, edges)), GAMMA)
    w = Window.partitionBy("feature").orderBy(F.desc("s"), F.desc("code"), F.desc("rule"))
    best = found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    bound = F.when(F.col("bound") > 1e300, None).otherwise(F.round("bound", 3)).alias("bound")
    return best.select("feature", "code", "rule", _r("s", 4), _r("sum_c", 4), _r("v", 4), bound, (F.col("sum_c") > F.col("bound")).alias("accepted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_dense_features, value_frequency, equi_depth_bins, discretize, label_weight_stratum, strata_distribution, ess, batch_totals, tree_route, ensemble_score, incremental_score, sample_reset, root_split,
        rule_histogram, rule_prefix, rule_candidates, first_passing_batch, best_empirical_rule, systematic_sample, gather_counters, total_bins, stratum_allocation, strata_update, eval_metrics, roc_curve, validate_models,
        packet_classification, accept_rate, condition_trend, gamma_path, kd_grids, train_boosted_trees, best_stump,
    )
}

SCORED = f"s AS (SELECT *, {TREE_VALUE} + {SECOND} AS score FROM f)"
WEIGHTED = "w AS (SELECT *, exp(-score * label) AS w, greatest(-128, least(127, trunc(log2(exp(-score * label)))))::INT AS stratum FROM s)"


def _metrics_sql(source: str, extra: str = "") -> str:
    return f"""(SELECT {extra} (SELECT count(*) FROM {source}) AS n, (SELECT round(avg(exp(-label * score)), 6) FROM {source}) AS ada_loss,
  round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 6) AS auprc, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auroc, (SELECT round(avg((sign(score) <> label)::INT::DOUBLE), 6) FROM {source}) AS error_rate
  FROM (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM (SELECT score, sum((label > 0)::INT) AS pos, sum((label <= 0)::INT) AS neg FROM {source} GROUP BY 1)))"""


FEATURES = "fr AS (SELECT 0 AS feature, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 1, l_discount, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 2, l_tax, count(*) FROM lineitem GROUP BY 2)"

WALK = """o AS (SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY value) AS i, ceil(sum(n) OVER (PARTITION BY feature) / {bins}.0) AS target, count(*) OVER (PARTITION BY feature) AS m FROM fr),
walk AS (SELECT feature, i, value, m, n > target AS cut, CASE WHEN n > target THEN 0 ELSE n END AS acc FROM o WHERE i = 1
  UNION ALL SELECT o.feature, o.i, o.value, o.m, walk.acc + o.n > o.target, CASE WHEN walk.acc + o.n > o.target THEN 0 ELSE walk.acc + o.n END FROM walk JOIN o ON o.feature = walk.feature AND o.i = walk.i + 1),
edges AS (SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY value) - 1)::INT AS bin, value AS edge FROM walk WHERE cut OR (i = m AND acc > 0))"""

#: best_stump's edges, without recursion (a feature may have very many values): up to every value, the edge after which the count starts again is the first value beyond the target;
#: the 17 edges that there can be at most are looked up one after another.
JUMPS = """c AS (SELECT feature, value, sum(n) OVER (PARTITION BY feature ORDER BY value) AS upto, ceil(sum(n) OVER (PARTITION BY feature) / 16.0) AS target, sum(n) OVER (PARTITION BY feature) AS total FROM fr),
j AS (SELECT DISTINCT feature, -1 AS bin, NULL::DOUBLE AS edge, 0::HUGEINT AS at, target, total FROM c
  UNION ALL SELECT j.feature, j.bin + 1, coalesce(min(c.value) FILTER (c.upto > j.at + j.target), max(c.value)), coalesce(min(c.upto) FILTER (c.upto > j.at + j.target), j.total), j.target, j.total FROM j JOIN c ON c.feature = j.feature WHERE j.at < j.total GROUP BY j.feature, j.bin, j.at, j.target, j.total),
edges AS (SELECT feature, bin, edge FROM j WHERE bin >= 0)"""

#: The features that a region of kd_grids tries, for all paths of up to eight cuts.
PATHS = ["".join("r" if k >> i & 1 else "l" for i in range(depth)) for depth in range(9) for k in range(1 << depth)]
TRIES = ", ".join(f"('{path}', {i}, {feature})" for path in PATHS for i, feature in enumerate(grids.features_of(path, 4)))

ORACLE_SQL: dict[str, str] = {
    "parse_dense_features": "SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS label, trunc(l_quantity)::DOUBLE AS x0, 0.0::DOUBLE AS x1, l_linenumber::DOUBLE AS x2, l_partkey::DOUBLE AS x3, -1.0::DOUBLE AS x4 FROM lineitem",
    "value_frequency": f"WITH {FEATURES} SELECT * FROM fr",
    "equi_depth_bins": f"WITH RECURSIVE {FEATURES}, {WALK.format(bins=6)} SELECT * FROM edges",
    "total_bins": f"WITH RECURSIVE {FEATURES}, {WALK.format(bins=6)} SELECT count(*) AS n FROM edges",
    "discretize": "SELECT l_orderkey, l_linenumber AS label, greatest(0, (l_quantity >= 5)::INT + (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT - 1) AS c0, greatest(0, (l_discount >= 0.02)::INT + (l_discount >= 0.05)::INT - 1) AS c1, 0 AS c2 FROM lineitem",
    "label_weight_stratum": f"WITH {FRAME}, {SCORED}, {WEIGHTED} SELECT row_id, label, round(score, 6) AS score, round(w, 6) AS weight, stratum FROM w",
    "strata_distribution": f"WITH {FRAME}, {SCORED}, {WEIGHTED} SELECT stratum, count(*) AS n, round(sum(w), 4) AS sum_w, round(count(*) / sum(count(*)) OVER (), 6) AS share_n, round(sum(w) / sum(sum(w)) OVER (), 6) AS share_w FROM w GROUP BY 1",
    "ess": f"WITH {FRAME}, {SCORED}, {WEIGHTED} SELECT round(sum(w) ** 2 / sum(w * w) / count(*), 6) AS ess FROM w",
    "batch_totals": f"WITH {FRAME} SELECT count(*) AS n, sum(weight) AS sw, sum(weight * weight) AS sw2 FROM f",
    "tree_route": f"WITH {FRAME} SELECT row_id, {TREE_LEAF} AS leaf, {TREE_VALUE} AS value FROM f",
    "ensemble_score": f"WITH {FRAME}, {SCORED} SELECT row_id, score, 2 AS version FROM s",
    "incremental_score": f"WITH {FRAME}, {SCORED} SELECT row_id, score, 2 AS version, round(exp(-score * label), 6) AS weight FROM s",
    "sample_reset": f"WITH {FRAME} SELECT row_id, 'init' AS how, 0.0::DOUBLE AS score, 1.0::DOUBLE AS weight, 2 AS version, 2 AS base_version FROM f UNION ALL SELECT row_id, 'reset', 0.0, 1.0, 1, 1 FROM f",
    "root_split": f"WITH {FRAME} SELECT 3 AS feature, c3 AS threshold FROM (SELECT c3, row_number() OVER (ORDER BY c3) AS i, count(*) OVER () AS n FROM f) WHERE i = n // 2 + 1",
    "rule_histogram": f"WITH {FRAME}, {EACH}, {HIST} SELECT * FROM h",
    "rule_prefix": f"WITH {FRAME}, {EACH}, {HIST}, {PREFIX} SELECT * FROM p",
    "rule_candidates": f"""WITH {FRAME}, {EACH}, {HIST}, {PREFIX}, a AS (SELECT sum(weight) AS w, sum(weight * weight) AS w2 FROM f),
c AS (SELECT leaf, feature, code, rule, t_n AS n, t_sw AS sw, sign * (2 * l_syw - t_syw) AS s, sign * (2 * l_syw - t_syw) - 2 * {GAMMA} * a.w AS sum_c, t_sw2 - 4 * {GAMMA} * sign * (2 * l_syw2 - t_syw2) + 4 * {GAMMA} * {GAMMA} * a.w2 AS v FROM p, a, {RULES})
SELECT leaf, feature, code, rule, n, sw, round(s, 4) AS s, round(sum_c, 4) AS sum_c, round(v, 4) AS v, CASE WHEN isinf(bound) THEN NULL ELSE round(bound, 3) END AS bound FROM (SELECT *, {BOUND} AS bound FROM c)""",
    "first_passing_batch": f"""WITH {FRAME}, b AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {BATCH} AS batch FROM f),
e AS (SELECT batch, leaf, label, weight, 0 AS feature, c0 AS code FROM b UNION ALL SELECT batch, leaf, label, weight, 1, c1 FROM b UNION ALL SELECT batch, leaf, label, weight, 2, c2 FROM b UNION ALL SELECT batch, leaf, label, weight, 3, c3 FROM b),
h AS (SELECT batch, leaf, feature, code, sum(weight * weight) AS sw2, sum(label * weight) AS syw, sum(label * weight * weight) AS syw2 FROM e GROUP BY 1, 2, 3, 4),
g AS (SELECT batch, leaf, feature, code FROM (SELECT DISTINCT batch, leaf, feature FROM h), (SELECT range::INT AS code FROM range({CODES}))),
d AS (SELECT batch, leaf, feature, code, coalesce(sw2, 0) AS sw2, coalesce(syw, 0) AS syw, coalesce(syw2, 0) AS syw2 FROM g LEFT JOIN h USING (batch, leaf, feature, code)),
p AS (SELECT batch, leaf, feature, code, sum(syw) OVER u AS l_syw, sum(syw2) OVER u AS l_syw2, sum(sw2) OVER t AS t_sw2, sum(syw) OVER t AS t_syw, sum(syw2) OVER t AS t_syw2 FROM d WINDOW u AS (PARTITION BY batch, leaf, feature ORDER BY code ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY batch, leaf, feature)),
q AS (SELECT batch, leaf, feature, code, sum(l_syw) OVER r AS l_syw, sum(l_syw2) OVER r AS l_syw2, sum(t_sw2) OVER r AS t_sw2, sum(t_syw) OVER r AS t_syw, sum(t_syw2) OVER r AS t_syw2 FROM p WINDOW r AS (PARTITION BY leaf, feature, code ORDER BY batch ROWS UNBOUNDED PRECEDING)),
a AS (SELECT batch, sum(sum(weight)) OVER (ORDER BY batch) AS w, sum(sum(weight * weight)) OVER (ORDER BY batch) AS w2 FROM b GROUP BY batch),
c AS (SELECT q.batch, leaf, feature, code, rule, sign * (2 * l_syw - t_syw) - 2 * {GAMMA} * a.w AS sum_c, t_sw2 - 4 * {GAMMA} * sign * (2 * l_syw2 - t_syw2) + 4 * {GAMMA} * {GAMMA} * a.w2 AS v FROM q JOIN a ON q.batch = a.batch, {RULES})
SELECT batch, leaf, feature, code, rule, round(sum_c, 4) AS sum_c, round(v, 4) AS v, round(bound, 3) AS bound FROM (SELECT *, {BOUND} AS bound FROM c) WHERE sum_c > bound ORDER BY batch, leaf, feature, code DESC, rule DESC LIMIT 1""",
    "best_empirical_rule": f"""WITH {FRAME}, {EACH}, {HIST}, {PREFIX}, a AS (SELECT sum(weight) AS w FROM f), c AS (SELECT leaf, feature, code, rule, sign * (2 * l_syw - t_syw) AS s, least(sign * (2 * l_syw - t_syw) / a.w / 2, 0.4999) AS gamma FROM p, a, {RULES})
SELECT leaf, feature, code, rule, s, round(gamma, 6) AS gamma, round(0.5 * ln((0.5 + gamma) / (0.5 - gamma)), 6) AS predict FROM c WHERE s > 0 ORDER BY s DESC, leaf DESC, feature DESC, code DESC, rule DESC LIMIT 1""",
    "systematic_sample": f"""WITH {FRAME}, a AS (SELECT sum(weight) / 5000 AS step FROM f), u AS (SELECT row_id, weight, sum(weight) OVER (ORDER BY row_id) AS upto FROM f)
SELECT row_id, copies FROM (SELECT row_id, (floor(upto / step + 0.5) - floor((upto - weight) / step + 0.5))::BIGINT AS copies FROM u, a) WHERE copies > 0""",
    "gather_counters": f"""WITH {FRAME}, a AS (SELECT sum(weight) / 5000 AS step FROM f), u AS (SELECT row_id, label, weight, sum(weight) OVER (ORDER BY row_id) AS upto FROM f),
k AS (SELECT label, (floor(upto / step + 0.5) - floor((upto - weight) / step + 0.5))::BIGINT AS copies FROM u, a)
SELECT count(*) AS scanned, count(*) FILTER (copies > 0) AS taken, count(*) FILTER (copies > 0 AND label > 0) AS taken_positive, sum(copies)::BIGINT AS sampled, (sum(copies) FILTER (label > 0))::BIGINT AS sampled_positive FROM k""",
    "best_stump": f"""WITH RECURSIVE {FRAME}, ev AS (SELECT row_id, label, weight, 0 AS feature, x0 AS value FROM f UNION ALL SELECT row_id, label, weight, 1, x1 FROM f UNION ALL SELECT row_id, label, weight, 2, x2 FROM f UNION ALL SELECT row_id, label, weight, 3, x3 FROM f),
fr AS (SELECT feature, value, count(*) AS n FROM ev GROUP BY 1, 2), {JUMPS},
bv AS (SELECT feature, list(edge ORDER BY edge) AS own FROM edges GROUP BY 1),
coded AS (SELECT 0 AS leaf, ev.feature, greatest(0, len(list_filter(own, lambda e: e <= value)) - 1)::INT AS code, label, weight FROM ev JOIN bv USING (feature)),
h AS (SELECT leaf, feature, code, count(*) AS n, sum(weight) AS sw, sum(weight * weight) AS sw2, sum(label * weight) AS syw, sum(label * weight * weight) AS syw2 FROM coded GROUP BY 1, 2, 3),
g AS (SELECT 0 AS leaf, feature, code FROM (SELECT DISTINCT feature FROM h), (SELECT unnest(range((SELECT max(len(own)) FROM bv)))::INT AS code)),
d AS (SELECT leaf, feature, code, coalesce(sw2, 0) AS sw2, coalesce(syw, 0) AS syw, coalesce(syw2, 0) AS syw2 FROM g LEFT JOIN h USING (leaf, feature, code)),
p AS (SELECT leaf, feature, code, sum(syw) OVER u AS l_syw, sum(syw2) OVER u AS l_syw2, sum(sw2) OVER t AS t_sw2, sum(syw) OVER t AS t_syw, sum(syw2) OVER t AS t_syw2 FROM d WINDOW u AS (PARTITION BY leaf, feature ORDER BY code ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY leaf, feature)),
a AS (SELECT sum(weight) AS w, sum(weight * weight) AS w2 FROM f),
c2 AS (SELECT feature, code, rule, sign * (2 * l_syw - t_syw) AS s, sign * (2 * l_syw - t_syw) - 2 * {GAMMA} * a.w AS sum_c, t_sw2 - 4 * {GAMMA} * sign * (2 * l_syw2 - t_syw2) + 4 * {GAMMA} * {GAMMA} * a.w2 AS v FROM p, a, {RULES}),
b AS (SELECT *, {BOUND} AS bound FROM c2)
SELECT feature, code, rule, round(s, 4) AS s, round(sum_c, 4) AS sum_c, round(v, 4) AS v, CASE WHEN isinf(bound) THEN NULL ELSE round(bound, 3) END AS bound, sum_c > bound AS accepted FROM b QUALIFY row_number() OVER (PARTITION BY feature ORDER BY s DESC, code DESC, rule DESC) = 1""",
    "stratum_allocation": f"""WITH {FRAME}, t AS (SELECT c0 AS stratum, sum(weight) AS w FROM f GROUP BY 1), z AS (SELECT stratum, (sum(w) OVER (ORDER BY stratum) - w) / sum(w) OVER () AS low, sum(w) OVER (ORDER BY stratum) / sum(w) OVER () AS high FROM t)
SELECT range AS point, stratum FROM range(1000) JOIN z ON (range + 0.5::DOUBLE) / 1000 >= low AND (range + 0.5::DOUBLE) / 1000 < high""",
    "strata_update": f"WITH {FRAME} SELECT c0 AS stratum, count(*) - sum((row_id % 5 = 0)::INT)::BIGINT AS n, sum(weight) - sum(CASE WHEN row_id % 5 = 0 THEN weight ELSE 0 END) AS sum_w FROM f GROUP BY 1",
    "eval_metrics": f"WITH {FRAME}, {SCORED} SELECT * FROM {_metrics_sql('s')}",
    "roc_curve": f"WITH {FRAME}, {SCORED}, b AS (SELECT score, sum((label > 0)::INT)::BIGINT AS pos, sum((label <= 0)::INT)::BIGINT AS neg FROM s GROUP BY 1) SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS tp, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS fp FROM b",
    "validate_models": f"""WITH {FRAME}, {SCORED}, one AS (SELECT label, {TREE_VALUE} AS score FROM f) SELECT model, size, ada_loss, auprc, auroc, error_rate FROM {_metrics_sql("one", "'one' AS model, 1 AS size,")}
UNION ALL SELECT model, size, ada_loss, auprc, auroc, error_rate FROM {_metrics_sql("s", "'two' AS model, 2 AS size,")}""",
    "kd_grids": f"""WITH RECURSIVE {FRAME}, tries(path, attempt, feature) AS (VALUES {TRIES}), least AS (SELECT greatest(1, count(*) // 8) AS least FROM f),
r AS (SELECT row_id, c0, c1, c2, c3, '' AS path, 0 AS attempt FROM f
  UNION ALL SELECT row_id, c0, c1, c2, c3, CASE WHEN middle < high THEN path || CASE WHEN x <= middle THEN 'l' ELSE 'r' END ELSE path END, CASE WHEN middle < high THEN 0 ELSE attempt + 1 END
  FROM (SELECT *, median(x) OVER w AS middle, max(x) OVER w AS high, count(*) OVER w AS n
    FROM (SELECT r.*, (CASE feature WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END)::DOUBLE AS x FROM r JOIN tries USING (path, attempt)) WINDOW w AS (PARTITION BY path)), least
  WHERE n > 2 * least)
SELECT path, count(*) AS n FROM (SELECT row_id, arg_max(path, length(path)) AS path FROM r GROUP BY 1) GROUP BY 1""",
    "packet_classification": f"WITH {PACKETS} SELECT source, packet_type, count(*) AS n FROM k GROUP BY 1, 2",
    "accept_rate": f"WITH {PACKETS}, {RATED} SELECT packet_id, source, round(rate, 6) AS rate, condition FROM rated",
    "condition_trend": f"""WITH {PACKETS}, {RATED}, l AS (SELECT source, condition AS now, lag(condition) OVER (PARTITION BY source ORDER BY packet_id) AS b FROM rated)
SELECT source, CASE WHEN b IS NULL THEN 'other' WHEN now = b AND now <> 'Okay' THEN 'same' WHEN (now = 'TooFast' AND b = 'TooSlow') OR (now = 'TooSlow' AND b = 'TooFast') THEN 'opposite' ELSE 'other' END AS trend, count(*) AS n FROM l GROUP BY 1, 2""",
    "gamma_path": f"""WITH {PACKETS}, {RATED}, z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY packet_id) AS i FROM rated)
SELECT source, packet_id, condition, round(least(0.499, greatest(0.001, 0.25 * exp(sum(CASE condition WHEN 'TooFast' THEN -ln(0.9) WHEN 'TooSlow' THEN ln(0.5) ELSE 0 END) OVER (PARTITION BY source ORDER BY packet_id)))), 6) AS gamma FROM z WHERE i % 50 = 0""",
}
