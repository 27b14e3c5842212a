"""The trainer's parts: parsing, bins, trees, rules against a plain re-derivation, sampling, stores, streams, the loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.functions import columns as C
from sylvan.operators import binning, control, evaluation, grids, prefix, rules, sampling, statistics
from sylvan.plans import jobs
from sylvan.plans.boosting import Trainer, commit
from sylvan.plans.config import Config, read_config
from sylvan.plans.tree import Model, Tree
from sylvan.sources.sparse_text import parse, read, read_first
from sylvan.sources.stores import Store, model_list
from sylvan.streaming import refresh


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_sparse_lines(spark):
    rows = parse(lines(spark, "0 1:2 3:5 4:10", " 1.2   1:3 3:10  5:20 ", "", "   "), 6, "1.2").collect()
    assert [(r.label, r.features) for r in rows] == [(-1, [0, 2, 0, 5, 10, 0]), (1, [0, 3, 0, 10, 0, 20])]


def test_sparse_lines_edges(spark):
    rows = parse(lines(spark, "1.0 0:1 0:7 1:NaN", "1"), 3, "1", -1.0).collect()
    assert [(r.label, r.features) for r in rows] == [(-1, [7, 0, -1]), (1, [-1, -1, -1])]
    with pytest.raises(Exception, match="not below"):
        parse(lines(spark, "1 3:1"), 3, "1").collect()


def test_dense_by_a_plain_copy(spark):
    rng = np.random.default_rng(2)
    rows = [" ".join(["1", *(f"{rng.integers(0, 40)}:{rng.integers(1, 99)}" for _ in range(rng.integers(0, 60)))]) for _ in range(60)]
    got = parse(lines(spark, *rows).withColumn("row", F.monotonically_increasing_id()), 40, "1", -1.0).select("features").collect()
    for text, r in zip(rows, got, strict=True):
        want = [-1.0] * 40
        for t in text.split()[1:]:
            want[int(t.split(":")[0])] = float(t.split(":")[1])
        assert r.features == want


def test_read_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0:1\n1 1:2\n\n")
    assert read(spark, str(tmp_path / "a.txt"), 2, "1").count() == 2
    assert read_first(spark, str(tmp_path / "a.txt"), 1, 2, "1").collect()[0].features == [1, 0]


def walk(values, bins):
    target, out, acc = math.ceil(len(values) / bins), [], 0
    for v in sorted(set(values)):
        acc += values.count(v)
        if acc > target:
            out.append(v)
            acc = 0
    return out + [max(values)] * (acc > 0)


@pytest.mark.parametrize("values", [list(range(1, 17)), [3.0] * 9, [1, 1, 2, 5, 5, 5, 9]])
def test_equi_depth(spark, values, monkeypatch):
    rows = spark.createDataFrame([([float(v)],) for v in values], "features array<double>")
    want = walk([float(v) for v in values], 4)
    assert binning.edge_arrays(binning.equi_depth(binning.value_frequency(rows), 4)) == [want]
    monkeypatch.setattr(binning, "WIDE", 0)
    assert binning.edge_arrays(binning.equi_depth(binning.value_frequency(rows), 4)) == [want]


def test_codes(spark):
    rows = spark.createDataFrame([([v],) for v in (0.0, 1.0, 2.5, 3.0, 99.0)], "features array<double>")
    assert [r.codes for r in binning.discretize(rows, [[1.0, 2.0, 3.0]]).collect()] == [[0], [0], [1], [2], [2]]
    assert binning.discretize(rows, [[]]).collect()[4].codes == [0]
    for n in (17, 100, 257):  # many edges: the place is found by halving
        edges = sorted(float(x) for x in np.random.default_rng(n).integers(0, 10**6, n))
        values = [*edges[:: max(1, n // 20)], *(float(x) for x in np.random.default_rng(n + 1).integers(-5, 10**6 + 5, 60))]
        got = binning.discretize(spark.createDataFrame([([v, v],) for v in values], "features array<double>"), [edges, edges[:3]]).collect()
        assert [r.codes for r in got] == [[max(0, sum(e <= v for e in own) - 1) for own in (edges, edges[:3])] for v in values]


def test_bins_of_some_rows(spark):
    """Which rows make the bins depends on their ids alone."""
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(4000)], "row_id long, features array<double>")
    some = binning.build_bins(rows, 4, 1000).collect()
    assert some == binning.build_bins(rows.repartition(7), 4, 1000).collect() and 3 <= len(some) <= 5
    assert binning.total_bins(binning.build_bins(rows, 4, 9999)).first().n == 4 and [r.edge for r in binning.build_bins(rows, 4, 9999).orderBy("bin").collect()][-1] == 3999.0


def test_row_functions(spark):
    rows = spark.createDataFrame([(0.5,), (0.6,), (1.0,), (1.9,), (2.0,), (0.0,)], "w double").select(C.stratum(F.col("w")).alias("s")).collect()
    assert [r.s for r in rows] == [-1, 0, 0, 0, 1, -128]
    r = spark.range(1).select(C.stopping_bound(F.lit(100.0), F.lit(2629.0)).alias("a"), C.stopping_bound(F.lit(100.0), F.lit(2630.0)).alias("b"), C.log_odds(0.25).alias("c"), C.sign(F.lit(1e-9)).alias("d")).first()
    assert math.isinf(r.a) and r.d == 0
    assert r.b == pytest.approx(math.sqrt(3 * 2630 * (2 * math.log(math.log(39.45)) + math.log(2e6))))
    assert r.c == pytest.approx(0.5 * math.log(3))


def some_rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    data = [(i, int(rng.choice([-1, 1])), [int(x) for x in rng.integers(0, 5, 3)], float(rng.integers(1, 4)), int(rng.integers(1, 3))) for i in range(n)]
    return data, spark.createDataFrame(data, "row_id long, label int, codes array<int>, weight double, leaf int")


def test_rules_by_rederivation(spark):
    data, rows = some_rows(spark)
    gamma = 0.1
    got = {(r.leaf, r.feature, r.code, r.rule): r for r in rules.whole_scan(rows, 5, gamma).collect()}
    assert len(got) == 2 * 3 * 5 * 2
    for (leaf, f, cut, rule), r in got.items():
        s = total = v = 0.0
        for _, y, codes, w, at in data:
            p = 0 if at != leaf else (-1 if codes[f] <= cut else 1) * (1 if rule == 0 else -1)
            c = p * y * w - 2 * gamma * w
            s, total, v = s + p * y * w, total + c, v + c * c
        assert (r.s, r.sum_c, r.v) == (pytest.approx(s), pytest.approx(total), pytest.approx(v))


def test_histogram_invariants(spark):
    data, rows = some_rows(spark)
    hist = rules.histogram(rows)
    assert hist.groupBy("feature").agg(F.sum("n").alias("n")).where("n <> 400").count() == 0
    assert rules.prefixes(hist, 5).where("code = 4 and (l_n <> t_n or l_syw <> t_syw)").count() == 0


def test_first_passing_in_stretches(spark, monkeypatch):
    """The scan over batches is the same however many batches a window takes."""
    rng = np.random.default_rng(8)
    rows = [(i, 1 if rng.random() < 0.9 - 0.2 * c else -1, [int(c), int(rng.integers(0, 3))], 1.0, 0, i // 100) for i, c in enumerate(rng.integers(0, 4, 6000))]
    rows = spark.createDataFrame(rows, "row_id long, label int, codes array<int>, weight double, leaf int, batch long")
    whole = rules.first_passing(rows, 5, 0.1).first()
    monkeypatch.setattr(rules, "STRETCH", 3)
    assert whole is not None and rules.first_passing(rows, 5, 0.1).first() == whole and whole.scanned == 100 * (whole.batch + 1)
    record = rules.log_record(whole.asDict(), 0.1, 0.2)
    assert len(record) == 17 and record["positive"] + record["negative"] == whole.n and record["positive_weight"] + record["negative_weight"] == pytest.approx(whole.sw) and record["left"] == -record["right"]


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(i * 7 % 1000, 1 + i % 3) for i in range(1000)], "k long, v long")
    got = {r.k: r.s for r in prefix.running_sum(rows, "k", {"s": F.col("v")}).collect()}
    acc = 0
    for k, v in sorted((i * 7 % 1000, 1 + i % 3) for i in range(1000)):
        acc += v
        assert got[k] == acc
    assert prefix.running_sum(rows.where("k < 0"), "k", {"s": F.col("v")}).count() == 0


def test_sampling(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(rng.lognormal(0, 1.5, 2000))], "row_id long, weight double")
    copies = sampling.systematic_copies(rows, 500)
    assert copies.agg(F.sum("copies")).first()[0] == 500
    assert sampling.replicate(copies).count() == 500
    step = rows.agg(F.sum("weight")).first()[0] / 500
    assert copies.where(F.abs(F.col("copies") - F.col("weight") / step) >= 1).count() == 0
    drawn = sampling.draw(rows, 500, 1)
    assert drawn.count() == drawn.select("shuffle_key").distinct().count() == 500
    counts = sampling.gather_counters(copies.withColumn("label", F.lit(1))).first()
    assert (counts.scanned, counts.sampled, counts.sampled_positive) == (2000, 500, 500) and counts.taken == counts.taken_positive == copies.where("copies > 0").count()


def test_trees(tmp_path, spark):
    tree = Tree(2)
    left, _ = tree.split(0, 0, 1, -0.5, 0.5)
    tree.split(left, 1, 0, -0.25, 0.25)
    assert tree.full and tree.leaves == [2, 3, 4]
    with pytest.raises(ValueError):
        tree.split(2, 0, 1, 0, 0)
    rows = spark.createDataFrame([([0, 0],), ([1, 5],), ([2, 0],)], "codes array<int>")
    assert [tuple(r) for r in rows.select(tree.leaf(F.col("codes")), tree.value(F.col("codes"))).collect()] == [(3, -0.75), (4, -0.25), (2, 0.5)]
    model = Model([tree, tree])
    assert Model.from_json(model.to_json()) == model and model.last_new() is tree
    store = Store(spark, f"file://{tmp_path}/store")
    store.write_model(model)
    store.write_model(Model([tree]))
    assert store.read_model() == model and store.read_model(1).size == 1
    model.set_base()
    assert model.last_new() is None


def test_many_trees(spark):
    tree = Tree(1)
    tree.split(0, 0, 0, -1.0, 1.0)
    rows = spark.createDataFrame([(1, [0], 1, 0.0, 0), (2, [1], 1, 30.0, 30)], "row_id long, codes array<int>, label int, score double, version int")
    got = {r.row_id: (r.score, r.version) for r in statistics.rescore(rows, Model([tree] * 50)).collect()}
    assert got == {1: (-50.0, 50), 2: (50.0, 50)}


def test_ess(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "weight double")
    assert statistics.effective_sample_size(rows).first().ess == pytest.approx(16 / 6 / 3)
    assert statistics.effective_sample_size(rows, 6).first().ess == pytest.approx(16 / 6 / 6)


def test_metrics_with_ties(spark):
    rows = spark.createDataFrame([(1, 2.0), (-1, 2.0), (1, 1.0), (-1, 0.0)], "label int, score double")
    r = evaluation.metrics(rows).first()
    assert r.auroc == pytest.approx(0.625)
    assert r.error_rate == pytest.approx(0.5)
    assert r.auprc == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_control(spark):
    with pytest.raises(ValueError):
        control.accept_rate(spark.createDataFrame([], "source int, packet_id int, packet_type string"), 0)
    assert control.next_gamma(0.49, "TooFast", 0.01) == 0.499 and control.next_gamma(0.25, "TooSlow", 0.01) == 0.125 and control.next_gamma(0.01, "TooSlow", 0.01) == 0.01
    model = Model()
    assert commit(model, 0, None).outcome == "Empty"
    assert commit(model, 1, Tree(1)).outcome == "BaseVersionMismatch" and model.size == 0
    assert commit(model, 0, Tree(1)).outcome == "Accept" and model.size == 1


def test_grids(spark):
    data, rows = some_rows(spark)
    regions = grids.kd_grids(rows, 40)
    counts = grids.region_of(rows, regions).groupBy("region").count().collect()
    assert sum(r["count"] for r in counts) == 400 and all(r.region is not None for r in counts) and len(counts) == len(regions) > 2
    holds = lambda region, codes: all((codes[f] <= v) == low for f, v, low in region)
    assert all(sum(holds(region, codes) for region in regions) == 1 for _, _, codes, _, _ in data)
    assert grids.kd_grids(rows.limit(0), 40) == [[]] and grids.kd_grids(rows, 400) == [[]]


def test_tasks(spark):
    a, b = control.Task(3, 0.25, 7), control.Task(3, 0.25)
    assert a.same_as(b) and not b.same_as(a) and not a.same_as(control.Task(4, 0.25)) and b.merged(control.Task(9, 0.1, 5, 2)) == control.Task(3, 0.25, 5, 2)
    assert [control.reply(a, a, "Empty"), control.reply(a, a, "Accept"), control.reply(a, b, "Accept")] == ["sender", "nobody", "all"]
    workers = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, None)], "source int, task int")
    assert tuple(control.worker_counts(workers).first()) == (1, 3) and [(r.source, r.place) for r in control.assignments(workers, 2).orderBy("place").collect()] == [(1, 0), (3, 1)]
    rated = spark.createDataFrame([(1, i, c) for i, c in enumerate(["Okay", "Okay", "TooSlow", "TooSlow", "TooFast", "Okay"])], "source int, packet_id int, condition string")
    assert [r.trend for r in control.trend(rated).orderBy("packet_id").collect()] == ["other", "other", "other", "same", "opposite", "other"]


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.latest_sample() is None
    store.write_sample(spark.range(3), 1)
    store.write_sample(spark.range(5), 2)
    assert store.latest_sample()[0] == 2 and store.latest_sample()[1].count() == 5 and store.latest_sample(3) is None
    store.clear()
    assert store.latest_sample() is None
    (tmp_path / "list").write_text("a\nb\n\nc\n")
    assert model_list(spark, f"file://{tmp_path}/list") == ["a", "b"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 0:5\n0 0:0\n")
    stream = refresh.scored_stream(spark.readStream.text(str(tmp_path / "in")), 1, "1", [[0.0, 3.0]], Model())
    refresh.write_strata(stream, str(tmp_path / "strata"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "strata")).count() == 2
    store = Store(spark, f"file://{tmp_path}/s")
    refresh.publish_samples(stream, store.write_sample, str(tmp_path / "c2")).awaitTermination()
    assert store.latest_sample()[0] == 1 and store.latest_sample()[1].count() == 2


def test_samples_by_the_newest_model(spark, tmp_path):
    """A stream's batches are scored by the model that the store has when they come; strata are read by folder, and rows that have left theirs are dropped."""
    store = Store(spark, f"file://{tmp_path}/s")
    tree = Tree(1)
    tree.split(0, 0, 0, -1.0, 1.0)
    store.write_model(Model([tree]))
    spark.createDataFrame([(i, 1 if i % 2 else -1, [i % 2]) for i in range(200)], "row_id long, label int, codes array<int>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("row_id long, label int, codes array<int>").parquet(f"{tmp_path}/in")
    refresh.refresh_samples(stream, store, 50, 1, str(tmp_path / "c")).awaitTermination()
    version, rows = store.latest_sample()
    assert version == 1 and rows.count() == 50 and rows.where("version <> 1 or weight <> 1").count() == 0
    scored = statistics.weighted(spark.createDataFrame([(1, 1, 0.0), (2, 1, -2.0)], "row_id long, label int, score double"))
    store.write_strata(scored, 1)
    store.write_strata(scored, 2)
    back = store.read_strata()
    assert back.where("stratum = 2").count() == 1 and refresh.still_there(back).count() == 2 and refresh.still_there(back.withColumn("weight", F.lit(1.0))).count() == 1


def test_outcome_rates(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 1, "Accept"), ("2024-01-01 00:02:00", 1, "Empty"), ("2024-01-01 00:09:00", 1, "Accept"), ("2024-01-01 00:01:00", 2, "Empty")], "ts string, source int, packet_type string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, source int, packet_type string").parquet(f"{tmp_path}/in")
    refresh.outcome_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.source, r.accepts, r.n) for r in spark.table("rates").collect()) == [(1, 1, 1), (1, 1, 2), (2, 0, 1)]


def test_config():
    c = read_config("num_trees: 3  # trees\npositive: '1'\nresume_training: true\n")
    assert (c.num_trees, c.positive, c.resume_training) == (3, "1", True)
    with pytest.raises(KeyError):
        read_config("num_iterations: 3")
    with pytest.raises(ValueError):
        Config(default_gamma=0.5)


def test_training(spark):
    rng = np.random.default_rng(5)
    data = [(i, [int(x) for x in rng.integers(0, 4, 3)]) for i in range(6000)]
    rows = spark.createDataFrame([(i, 1 if c[0] + c[1] >= 3 else -1, c) for i, c in data], "row_id long, label int, codes array<int>").persist()
    trainer = Trainer(rows, Config(max_bin_size=4, default_gamma=0.1, num_trees=2, num_splits=2, sample_size=6000, batch_size=1000))
    model = trainer.run()
    assert model.size == 2
    assert evaluation.validate(rows, [("m", model)]).first().auroc > 0.8


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A training and a testing file of sparse text."""
    folder, rng = tmp_path_factory.mktemp("files"), np.random.default_rng(5)
    for name, n in (("train", 6000), ("test", 1500)):
        rows = [[int(x) for x in rng.integers(0, 8, 3)] for _ in range(n)]
        (folder / name).write_text("".join(f"{'yes' if c[0] + c[1] >= 7 else 'no'} " + " ".join(f"{i}:{v}" for i, v in enumerate(c) if v) + "\n" for c in rows))
    return folder


def config_of(files, store, **more):
    own = {"num_features": 3, "positive": "yes", "max_bin_size": 8, "default_gamma": 0.1, "num_trees": 2, "num_splits": 2, "sample_size": 6000, "batch_size": 1000, "training_path": f"file://{files}/train", "testing_path": f"file://{files}/test", "store": f"file://{store}"}
    return Config(**own | more)


def test_train_stop_resume_and_test(spark, files, tmp_path):
    """A training that stops and resumes gives the model of one that doesn't; its models are tested with the store's own bins."""
    whole = jobs.train(spark, config_of(files, tmp_path / "whole"))
    first = jobs.train(spark, config_of(files, tmp_path / "parts", num_trees=1))
    assert first.model.size == 1
    again = jobs.train(spark, config_of(files, tmp_path / "parts", num_trees=1, resume_training=True))
    assert whole.model.size == 2 and again.model.trees == whole.model.trees and again.gamma == whole.gamma
    rules_found = [x for x in whole.log if x["event"] == "rule"]
    assert len(rules_found) >= 2 and all(len(x) == 18 and x["sum_c"] > x["bound"] for x in rules_found)
    store = Store(spark, f"file://{tmp_path}/whole")
    assert store.model_versions() == [1, 2] and len(jobs.load_bins(store)) == 3 and store.read_bins().count() > 6 and store.read_examples().count() == 6000
    config = config_of(files, tmp_path / "whole")
    found = {r.size: r for r in jobs.test(spark, config, f"file://{tmp_path}/out").collect()}
    assert found[2].auroc > 0.75 and found[2].ada_loss < 1 and set(found) == {1, 2}
    one_by_one = {r.size: r for r in jobs.test(spark, config_of(files, tmp_path / "whole", incremental_testing=False), f"file://{tmp_path}/out2").collect()}
    assert all(one_by_one[k].auroc == pytest.approx(found[k].auroc) for k in found)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/metrics").count() == 2
    scores = [float(r.value) for r in spark.read.text(f"file://{tmp_path}/out/scores/model=1").collect()]
    assert len(scores) == 1500 and len(set(scores)) > 2
    (tmp_path / "list").write_text(f"{store.model_path(2)}\n\nignored\n")
    listed = config_of(files, tmp_path / "whole", models_list=f"file://{tmp_path}/list", testing_scores_only=True)
    assert jobs.test(spark, listed, f"file://{tmp_path}/out3") is None and spark.read.text(f"file://{tmp_path}/out3/scores/model=0").count() == 1500


def test_only_full_trees_and_a_falling_target(spark):
    """Labels that nothing explains: no rule passes, no tree is kept, and the target falls with every try until they end."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, int(rng.choice([-1, 1])), [int(x) for x in rng.integers(0, 3, 2)]) for i in range(3000)], "row_id long, label int, codes array<int>")
    trainer = Trainer(rows, Config(max_bin_size=3, default_gamma=0.2, num_trees=1, num_splits=2, sample_size=3000, batch_size=1000, min_gamma=0.05))
    assert trainer.run().size == 0 and trainer.failures == 12 and trainer.gamma == 0.05
    tries = [x for x in trainer.log if x["event"] == "try"]
    assert [x["outcome"] for x in tries] == ["FailedToTrigger"] * 12 and [x["gamma"] for x in tries[:3]] == [0.2, 0.1, 0.05]
    assert control.condition_of(1.0) == "TooFast" and control.condition_of(0.5) == "Okay"
