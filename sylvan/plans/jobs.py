"""The two jobs: train(config) makes bins, samples and models in a store; test(config) scores a table with them and writes metrics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, evaluation, statistics
from ..sources import sparse_text
from ..sources.stores import Store, model_list, read_model, write_metrics, write_scores
from .boosting import Trainer
from .config import Config


def load_bins(store: Store, examples: DataFrame | None = None, config: Config | None = None) -> list[list[float]]:
    """The store's bins; where examples are given, they are built from them and published first."""
    if examples is not None:
        store.write_bins(binning.build_bins(examples, config.max_bin_size, config.max_sample_size))
    return binning.edge_arrays(store.read_bins())


def numbered(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """row_id, label, features of a sparse text file; numbers rise with a row's place in the file, with gaps."""
    return sparse_text.read(spark, path, config.num_features, config.positive).withColumn("row_id", F.monotonically_increasing_id())


def train(spark: SparkSession, config: Config) -> Trainer:
    """Bins, binned rows (in the store, in columnar form), and num_trees trees. A new training empties the store first; with resume_training it goes on from what the store has."""
    store = Store(spark, config.store)
    if not (config.resume_training and store.has_examples()):
        store.clear()
        rows = numbered(spark, config.training_path, config)
        store.write_examples(binning.discretize(rows, load_bins(store, rows, config)))
    trainer = Trainer(store.read_examples(), config, store=store)
    if config.resume_training:
        trainer.resume()
    trainer.run()
    return trainer


def test(spark: SparkSession, config: Config, out: str) -> DataFrame | None:
    """Scores the testing table with each listed model (models_list, or all of the store) and its bins, and writes under out: metrics as CSV, unless testing_scores_only, and each
    model's scores by row. Incremental testing adds only the trees after the last model's. Returns the metrics."""
    store = Store(spark, config.store)
    paths = model_list(spark, config.models_list) if config.models_list else [store.model_path(v) for v in store.model_versions()]
    models = [(path, read_model(spark, path)) for path in paths]
    rows = binning.discretize(numbered(spark, config.testing_path, config), load_bins(store))
    for i, (_, model) in enumerate(models):
        scored = statistics.rescore(rows.withColumns({"score": F.lit(0.0), "version": F.lit(0)}), model)
        write_scores(scored, f"{out}/scores/model={i}")
    if config.testing_scores_only:
        return None
    found = evaluation.validate(rows, models, config.incremental_testing)
    write_metrics(found, f"{out}/metrics")
    return found
