"""Streams: examples into strata, strata totals kept up to date, samples published by version, and the commit log's rates over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import binning, sampling, statistics
from ..plans.tree import Model
from ..sources.sparse_text import parse
from ..sources.stores import Store


def scored_stream(lines: DataFrame, width: int, positive: str, edges: list[list[float]], model: Model) -> DataFrame:
    """A stream (or table) of text lines as binned, scored rows with weight and stratum: parse, bin, score, assign; no state."""
    rows = binning.discretize(parse(lines, width, positive), edges)
    rows = rows.withColumns({"score": model.score(F.col("codes")), "version": F.lit(model.size)})
    return statistics.weighted(rows)


def write_strata(stream: DataFrame, path: str, checkpoint: str):
    """Rows into one folder a stratum; exactly once by the sink's log. Trigger: what is there now, then stop."""
    return stream.writeStream.format("parquet").partitionBy("stratum").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_samples(stream: DataFrame, publish, checkpoint: str):
    """Each micro-batch as a sample version: publish(rows, version). A batch that runs again has the same number, so it overwrites its own version."""
    return stream.writeStream.foreachBatch(lambda rows, n: publish(rows, n + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_samples(binned: DataFrame, store: Store, capacity: int, seed: int, checkpoint: str):
    """A stream of binned rows (row_id, label, codes) into sample versions: each micro-batch is scored by the newest model that the store has when it comes, drawn by
    weight and published. A batch that runs again overwrites its own version."""

    def publish(rows: DataFrame, n: int) -> None:
        model = store.read_model() if store.model_versions() else Model()
        scored = statistics.rescore(rows.withColumns({"score": F.lit(0.0), "version": F.lit(0)}), model)
        store.write_sample(statistics.init_sample(sampling.draw(scored, capacity, seed + n), model.size), n + 1)

    return binned.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def still_there(rows: DataFrame) -> DataFrame:
    """Of weighted rows that were read from a stratum's folder, those whose weight is still that stratum's."""
    return rows.where(C.stratum(F.col("weight")) == F.col("stratum"))


def outcome_rates(packets: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Accepts and packets by source and event-time window of a packet stream (ts, source, packet_type)."""
    by = packets.withWatermark("ts", late).groupBy(F.window("ts", window), "source")
    return by.agg(F.sum((F.col("packet_type") == "Accept").cast("int")).alias("accepts"), F.count("*").alias("n"))
