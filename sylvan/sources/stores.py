"""Versioned samples, models, bins, metrics and scores under one folder of any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tree import Model


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _versions(self, kind: str) -> list[int]:
        fs, path = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("version=") and fs.exists(self._fs(f"{self.folder}/{kind}/{n}/_SUCCESS")[1])]
        return sorted(int(n.split("=")[1]) for n in done)

    def write_sample(self, rows: DataFrame, version: int) -> None:
        """A version is complete once Spark's committer has marked it; readers see no other."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/sample/version={version}")

    def latest_sample(self, least: int = 0) -> tuple[int, DataFrame] | None:
        """(version, rows) of the newest complete sample of version `least` or later."""
        found = [v for v in self._versions("sample") if v >= least]
        return (found[-1], self.spark.read.parquet(f"{self.folder}/sample/version={found[-1]}")) if found else None

    def read_sample(self, version: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/sample/version={version}") if version in self._versions("sample") else None

    def write_model(self, model: Model, seconds: float = 0.0) -> None:
        row = (json.dumps([seconds, model.size, model.to_dict()]),)
        self.spark.range(1, numPartitions=1).select(F.lit(row[0]).alias("value")).write.mode("overwrite").text(f"{self.folder}/model/version={model.size}")

    def read_model(self, version: int | None = None) -> Model:
        found = self._versions("model")
        if not found:
            raise FileNotFoundError(f"no model under {self.folder}")
        return read_model(self.spark, f"{self.folder}/model/version={found[-1] if version is None else version}")

    def model_versions(self) -> list[int]:
        return self._versions("model")

    def model_path(self, version: int) -> str:
        return f"{self.folder}/model/version={version}"

    def write_state(self, state: dict) -> None:
        """A trainer's state, one version a write; the last complete one counts."""
        version = (self._versions("state") or [0])[-1] + 1
        self.spark.range(1, numPartitions=1).select(F.lit(json.dumps(state)).alias("value")).write.text(f"{self.folder}/state/version={version}")

    def read_state(self) -> dict | None:
        found = self._versions("state")
        return json.loads(self.spark.read.text(f"{self.folder}/state/version={found[-1]}").first()[0]) if found else None

    def write_examples(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/examples")

    def has_examples(self) -> bool:
        fs, path = self._fs(f"{self.folder}/examples/_SUCCESS")
        return fs.exists(path)

    def read_examples(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/examples")

    def write_strata(self, rows: DataFrame, version: int) -> None:
        """A snapshot of scored rows by stratum."""
        rows.write.mode("overwrite").partitionBy("stratum").parquet(f"{self.folder}/strata/version={version}")

    def read_strata(self) -> DataFrame | None:
        """The rows of the newest complete snapshot; a query by stratum reads only that folder."""
        found = self._versions("strata")
        return self.spark.read.parquet(f"{self.folder}/strata/version={found[-1]}") if found else None

    def write_bins(self, edges: DataFrame) -> None:
        edges.write.mode("overwrite").parquet(f"{self.folder}/bins")

    def read_bins(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/bins")

    def clear(self) -> None:
        fs, path = self._fs(self.folder)
        fs.delete(path, True)


def read_model(spark: SparkSession, path: str) -> Model:
    _, size, model = json.loads(spark.read.text(path).first()[0])
    out = Model.from_dict(model)
    if out.size != size:
        raise ValueError(f"{path} names {size} trees and holds {out.size}")
    return out


def model_list(spark: SparkSession, path: str) -> list[str]:
    """Model paths, one a line, up to the first blank line."""
    out: list[str] = []
    for (line,) in spark.read.text(path, wholetext=True).limit(1).collect():
        for x in line.split("\n"):
            if not x.strip():
                break
            out.append(x.strip())
    return out


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scores(scored: DataFrame, path: str, order: str = "row_id") -> None:
    """One score a line in row order, as part files whose names sort in that order."""
    scored.orderBy(order).select(F.col("score").cast("string").alias("value")).write.mode("overwrite").text(path)
