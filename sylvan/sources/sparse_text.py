"""Sparse text: one example a line, `label index:value ...`, indices from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def parse(lines: DataFrame, width: int, positive: str, missing: float = 0.0) -> DataFrame:
    """label, features (and all columns but `value`) of every line that isn't blank. Too large an index is an error, as in any dense store."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.where(F.trim("value") != "").withColumn("_t", tokens)
    rest = F.filter(F.slice("_t", 2, F.greatest(F.lit(1), F.size("_t"))), lambda p: F.instr(p, ":") > 0)
    largest = F.array_max(F.transform(rest, lambda p: F.substring_index(p, ":", 1).cast("int")))
    checked = F.when(largest >= width, F.raise_error(F.lit(f"a feature index is not below {width}"))).otherwise(C.dense(rest, width, missing))
    others = [c for c in lines.columns if c != "value"]
    return rows.select(*others, C.binary_label(F.get("_t", F.lit(0)), positive).alias("label"), checked.alias("features"))


def read(spark: SparkSession, path: str, width: int, positive: str, missing: float = 0.0) -> DataFrame:
    return parse(spark.read.text(path), width, positive, missing)


def read_first(spark: SparkSession, path: str, n: int, width: int, positive: str) -> DataFrame:
    """The first n examples; fewer if the file ends."""
    return parse(spark.read.text(path).where(F.trim("value") != "").limit(n), width, positive)


def from_columns(df: DataFrame, label: str, names: list[str], keep: list[str] = ()) -> DataFrame:
    """label, features from a table's columns; null and NaN count as 0."""
    return df.select(*keep, F.col(label).cast("int").alias("label"), F.array(*(F.nanvl(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) for n in names)).alias("features"))


def write_examples(examples: DataFrame, path: str) -> None:
    """The binary form: parquet, read again with spark.read.parquet."""
    examples.write.mode("overwrite").parquet(path)
