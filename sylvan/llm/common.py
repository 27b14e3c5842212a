"""What the operators share: the cluster's shared folder, written tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch carries to Python, so that a batch of very long texts still fits in a worker.
ARROW_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ARROW_ROWS rows; a session that asks for fewer keeps its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where that is unset, a temporary one if there is no machine but this."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df from a table written in the shared folder: cuts the lineage, and any executor can read it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() wrote; only for tables that nothing reads any more."""
    if path := getattr(df, "_written_to", None):
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


#: Links that one task may hold (16 bytes each, some 200 as a union-find); more are joined in distributed rounds.
LINKS_IN_A_TASK = 500_000


def components(links: DataFrame, in_a_task: int = LINKS_IN_A_TASK) -> DataFrame:
    """(node, root) for every node of links (a, b bigint) that isn't its component's smallest; root is the smallest node.

    The links are written and counted. Up to `in_a_task` of them go through a union-find in one task. More do not:
    alternating large-star and small-star rounds over written tables. Each round takes a minimum per node (pre-aggregated) and joins it back,
    so a hub of any degree is split by the skew join rather than gathered in one task.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), "links")
    if edges.count() <= in_a_task:
        return map_columns(edges.coalesce(1), _union_find, "node bigint, root bigint")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: of each node's smaller neighbours, all point to the least
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()
        small = written(small, "small")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(large)
        forget(edges)
        edges = small
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _union_find(batches):
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for u, v in zip(b["u"], b["v"], strict=True):
            p, q = top(u), top(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = sorted(x for x in parent if top(x) != x)
    for at in range(0, len(nodes), 10_000):
        own = nodes[at : at + 10_000]
        yield {"node": own, "root": [top(x) for x in own]}


def map_columns(df: DataFrame, body, schema: str) -> DataFrame:
    """mapInArrow with plain columns: body gets an iterator of dicts of lists and yields dicts of lists or arrays.

    (As lists, null ids stay null and long ids exact, which pandas' floats would not keep.)
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for out in body(b.to_pydict() for b in batches):
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return df.mapInArrow(run, schema)
