"""Connected components over an edge table, as a loop of joins with a written table each round."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='hustings-')}"
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any orderable type to (node, label): the smallest node within reach.

    Each round a node takes the smallest label near it and then that label's own; the loop ends
    when no label moves, which it must, as labels only fall.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def gone(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    edges = edges.where("a <> b").select("a", "b")
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels-0")
    for k in count(1):
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("next"))
        moved = written(step.join(far, "new").select("node", "label", F.least("new", "next").alias("new")), f"labels-{k}")
        labels = moved.select("node", F.col("new").alias("label"))
        gone(f"labels-{k - 1}")
        if not moved.where("label <> new").limit(1).count():
            gone("edges")
            return labels
