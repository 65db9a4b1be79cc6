"""Streaming upserts: writes of nodes and edges that arrive as a stream are merged into Parquet tables.

Merging is keyed and can be repeated, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import merge_nodes


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    done = [s.getPath() for s in fs.listStatus(fs_path) if s.isDirectory()]
    return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_nodes(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest finished version of a table of nodes."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def stream_nodes(writes: DataFrame, label: str, path: str, checkpoint: str) -> StreamingQuery:
    """G1 as a stream: each batch makes version `batch + 1` of the table from the version before it and its writes."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v <= number]
        new = batch.withColumn("_seq", F.lit(1))
        if before:
            old = spark.read.parquet(f"{path}/v={before[-1]}").withColumn("_seq", F.lit(0))
            new = old.unionByName(new, allowMissingColumns=True)
        merge_nodes(new, label, ["_seq"]).write.mode("overwrite").parquet(f"{path}/v={number + 1}")

    return writes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
