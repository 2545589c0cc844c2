"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (a local test) is a temporary
    folder set; elsewhere other executors couldn't read it, which is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioweave-"))
    return spark.sparkContext.getCheckpointDir()


def full_uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark would read it by, so that tasks open the same store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a full URI and the path in it; of a plain path, this machine's files."""
    return fs.FileSystem.from_uri(uri) if "://" in uri and not uri.startswith("file:") else (fs.LocalFileSystem(), re.sub("^file:/*", "/", uri))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def xor_key(text: Column) -> Column:
    """A 64-bit key of a text that tells a null text from an empty one."""
    return F.xxhash64(text, text.isNull())


def smallest_reachable(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph of longs: rows (node, root).

    ``root`` is the smallest node reachable. Minimum labels travel along edges and then
    jump to their own label's label, so long chains need logarithmically many rounds.
    Labels only fall; their unchanged sum ends the loop. Every round is checkpointed.
    Self-loops, repeated edges and null ends are allowed (null ends are ignored).
    """
    pair = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).dropna()
    both = cut(pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root"))
    total = None
    while True:
        told = both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("root"))
        near = labels.unionByName(told).groupBy("node").agg(F.min("root").alias("root"))
        # Both sides take the same shuffle of ``near``.
        up = near.select(F.col("node").alias("up"), F.col("root").alias("top"))
        labels = cut(near.join(up, near.root == up.up).select("node", F.least("root", "top").alias("root")))
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total:
            return labels
        total = now


def hash_bound(share: float) -> int:
    """The signed 64-bit number that a ``share`` of all hashes lie at or below."""
    return min(int(share * 2**64), 2**64 - 1) - 2**63
