"""Shared folder, written intermediates and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROUNDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="larder-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/larder-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b longs): comp is the smallest node reachable.

    Contraction: every node hangs on its smallest neighbour, trees are flattened by pointer jumping, edges are renamed to
    the roots, and so on until none is left.  Each round at least halves the nodes; all rounds are tables, nothing is
    collected but counts.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    whole = None
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parent = settle(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("up")))
        for _ in range(MAX_ROUNDS):
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = settle(parent.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        else:
            raise RuntimeError("pointer jumping did not end")
        if whole is None:
            whole = parent.select("node", F.col("up").alias("comp"))
        else:
            step = parent.select(F.col("node").alias("comp"), "up")
            whole = settle(whole.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        to_a = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        to_b = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = settle(
            edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    else:
        raise RuntimeError("contraction did not end")
    return whole if whole is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
