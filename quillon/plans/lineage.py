"""Cutting lineage and choosing broadcasts by counted size."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, in local mode alone, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
        known = sc._jsc.sc().getCheckpointDir()
    return (named or known.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the session's shared folder, so that a lost executor costs no recomputation from the start."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def global_ranks(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """df with dense ranks from 0 by `order`, without gathering rows in one task.

    Rows are range-partitioned and sorted, cut there, and numbered within
    their partitions; only the partitions' row counts pass the driver.
    """
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed)
    counts = placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()
    offset, rows = 0, []
    for p, n in sorted(tuple(r) for r in counts):
        rows.append((p, offset))
        offset += n
    offsets = df.sparkSession.createDataFrame(rows, "_p long, _offset long")
    out = placed.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_p"))  # a row per partition
    return out.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_offset")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt to all cores; a larger one as it is scanned.

    A file of one row group is one task, however it is split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
