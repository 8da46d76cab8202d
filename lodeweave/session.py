"""Session helpers: reading tables, checkpoints in the shared folder, shipping the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that workers need no copy of the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lodeweave-"), "lodeweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs in one process (tests).
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="lodeweave-checkpoints-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where the scan gives fewer partitions than there are cores; else the frame as it is.

    A table of a few row groups would keep most cores idle in front of costly expressions; a large one is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores and cores > 1 and _small(df) else df


def _small(df: DataFrame) -> bool:
    """Whether the plan's estimated size is under 32 MB a core."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size < (32 << 20) * df.sparkSession.sparkContext.defaultParallelism
