"""Session helpers: table access, checkpoint folder, partition sizing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Only where the session names none and runs in one process (local mode, as
    in tests) a temporary folder is taken instead, removed at the end; a
    cluster without a shared folder is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="veilgauge-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


_LOCAL: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut: written to the shared folder and read again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """Tasks that run at once, as far as the session tells; at least 2."""
    return max(2, spark.sparkContext.defaultParallelism)


#: Inputs of fewer partitions than this are spread before costly work on each row.
FEW_PARTITIONS = 8


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as tasks run at once if it comes as a handful only, such as one small file."""
    n = slots(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < min(n, FEW_PARTITIONS) else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    home = Path(__file__).resolve().parent
    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="veilgauge-code-"), "veilgauge"), "zip", home.parent, home.name)
    context.addPyFile(packed)
