"""Session settings and the few helpers that every operator uses."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str = "local[8]", **extra: str) -> SparkSession:
    """A session for local runs; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("larkspur")
    for key, value in {**CONF, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt over all cores if it comes from fewer files than there are: for work that costs far more than moving the
    rows. Inputs of many files stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's `spark.checkpoint.dir`. A temporary one stands in for it where the
    driver is the only machine; elsewhere a missing setting is an error, as no executor could read such a folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="larkspur-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, so that later reads neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """`df` written as a Parquet table and read back."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from `columns` (without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), "larkspur_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._larkspur_shipped = True
