"""Session helpers shared by every operator."""

from __future__ import annotations

import gc
import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only an unset one (tests, local runs) gets a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = os.environ.get("SKARN_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="skarn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", given)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*checkpoints: DataFrame) -> None:
    """Deletes checkpoints that nothing will read again, and has Spark delete the shuffle files of plans that are gone.

    Otherwise both stay until the driver happens to collect its garbage, and checkpoints even longer where
    spark.cleaner.referenceTracking.cleanCheckpoints is off. What was made of the given frames must be cut before.
    """
    for df in checkpoints:
        jvm, rdd = df.sparkSession._jvm, df._jdf.queryExecution().analyzed().rdd()
        path = jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # the handles of frames that Python has dropped
    SparkSession.active()._jvm.System.gc()


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under a plan without statistics, for loops over checkpoints.

    A checkpoint keeps the size that was estimated for its plan. Joins multiply estimates, so in a loop their number of
    digits would double with every round.
    """
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_skarn_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    name = f"skarn-{hashlib.sha256(data.getvalue()).hexdigest()[:12]}.zip"
    folder = tempfile.mkdtemp(prefix="skarn-code-")  # on the driver; Spark serves it to the executors from here
    Path(folder, name).write_bytes(data.getvalue())
    sc.addPyFile(f"{folder}/{name}")
    sc._skarn_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Over all cores what a scan yields in fewer partitions than there are cores; larger inputs stay as they are.

    Python work on a file of one row group would otherwise run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
