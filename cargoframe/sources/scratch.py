"""Scratch tables on storage that driver and executors share, and shipping of this package.

The folder is the cluster's ``spark.checkpoint.dir``. Only a purely local session without
that setting gets a temporary folder of its own.
"""

import contextlib
import io
import os
import tempfile
import time
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "CARGOFRAME_SHIPPED"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession) -> str:
    """The shared folder named by the session; refuses a cluster without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="cargoframe-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{folder(spark)}/cargoframe/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: later stages survive lost executors.

    ``lean``: written small, and the shuffles behind the frame leave the disks.
    """
    path = place(df.sparkSession, name)
    (df.write.option("compression", "zstd") if lean else df.write).parquet(path)
    if lean:
        free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver's garbage with them is collected, which may else take long.
    Events on their way to listeners still hold the finished queries, so these are waited for, up to 10 s;
    what a query holds goes at the second collection."""
    with contextlib.suppress(Py4JJavaError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.2)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths through the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    Unless the session says otherwise, rows go to them in batches of about 4 MB: neither side then
    holds thousands of whole texts or sets at once.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")
    context: SparkContext = spark.sparkContext
    if getattr(context, _SHIPPED, None):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for here, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    target = os.path.join(tempfile.mkdtemp(prefix="cargoframe-ship-"), "cargoframe.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(target)
    setattr(context, _SHIPPED, True)
