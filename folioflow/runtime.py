"""Session helpers: the shared folder for intermediate tables, and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "spark.folioflow.shipped"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares, from ``spark.checkpoint.dir``.

    Where none is named, a local session (tests) gets one of its own. On a cluster that is
    an error: what one executor writes to its own disk no other can read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage at files that outlive any executor. They go with ``forget``, or
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table of ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/folioflow/" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once a session.

    The zip goes to the shared folder, so it works wherever the driver was started.
    """
    if spark.conf.get(_SHIPPED, None):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = shared_dir(spark)
    local = folder[len("file://"):] if folder.startswith("file://") else folder if folder.startswith("/") else None
    staging = os.path.join(local, "folioflow") if local else tempfile.mkdtemp(prefix="folioflow-code-")
    os.makedirs(staging, exist_ok=True)
    target = os.path.join(staging, f"folioflow-code-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("folioflow", os.path.relpath(full, here)))
    if not local:  # the driver hands a remote shared folder's copy to the executors
        jvm = spark._jvm
        remote = jvm.org.apache.hadoop.fs.Path(f"{folder}/folioflow/{os.path.basename(target)}")
        remote.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path("file://" + target), remote)
        target = remote.toString()
    spark.sparkContext.addPyFile(target)
    spark.conf.set(_SHIPPED, "true")
