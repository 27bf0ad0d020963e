"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where set.

    A local folder is used only on a local master, as in tests; a cluster
    without the setting is refused, since a machine-local path would lose data.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    path = os.path.join(tempfile.gettempdir(), f"lexmill-{os.getpid()}")
    if not os.path.isdir(path):
        os.makedirs(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lexmill/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder of this application in the shared folder."""
    return f"{_tables(spark)}/{uuid.uuid4().hex}"


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one small file wherever the shared folder is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target)
    out.write(bytearray(content))
    out.close()


def clean_up(spark: SparkSession) -> bool:
    """Deletes the tables that this application wrote to the shared folder; call it once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut_lineage(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives the loss of an executor, keeps later plans short and is
    computed once however often it is read.
    """
    spark = df.sparkSession
    path = scratch(spark)
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
