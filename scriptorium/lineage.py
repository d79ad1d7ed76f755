"""Tables written between the steps of a job.

Iterative operators and operators that read an intermediate result twice write it as
Parquet below the folder the cluster names in ``spark.checkpoint.dir``. That folder is
shared by all executors, so a lost executor costs a re-read, never the job, and the
plan behind the table is cut. Where the setting is absent (tests, a laptop) a local
folder is used, and only with a local master.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; what is written there is deleted when the application ends."""
    path = f"{shared_folder(spark)}/scriptorium/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that no plan reads any longer."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition an input that arrives in too few pieces to keep the cores busy.

    A table of many files or row groups is left as it is, so that large inputs are
    never shuffled for this.
    """
    wanted = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() * 2 < wanted else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once.

    Workers that cannot import it from a path of their own (a driver started elsewhere,
    executors without the repository) then find it.
    """
    context = spark.sparkContext
    if getattr(context, "_scriptorium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._scriptorium_shipped = True
