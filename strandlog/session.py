"""Reading tables, and cutting lineage through a folder that every executor shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, unless their path already has it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in known or os.path.abspath(os.getcwd()) == home or spark.sparkContext.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="strandlog-package-")
    shutil.copytree(os.path.join(home, "strandlog"), os.path.join(folder, "in", "strandlog"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "strandlog"), "zip", os.path.join(folder, "in")))
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(spark.sparkContext.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a session without one (as in tests) gets its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strandlog-")
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    Cuts the lineage, so what a non-deterministic placement (such as the bounds of a range shuffle)
    once decided stays decided when executors are lost. Unlike ``checkpoint()`` the plan runs once and
    the copy is columnar. The copies go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark.sparkContext, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for sc, path in _written:
        try:
            jvm = sc._jvm  # noqa: SLF001
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


atexit.register(_remove_written)
