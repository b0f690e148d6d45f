"""Append to the log from a stream of landed files, so that a run that is repeated changes nothing.

The stream is read until nothing new is there (``availableNow``). Every micro-batch computes its own
additions against what is published, and is committed under a guard: the number of rows the log had when
the additions were computed. A second writer, or a micro-batch that runs again after a crash, finds
its rows published and appends none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlog.sources.files import Folder


class Conflict(RuntimeError):
    """Another writer appended in between."""


def append_new(batch: DataFrame, path: str, key: list[str], expected: int | None = None) -> int:
    """Append the rows of ``batch`` whose keys are not in the log at ``path``; how many.

    expected: number of batches the caller saw; fails if the log has another number, as the rows were then chosen
    against an older state. Of equal keys in the batch the first by all columns counts.
    """
    spark = batch.sparkSession
    log = Folder(spark, path)
    have = sorted(int(n[6:]) for n in log.names() if n.startswith("batch="))
    if expected is not None and len(have) != expected:
        raise Conflict(f"the log has {len(have)} batches and {expected} were expected")
    known = spark.read.schema(batch.schema).parquet(path) if have else spark.createDataFrame([], batch.schema)
    first = batch.groupBy(*key).agg(F.min(F.struct(*(c for c in batch.columns if c not in key))).alias("__r")).select(*key, "__r.*").select(*batch.columns)
    new = first.join(known.select(*key), key, "left_anti").persist()
    try:
        n = new.count()
        if n:
            number = (have[-1] + 1) if have else 0
            new.write.mode("overwrite").parquet(log.at(f"_staging-{number}"))
            if f"batch={number}" in log.names() or not log.move(f"_staging-{number}", f"batch={number}"):
                raise Conflict(f"another writer appended batch {number}")
    finally:
        new.unpersist()
    return n


def run_available(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, key: list[str], condition: str = "true") -> int:
    """Process all landed parquet files of ``source`` that were not processed yet; how many rows were appended."""
    Folder(spark, path).make()
    added: list[int] = []

    def commit(batch: DataFrame, _: int) -> None:
        added.append(append_new(batch.filter(condition), path, key))

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(added)
