"""Places that hold the pieces of a log: folders, tables, and sources asked in order of priority."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: computes the name of a piece from its bytes; SHA-256 here. A network's own commitment scheme can be put in its place.
Verifier = Callable[[bytes], str]


def sha256_name(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class BlobSource(Protocol):
    """Anything that can be asked for pieces by name; it may return fewer than asked, or raise."""

    name: str

    def fetch(self, wanted: Iterable[str]) -> dict[str, bytes]: ...


class FolderSource:
    """A folder of ``<name>.blob`` files; a local stand-in for archives and gateways."""

    def __init__(self, name: str, path: str) -> None:
        self.name, self.path = name, path

    def fetch(self, wanted: Iterable[str]) -> dict[str, bytes]:
        out = {}
        for w in wanted:
            p = os.path.join(self.path, f"{w}.blob")
            if os.path.isfile(p):
                with open(p, "rb") as f:
                    out[w] = f.read()
        return out


def gather(sources: list[BlobSource], wanted: list[str], verify: Verifier = sha256_name) -> tuple[dict[str, bytes], list[dict]]:
    """Verified pieces by name, and an attempt per source asked: each only for what the ones before it lacked.

    outcome: ok (all), partial, nothing or error. Bytes whose name differs are rejected.
    """
    have: dict[str, bytes] = {}
    log: list[dict] = []
    for s in sources:
        left = [w for w in dict.fromkeys(wanted) if w not in have]
        if not left:
            break
        try:
            got = s.fetch(left)
        except Exception as e:  # noqa: BLE001 - a failing source must not stop the others
            log.append({"source": s.name, "outcome": "error", "detail": str(e)[:200], "verified": 0, "rejected": 0})
            continue
        good = {k: v for k, v in got.items() if k in set(left) and verify(v) == k}
        have |= good
        outcome = "ok" if len(good) == len(left) else "partial" if good else "nothing"
        log.append({"source": s.name, "outcome": outcome, "detail": "", "verified": len(good), "rejected": len(got) - len(good)})
    return have, log


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """hash, data of the blob files of a folder; the name in the file name is only a claim."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.blob$", 1).alias("hash"), F.col("content").alias("data"))


def verified(blobs: DataFrame) -> DataFrame:
    """Pieces whose bytes have the name they claim."""
    return blobs.filter(F.sha2("data", 256) == F.col("hash"))


def failing(blobs: DataFrame, key: str = "seq") -> DataFrame:
    """Numbers of stored pieces whose bytes no longer match their name."""
    return blobs.filter(F.sha2("data", 256) != F.col("hash")).select(key)


def missing_numbers(blobs: DataFrame, count: int | Column) -> DataFrame:
    """seq of 0 to count - 1 that are not stored."""
    n = count if isinstance(count, Column) else F.lit(count)
    every = blobs.sparkSession.range(1).select(F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("seq"))
    return every.join(blobs.select("seq"), "seq", "left_anti")


def append_blobs(path: str, new: DataFrame) -> int:
    """Append verified pieces (seq, hash, data) that are not stored yet; how many were written.

    A stored piece with another name under the same number is a conflict and fails before anything is written.
    """
    spark = new.sparkSession
    good = verified(new).dropDuplicates(["seq"])
    try:
        stored = spark.read.parquet(path).select("seq", F.col("hash").alias("__hash"))
    except Exception:  # noqa: BLE001 - nothing stored yet
        stored = None
    if stored is not None:
        clash = good.join(stored, "seq").filter("hash != __hash").select("seq").limit(5).collect()
        if clash:
            raise ValueError(f"other pieces are stored as {[r.seq for r in clash]}")
        good = good.join(stored.select("seq"), "seq", "left_anti")
    rows = good.select("seq", "hash", "data")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def export_blobs(blobs: DataFrame, folder: str) -> None:
    """One ``<hash>.blob`` file per piece, written by the tasks; the folder must be one all executors see."""

    def write(batches):
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        n = 0
        for b in batches:
            for h, d in zip(b["hash"], b["data"], strict=True):
                part = os.path.join(folder, f".{h}.{os.getpid()}.part")
                with open(part, "wb") as f:
                    f.write(d)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(part, os.path.join(folder, f"{h}.blob"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    blobs.select("hash", "data").mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
