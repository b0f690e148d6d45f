"""Scans of landed feeds: which groups there are, which changed, their lines, and whether they are complete."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.sources.files import Folder
from strandlog.sources.responses import Failed, Response


def groups(files: DataFrame, group: str = "organism") -> list[str]:
    """The sorted names of the groups a feed serves; none, or a blank one, is an error."""
    names = sorted(r[0] for r in files.select(group).distinct().collect() if r[0] is not None)
    if not names or any(not n.strip() for n in names):
        raise ValueError("the feed serves no groups, or one without a name")
    return names


def land(get: Callable[[str, Mapping[str, str]], Response], url: str, folder: Folder, name: str) -> tuple[bool, int | None]:
    """Land a feed's file unless the server says that it is the one landed before: (whether it is new, its declared number of lines).

    ``get`` takes a URL and headers. The entity tag and the declared total stand in ``<name>.json`` beside the file, which is written
    last: a file without it is fetched again. Any answer but 200 and 304 leaves everything as it was and raises.
    """
    names = folder.names()
    known = json.loads(folder.read(f"{name}.json")) if name in names and f"{name}.json" in names else {}
    answer = get(url, {"If-None-Match": known["etag"]} if known.get("etag") else {})
    if answer.status == 304 and known:
        return False, known["total"]
    if answer.status != 200:
        raise Failed(f"HTTP {answer.status} for {url}")
    headers = {k.lower(): v for k, v in answer.headers.items()}
    total = headers.get("x-total-records", "")
    folder.remove(f"{name}.json")
    folder.put(name, answer.body)
    folder.put(f"{name}.json", json.dumps({"etag": headers.get("etag"), "total": int(total) if total.isdigit() else None}).encode())
    return True, int(total) if total.isdigit() else None


def forget(folder: Folder, name: str) -> None:
    """Have a file fetched again, as when its lines are not as many as declared."""
    folder.remove(f"{name}.json")


def changed_files(files: DataFrame, feed: tuple[str, ...] = ("mirror", "organism")) -> DataFrame:
    """Files to read again: their entity tag differs from that of the file before, or either is unknown.

    files: feed columns, file_no, etag. The files that are not returned equal the one before and its rows can be reused.
    """
    w = Window.partitionBy(*feed).orderBy("file_no")
    return files.withColumn("__before", F.lag("etag").over(w)).filter("etag is null or __before is null or etag != __before").drop("__before")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, path: the non-empty lines of text files, plain or compressed (gzip, zstd by suffix). The last line may lack its newline."""
    return spark.read.text(path).filter("value != ''").select("value", F.input_file_name().alias("path"))


def check_complete(lines: DataFrame, declared: int | None) -> int:
    """The number of lines; raises if a declared number differs, since absence means withdrawal."""
    n = lines.count()
    if declared is not None and n != declared:
        raise ValueError(f"the feed has {n} lines and declared {declared}")
    return n


def manifest_blobs(spark: SparkSession, path: str) -> DataFrame:
    """seq, hash, block, block_time of a manifest file: a JSON list of pieces, or an object with the list under ``blobs``."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    get = lambda c, p, t: F.try_variant_get(c, p, t)
    items = F.coalesce(get(F.col("v"), "$.blobs", "array<variant>"), get(F.col("v"), "$", "array<variant>"))
    one = v.select(F.explode(items).alias("b"))
    out = one.select(get(F.col("b"), "$.seq", "bigint").alias("seq"), get(F.col("b"), "$.hash", "string").alias("hash"), get(F.col("b"), "$.block", "bigint").alias("block"), get(F.col("b"), "$.blockTime", "bigint").alias("block_time"))
    return out.withColumn("seq", F.coalesce("seq", F.raise_error(F.lit("a piece of the manifest has no number")).cast("bigint")))


def tooling(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, content of the files under a folder whose names match a pattern, sorted by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").orderBy("path")


def log_pages(first: int, last: int, size: int) -> list[tuple[int, int]]:
    """Inclusive block ranges of at most ``size`` that cover first to last, the partitions of a paged log scan."""
    return [(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]
