"""Ordered digests, hash chains and the files they cover.

SHA-256 depends on order and cannot be merged, so a group's digest is one pass over its sorted lines. The
lines are range-sorted by the whole cluster first; hashing then streams through the sorted partition of a
group batch by batch and holds no group in memory, however large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = hashlib.sha256(b"").hexdigest()


class _Whole:
    """SHA-256 of lines, each with a newline behind it."""

    def __init__(self, seed: str) -> None:
        self.h = hashlib.sha256()

    def add(self, line: str) -> None:
        self.h.update(line.encode())
        self.h.update(b"\n")

    def value(self) -> str:
        return self.h.hexdigest()


class _Chain:
    """h = SHA-256(hex(h) || line), from a seed."""

    def __init__(self, seed: str) -> None:
        self.head = seed

    def add(self, line: str) -> None:
        self.head = hashlib.sha256((self.head + line).encode()).hexdigest()

    def value(self) -> str:
        return self.head


def _streamed(kind: type, seed: str = ""):
    """mapInPandas function: (group, line), the lines of a group one after the other, to (group, n_lines, digest)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state, n = None, None, 0
        for b in batches:
            rows = []
            for g, line in zip(b["g"], b["line"], strict=True):
                if state is None or g != group:
                    if state is not None:
                        rows.append((group, n, state.value()))
                    group, state, n = g, kind(seed), 0
                state.add(line or "")
                n += 1
            if rows:
                yield pd.DataFrame(rows, columns=["g", "n_lines", "digest"])
        if state is not None:
            yield pd.DataFrame([(group, n, state.value())], columns=["g", "n_lines", "digest"])

    return run


def _per_group(lines: DataFrame, group: str, order: list[str], payload: str, step) -> DataFrame:
    """g, n_lines, digest of each group's sorted lines. A group lies in one partition, sorted with spill, and no task holds more than a batch of it."""
    g = F.coalesce(F.col(group).cast("string"), F.lit(""))
    keyed = lines.select(g.alias("g"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.col(payload).alias("line"))
    placed = keyed.repartition("g").sortWithinPartitions("g", *(f"__o{i}" for i in range(len(order)))).select("g", "line")
    return placed.mapInPandas(step, "g string, n_lines bigint, digest string")


def group_digests(lines: DataFrame, group: str, order: list[str], payload: str, groups: DataFrame | None = None) -> DataFrame:
    """group, n_lines, sha256 of the sorted lines of each group. groups: names that are listed even without lines.

    A group lies in one partition, as its digest is one sequential pass; different groups run side by side. Null groups are one group.
    """
    digests = _per_group(lines, group, order, payload, _streamed(_Whole))
    if groups is not None:
        digests = groups.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g")).distinct().join(digests, "g", "left")
    name = F.col("g").cast(lines.schema[group].dataType)
    return digests.select(name.alias(group), F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce("digest", F.lit(EMPTY)).alias("sha256"))


def chain_heads(lines: DataFrame, group: str, order: list[str], link: str, seed: str) -> DataFrame:
    """group, n, head: h = SHA-256(hex(h) || link) over the links of each group in order, from ``seed``; streamed like :func:`group_digests`."""
    heads = _per_group(lines, group, order, link, _streamed(_Chain, seed))
    return heads.select(F.col("g").cast(lines.schema[group].dataType).alias(group), F.col("n_lines").alias("n"), F.col("digest").alias("head"))


def contiguous(seq: Column) -> Column:
    """Aggregate: whether sequence numbers are exactly 0 to n - 1."""
    n = F.count(seq)
    return (n == 0) | ((F.min(seq) == 0) & (F.max(seq) == n - 1) & (F.count_distinct(seq) == n))


def write_groups(lines: DataFrame, group: str, order: list[str], payload: str, path: str, compression: str = "none") -> None:
    """One text file per group under ``path/<group>=.../``, lines in order.

    The group leads the sort, as the partitioned writer sorts by it again and would undo any other order.
    """
    out = lines.select(F.col(group), *order, F.col(payload).alias("value")).repartition(group).sortWithinPartitions(group, *order)
    out.select(group, "value").write.mode("errorifexists").partitionBy(group).option("compression", compression).text(path)
