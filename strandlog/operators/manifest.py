"""Batch manifests: what each batch adds per organism, the running totals, links between batches, and checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZEROS = "0" * 64
#: compressed bytes since the last index at which a batch must carry one
INDEX_THRESHOLD = 16_777_216


def batch_counts(first_entries: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """batch, organism, entries_in_batch, published_total, withdrawn_in_batch, withdrawn_total for every organism known at the batch.

    first_entries: each key once with its first batch; withdrawals: organism, batch, withdrawn_in_batch,
    withdrawn_total (see ``state_after_each_batch``). Batches x organisms is small; rows are counted before it is built.
    """
    added = first_entries.groupBy("batch", "organism").agg(F.count(F.lit(1)).alias("entries_in_batch"))
    batches = added.select("batch").union(withdrawals.select("batch")).distinct()
    starts = added.select("organism", "batch").union(withdrawals.select("organism", "batch")).groupBy("organism").agg(F.min("batch").alias("since"))
    grid = batches.join(starts, F.col("batch") >= F.col("since")).select("batch", "organism")
    w = Window.partitionBy("organism").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(added, ["batch", "organism"], "left").join(withdrawals, ["batch", "organism"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "batch", "organism", zero("entries_in_batch").alias("entries_in_batch"), F.sum(zero("entries_in_batch")).over(w).alias("published_total"),
        zero("withdrawn_in_batch").alias("withdrawn_in_batch"), F.coalesce(F.last("withdrawn_total", ignorenulls=True).over(w), F.lit(0)).alias("withdrawn_total"),
    )


def link_manifests(manifests: DataFrame, digest: str = "digest", blobs: str = "n_blobs") -> DataFrame:
    """Each manifest with previous_digest, first_blob and blob_count_after in batch order; zeros stand before the first.

    One row per batch: the global window runs over the log's manifests, not over its records.
    """
    w = Window.orderBy("batch")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(blobs).over(upto)
    return manifests.select("*", F.coalesce(F.lag(digest).over(w), F.lit(ZEROS)).alias("previous_digest"), (after - F.col(blobs)).alias("first_blob"), after.alias("blob_count_after"))


def check_links(manifests: DataFrame) -> DataFrame:
    """batch and problem of manifests whose number, previous digest or first blob does not follow from the one before."""
    w = Window.orderBy("batch")
    lag = lambda c: F.lag(c).over(w)
    problem = (
        F.when(lag("batch").isNull() & (F.col("batch") != 0), "first").when(F.col("batch") != F.coalesce(lag("batch") + 1, F.lit(0)), "number")
        .when(F.col("previous_digest") != F.coalesce(lag("digest"), F.lit(ZEROS)), "digest").when(F.col("first_blob") < F.coalesce(lag("blob_count_after"), F.lit(0)), "blobs")
    )
    return manifests.select("batch", problem.alias("problem")).filter("problem is not null")


def compare_manifest(stated: DataFrame, computed: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, status (match, differs, only_stated, only_computed): full outer join with null-safe equality of all values."""
    a = stated.select(F.col(key), F.struct(*values).alias("s"))
    b = computed.select(F.col(key), F.struct(*values).alias("c"))
    both = a.join(b, key, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"s.{v}").eqNullSafe(F.col(f"c.{v}"))
    status = F.when(F.col("c").isNull(), "only_stated").when(F.col("s").isNull(), "only_computed").when(same, "match").otherwise("differs")
    return both.select(key, status.alias("status"))


def index_batches(batches: DataFrame, size: str, threshold: int = INDEX_THRESHOLD) -> DataFrame:
    """batch, size, since_index, has_index: an index is due when the sizes since the last one reach the threshold.

    The running sum starts again after each index, so it is one pass over the batches in order (one small row each); null sizes count as 0.
    """

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for b in parts:
            since = []
            for n in b["size"]:
                total += int(n)
                since.append(total)
                total = 0 if total >= threshold else total
            yield pd.DataFrame({"batch": b["batch"], "size": b["size"], "since_index": since, "has_index": [x >= threshold for x in since]})

    rows = batches.filter("batch is not null").select(F.col("batch").cast("bigint"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    return rows.repartition(1).sortWithinPartitions("batch").mapInPandas(place, "batch bigint, size bigint, since_index bigint, has_index boolean")


def bytes_since_index(batches: DataFrame) -> DataFrame:
    """batch, bytes: for a log that states has_index and size per batch, the sizes since the last index, that batch excluded."""
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    group = F.coalesce(F.sum(F.col("has_index").cast("int")).over(w), F.lit(0))
    inner = Window.partitionBy("g").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumn("g", group).select("batch", F.sum("size").over(inner).alias("bytes"))


def entry_shape(metadata: str, segments: str, genes: str) -> Column:
    """The key sets of an entry as one text, each sorted."""
    part = lambda c: F.array_join(F.array_sort(F.coalesce(F.map_keys(c), F.array().cast("array<string>"))), ",")
    return F.concat_ws("|", part(metadata), part(segments), part(genes))


def schema_drift(entries: DataFrame, shape: Column) -> DataFrame:
    """organism, batch, shape: the shape records a writer emits: in a batch whose last deviating entry differs from what is published.

    Within a batch the last entry by ordinal counts among those that differ from the shape published before;
    the walk along an organism's batches is one pass over its distinct (batch, shape) rows. Null organisms are one.
    """
    rows = entries.select("organism", "batch", "ordinal", shape.alias("shape"))
    last = rows.groupBy("organism", "batch", "shape").agg(F.max("ordinal").alias("ordinal"))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, published, pending = None, None, None
        for b in parts:
            out = []
            for organism, batch, shape_ in zip(b["organism"], b["batch"], b["shape"], strict=True):
                if (organism, batch) != group:
                    if pending is not None:
                        out.append((*group, pending))
                    published = (pending or published) if group is not None and group[0] == organism else None
                    group, pending = (organism, batch), None
                if shape_ != published:
                    pending = shape_
            yield pd.DataFrame(out, columns=["organism", "batch", "shape"])
        if pending is not None:
            yield pd.DataFrame([(*group, pending)], columns=["organism", "batch", "shape"])

    return last.filter("batch is not null").repartition("organism").sortWithinPartitions("organism", "batch", "ordinal").select("organism", "batch", "shape").mapInPandas(walk, "organism string, batch bigint, shape string")
