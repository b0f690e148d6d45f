"""The state of the log: which entries count, which are withdrawn, and what is visible, now or after any batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.schema import KEY, split_accession, split_version


def keep_first(entries: DataFrame, key: list[str] = KEY, order: tuple[str, ...] = ("batch", "ordinal")) -> DataFrame:
    """Each key's earliest entry by batch and place in the batch. Every other row of the key is a duplicate.

    The window sorts the rows of one key only; keys with many repeats are still few rows each.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return entries.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def duplicates(entries: DataFrame, key: list[str] = KEY, order: tuple[str, ...] = ("batch", "ordinal")) -> DataFrame:
    """The later entries of keys that were already in the log."""
    w = Window.partitionBy(*key).orderBy(*order)
    return entries.withColumn("__n", F.row_number().over(w)).filter("__n > 1").drop("__n")


def tombstone_events(tombstones: DataFrame) -> DataFrame:
    """batch, organism, accession, version, kind, note: one row per named key. Texts that are no key are left out."""
    each = tombstones.select("batch", "organism", "kind", "note", F.explode("accessionversions").alias("__av"))
    named = each.select("batch", "organism", split_accession(F.col("__av")).alias("accession"), split_version(F.col("__av")).alias("version"), "kind", "note")
    return named.filter("accession is not null and version is not null")


def conflicts(events: DataFrame) -> DataFrame:
    """Keys that one batch both withdraws and reinstates: such a batch is malformed."""
    key = ["batch", *KEY]
    return events.filter("kind = 'WITHDRAW'").select(*key).intersect(events.filter("kind = 'REINSTATE'").select(*key))


def sound_events(events: DataFrame) -> DataFrame:
    """The events of batches without a conflict."""
    bad = conflicts(events).select("batch").distinct()
    return events.join(bad, "batch", "left_anti")


def tombstone_state(events: DataFrame, upto: int | None = None) -> DataFrame:
    """organism, accession, version, kind, batch: what the latest batch naming each key says, as of ``upto`` if given.

    Lists may name a key that was never published. Order inside a batch has no meaning. The aggregate keeps one
    value per key and combines before the shuffle.
    """
    seen = events if upto is None else events.filter(F.col("batch") <= F.lit(upto))
    return seen.groupBy(*KEY).agg(F.max_by("kind", "batch").alias("kind"), F.max("batch").alias("batch"))


def withdrawn(events: DataFrame, upto: int | None = None) -> DataFrame:
    """The keys that are withdrawn, as of a batch."""
    return tombstone_state(events, upto).filter("kind = 'WITHDRAW'").select(*KEY)


def state_after_each_batch(events: DataFrame) -> DataFrame:
    """Every event with the number of its organism's keys withdrawn after its batch (as organism and batch rows).

    An event counts +1 if it changes its key to withdrawn and -1 if it lifts that; a running sum gives the rest,
    so no state is kept per batch.
    """
    one = events.groupBy(*KEY, "batch").agg(F.max("kind").alias("kind"))
    w = Window.partitionBy(*KEY).orderBy("batch")
    before = F.coalesce(F.lag("kind").over(w), F.lit("REINSTATE"))
    step = F.when((F.col("kind") == "WITHDRAW") & (before != "WITHDRAW"), 1).when((F.col("kind") != "WITHDRAW") & (before == "WITHDRAW"), -1).otherwise(0)
    steps = one.select("organism", "batch", step.cast("bigint").alias("d"), (F.col("kind") == "WITHDRAW").cast("bigint").alias("w"))
    per_batch = steps.groupBy("organism", "batch").agg(F.sum("d").alias("d"), F.sum("w").alias("named"))
    running = Window.partitionBy("organism").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return per_batch.select("organism", "batch", F.col("named").alias("withdrawn_in_batch"), F.sum("d").over(running).alias("withdrawn_total"))


def visible(entries: DataFrame, events: DataFrame, upto: int | None = None) -> DataFrame:
    """First entries of keys that are not withdrawn, as of a batch."""
    seen = entries if upto is None else entries.filter(F.col("batch") <= F.lit(upto))
    return keep_first(seen).join(withdrawn(events, upto), KEY, "left_anti")


def visible_counts(entries: DataFrame, events: DataFrame) -> DataFrame:
    """organism, published, entries_total, withdrawn_total. Organisms known only from tombstones stay listed, also after these are lifted."""
    names = entries.select("organism").union(events.select("organism")).distinct()
    published = entries.select(*KEY).distinct()
    gone = withdrawn(events).withColumn("__gone", F.lit(True))
    both = published.withColumn("__here", F.lit(True)).join(gone, KEY, "full_outer")
    here, out = F.col("__here").isNotNull(), F.col("__gone").isNotNull()
    counted = both.groupBy("organism").agg(F.count_if(here).alias("published"), F.count_if(here & ~out).alias("entries_total"), F.count_if(out).alias("withdrawn_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(counted, "organism", "left").select("organism", zero("published"), zero("entries_total"), zero("withdrawn_total"))


def version_status(entries: DataFrame, revoked: Column) -> DataFrame:
    """organism, accession, version, status: LATEST, REVISED or REVOKED_LATEST by the highest version of an accession."""
    one = keep_first(entries).select(*KEY, revoked.alias("__revoked"))
    w = Window.partitionBy("organism", "accession")
    status = F.when(F.col("version") < F.max("version").over(w), "REVISED").when(F.coalesce("__revoked", F.lit(False)), "REVOKED_LATEST").otherwise("LATEST")
    return one.select(*KEY, status.alias("status"))


def published_map(entries: DataFrame) -> DataFrame:
    """organism, accession, versions: sorted [version, first batch] pairs of each accession, the content of an index."""
    first = entries.groupBy(*KEY).agg(F.min("batch").alias("batch"))
    return first.groupBy("organism", "accession").agg(F.array_sort(F.collect_list(F.array("version", "batch"))).alias("versions"))


def withdrawn_map(events: DataFrame) -> DataFrame:
    """organism, accession, versions: the sorted withdrawn versions of each accession; accessions without any are absent."""
    return withdrawn(events).groupBy("organism", "accession").agg(F.array_sort(F.collect_list("version")).alias("versions"))


def point_lookup(entries: DataFrame, events: DataFrame, organism: str, accession: str, version: int) -> DataFrame:
    """The visible entry of one key, or no row. The key filter reaches the scan."""
    at = (F.col("organism") == organism) & (F.col("accession") == accession) & (F.col("version") == version)
    return visible(entries.filter(at), events.filter(at))


def ineffective(events: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Events that change nothing: withdrawing what is withdrawn, reinstating what is not. A writer refuses them, a reader skips them."""
    w = Window.partitionBy(*key).orderBy("batch")
    before = F.coalesce(F.lag("kind").over(w), F.lit("REINSTATE"))
    return events.withColumn("__before", before).filter("kind = __before").drop("__before")


def canonical_order(schemas: DataFrame, tooling: DataFrame, events: DataFrame, entries: DataFrame) -> DataFrame:
    """section, organism, name, version of a body's records in the order a writer lays them down."""
    none = F.lit(0).cast("bigint")
    parts = [
        schemas.select(F.lit(0).alias("section"), "organism", F.lit("").alias("name"), none.alias("version")),
        tooling.select(F.lit(1).alias("section"), F.lit("").alias("organism"), F.col("path").alias("name"), none.alias("version")),
        events.filter("kind = 'WITHDRAW'").select(F.lit(2).alias("section"), "organism", F.lit("").alias("name"), none.alias("version")).distinct(),
        events.filter("kind = 'REINSTATE'").select(F.lit(3).alias("section"), "organism", F.lit("").alias("name"), none.alias("version")).distinct(),
        entries.select(F.lit(4).alias("section"), "organism", F.col("accession").alias("name"), "version"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("section", "organism", "name", "version")
