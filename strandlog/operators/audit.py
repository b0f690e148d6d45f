"""Which sources can supply which pieces of the log, and whether everything needed can still be had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 12
#: pieces are kept by the network for so many slots
RETENTION_SLOTS = 4096 * 32
#: pieces asked for at once from a source that is looked up by hash
HASH_BATCH = 24


def availability(sources: DataFrame, refs: DataFrame, found: DataFrame) -> DataFrame:
    """source, seq, outcome for every source and piece: verified, corrupt, error or missing.

    sources: source; refs: seq; found: source, seq, outcome with at most a few rows per pair. Every source is asked
    for every piece, so the result has sources x pieces rows by definition: the names are one array, a scalar subquery,
    that each piece explodes.
    """
    names = sources.filter("source is not null").agg(F.sort_array(F.collect_set("source")).alias("names"))
    pairs = refs.select("seq", F.explode(names.scalar()).alias("source"))
    best = found.groupBy("source", "seq").agg(F.min(F.when(F.col("outcome") == "verified", 0).when(F.col("outcome") == "corrupt", 1).otherwise(2)).alias("r"))
    outcome = F.when(F.col("r") == 0, "verified").when(F.col("r") == 1, "corrupt").when(F.col("r") == 2, "error").otherwise("missing")
    return pairs.join(best, ["source", "seq"], "left").select("source", "seq", outcome.alias("outcome"))


def in_retention(block_time: Column, now: int, slot_seconds: int = SLOT_SECONDS) -> Column:
    """Whether a piece of a block (epoch seconds) is still kept at ``now``."""
    return F.lit(now) - block_time < RETENTION_SLOTS * slot_seconds


def source_counters(matrix: DataFrame, retained: Column | None = None) -> DataFrame:
    """source, asked, verified, missing, corrupt, error, missing_outside_retention, answered."""
    is_ = lambda k: F.col("outcome") == k
    outside = is_("missing") & ~retained if retained is not None else F.lit(False)
    return matrix.groupBy("source").agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(is_("verified")).alias("verified"), F.count_if(is_("missing")).alias("missing"), F.count_if(is_("corrupt")).alias("corrupt"),
        F.count_if(is_("error")).alias("error"), F.count_if(outside).alias("missing_outside_retention"), F.count_if(~is_("error")).alias("answered"),
    )


def first_verified(candidates: DataFrame) -> DataFrame:
    """seq, source: of each piece the verified copy of the first source by priority. candidates: seq, source, priority, outcome."""
    good = candidates.filter("outcome = 'verified'")
    return good.groupBy("seq").agg(F.min_by("source", F.struct("priority", "source")).alias("source"))


def attempts(candidates: DataFrame, refs: DataFrame, sources: DataFrame) -> DataFrame:
    """source, wanted, supplied, outcome: sources asked in order, each only for what the ones before it lacked.

    sources: source, priority. A source's share follows from where each piece was first verified, so no loop is needed.
    """
    served = first_verified(candidates).join(sources, "source").groupBy("source").agg(F.count(F.lit(1)).alias("supplied"))
    total = refs.agg(F.count(F.lit(1)).alias("n")).scalar()
    w = Window.orderBy("priority", "source").rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    rows = sources.join(served, "source", "left").withColumn("supplied", F.coalesce("supplied", F.lit(0)))
    rows = rows.withColumn("wanted", total - F.coalesce(F.sum("supplied").over(w), F.lit(0)))
    outcome = F.when(F.col("wanted") == 0, "not_asked").when(F.col("supplied") == F.col("wanted"), "ok").when(F.col("supplied") > 0, "partial").otherwise("nothing")
    return rows.select("source", "wanted", "supplied", outcome.alias("outcome"))


def verify_candidates(candidates: DataFrame, wanted: DataFrame, content_hash: Column) -> DataFrame:
    """source, accepted, rejected: candidates whose computed hash is wanted; a second copy of one hash counts as rejected."""
    hashed = candidates.select("source", content_hash.alias("hash"))
    good = hashed.join(wanted.select("hash").distinct(), "hash", "left_semi").groupBy("source").agg(F.count_distinct("hash").alias("accepted"))
    total = hashed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return total.join(good, "source", "left").select("source", F.coalesce("accepted", F.lit(0)).alias("accepted"), (F.col("n") - F.coalesce("accepted", F.lit(0))).alias("rejected"))


def enrich_refs(listed: DataFrame, logged: DataFrame) -> DataFrame:
    """seq, hash, block: listed pieces, an unknown block filled from the log where number and hash agree."""
    log = logged.select("seq", "hash", F.col("block").alias("__block"))
    return listed.join(log, ["seq", "hash"], "left").select("seq", "hash", F.coalesce("block", "__block").alias("block"))


def lost_pins(snapshot: DataFrame, pinned: DataFrame, key: str = "hash") -> DataFrame:
    """Pieces of a snapshot that are not pinned any more."""
    return snapshot.join(pinned.select(key), key, "left_anti")


def dead_pieces(torn: DataFrame, last_complete_start: int | Column) -> DataFrame:
    """seq: pieces of torn ranges (first_blob, last_blob) before the last complete batch, which nobody needs; piece 0 holds the header and is never dead."""
    limit = last_complete_start if isinstance(last_complete_start, Column) else F.lit(last_complete_start)
    ranges = torn.filter(F.col("last_blob") < limit)
    return ranges.select(F.explode(F.sequence("first_blob", "last_blob")).alias("seq")).filter("seq != 0").distinct()


def torn_tail(torn: DataFrame, next_piece: int | Column) -> DataFrame:
    """first_blob, last_blob of the last torn range if it begins at or after the end of the last complete batch."""
    limit = next_piece if isinstance(next_piece, Column) else F.lit(next_piece)
    last = torn.agg(F.max_by(F.struct("first_blob", "last_blob"), "first_blob").alias("t")).select("t.*")
    return last.filter(F.col("first_blob") >= limit)


def needed_missing(missing: DataFrame, dead: DataFrame) -> DataFrame:
    """Missing pieces without the dead ones."""
    return missing.join(dead, "seq", "left_anti")


def judge_sources(matrix: DataFrame, dead: DataFrame) -> DataFrame:
    """source, needed, needed_verified, complete: sources judged by the needed pieces alone."""
    needed = matrix.join(dead, "seq", "left_anti")
    n = needed.groupBy("source").agg(F.count(F.lit(1)).alias("needed"), F.count_if(F.col("outcome") == "verified").alias("needed_verified"))
    return n.withColumn("complete", F.col("needed") == F.col("needed_verified"))


def verdict(matrix: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: needed, recoverable, corrupt, verdict.

    broken: a needed piece is nowhere verified; degraded: some source sends corrupt copies, or no source alone is
    complete; healthy otherwise. An empty log is healthy.
    """
    needed = matrix.join(dead, "seq", "left_anti")
    per = needed.groupBy("seq").agg(F.max((F.col("outcome") == "verified").cast("int")).alias("ok"), F.count_if(F.col("outcome") == "corrupt").alias("bad"))
    totals = per.agg(F.count(F.lit(1)).alias("needed"), F.coalesce(F.sum("ok"), F.lit(0)).cast("bigint").alias("recoverable"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("corrupt"))
    whole = judge_sources(matrix, dead).agg(F.coalesce(F.max(F.col("complete").cast("int")), F.lit(1)).alias("one")).scalar()
    word = F.when(F.col("recoverable") < F.col("needed"), "broken").when((F.col("corrupt") > 0) | (F.col("one") == 0), "degraded").otherwise("healthy")
    return totals.withColumn("one", whole).select("needed", "recoverable", "corrupt", word.alias("verdict"))


def missing_report(refs: DataFrame, matrix: DataFrame) -> DataFrame:
    """seq, attempts: pieces no source could supply, with every source's outcome in the order of names."""
    have = matrix.filter("outcome = 'verified'").select("seq").distinct()
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "outcome"))), ",")
    return refs.select("seq").join(have, "seq", "left_anti").join(matrix, "seq", "left").groupBy("seq").agg(lines.alias("attempts"))


def block_groups(refs: DataFrame) -> DataFrame:
    """block, block_time, first_seq, seqs: the pieces of each block, blocks in the order of their first piece."""
    return refs.groupBy("block", "block_time").agg(F.min("seq").alias("first_seq"), F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda s: s.cast("string")), ",").alias("seqs"))


def hash_batches(refs: DataFrame, size: int = HASH_BATCH) -> DataFrame:
    """seq, hash_batch: fixed groups of pieces in sequence order for sources that are asked by hash.

    Sequence numbers of a log are contiguous from 0, so the group is a division and no global sort is needed.
    """
    return refs.select("seq", F.floor(F.col("seq") / size).alias("hash_batch"))


def stream_totals(batches: DataFrame, manifests: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: batches, raw_bytes, compressed_bytes, entries_total, withdrawn_total (of the last manifest) and dead pieces."""
    size = batches.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed_bytes"))
    last = manifests.join(manifests.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    counts = last.agg(F.coalesce(F.sum("entries_total"), F.lit(0)).alias("entries_total"), F.coalesce(F.sum("withdrawn_total"), F.lit(0)).alias("withdrawn_total"))
    one = lambda c: counts.select(c).scalar().alias(c)
    return size.select("*", one("entries_total"), one("withdrawn_total"), dead.agg(F.count(F.lit(1)).alias("n")).scalar().alias("dead_pieces"))
