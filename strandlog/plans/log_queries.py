"""Queries over the versioned log: feed selection, changes, state, digests, manifests, audit and scalar functions.

The log's own tables (entries, tombstones, feed lines and files, metadata of released lines) play
themselves. Pieces and sources have no table of their own; orders stand in for pieces, the return flags of line
items for sources, and a line item for what a source answered.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import uuid
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import canonical, codec, scalars
from strandlog.operators import audit, delta, digest, ingest, manifest, state
from strandlog.schema import KEY, LINE_KEYS, accession_version, split_accession, split_version
from strandlog.session import checkpoint_dir, materialize, read_table
from strandlog.sources import blobs, container, feed

#: one reading of the clock for every query, in epoch seconds
NOW = 1_768_000_000
CUTOFF = NOW - 90 * 86_400
AS_OF = 20
INDEX_BYTES = 4_000
GENESIS = 1_606_824_023


def released(spark: SparkSession, sf: str) -> DataFrame:
    """accession, version, groupid, terms, submitted_at: the last delivery of each released line."""
    z = read_table(spark, sf, "zika_metadata")
    last = F.max_by(F.struct("groupid", F.col("datauseterms").alias("terms"), F.col("submittedattimestamp").alias("submitted_at")), F.struct("received_at", "row_id"))
    return z.groupBy("accession", "version").agg(last.alias("r")).select(F.lit("zika").alias("organism"), "accession", "version", "r.*")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "entries")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return state.sound_events(state.tombstone_events(read_table(spark, sf, "tombstones")))


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Keys the feeds serve openly and for long enough, by their last delivery; lines of the second feed state no terms."""
    open_ = released(spark, sf).filter(ingest.is_open(F.col("terms")))
    other = read_table(spark, sf, "andv_metadata").groupBy("accession", "version").agg(F.max_by("submittedattimestamp", F.struct("received_at", "row_id")).alias("submitted_at"))
    every = open_.select(*KEY, "submitted_at").unionByName(other.select(F.lit("andv").alias("organism"), "accession", "version", "submitted_at"))
    return every.filter(ingest.old_enough(F.col("submitted_at"), CUTOFF)).select(*KEY)


def payload() -> Column:
    """A line of text per entry: its key and all six fields, each sorted by key."""
    pairs = lambda c, value: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(value(e["value"]), F.lit("\\N"))))), ",")
    texts = [pairs(k.lower(), lambda v: v) for k in LINE_KEYS if not k.endswith("Insertions")]
    lists = [pairs(k.lower(), lambda v: F.array_join(v, ";")) for k in LINE_KEYS if k.endswith("Insertions")]
    return F.concat_ws("\t", "organism", "accession", F.col("version").cast("string"), *texts, *lists)


# ---- selection of the feed


def eligible_new(spark: SparkSession, sf: str) -> DataFrame:
    return delta.new_entries(eligible(spark, sf), entries(spark, sf), KEY)


def sync_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.sync_stats(ingest.classify(released(spark, sf), entries(spark, sf), KEY, CUTOFF), "groupid")


def already_published(spark: SparkSession, sf: str) -> DataFrame:
    return delta.already_published(eligible(spark, sf), entries(spark, sf), KEY)


def withdraw_set(spark: SparkSession, sf: str) -> DataFrame:
    return delta.to_withdraw(entries(spark, sf), state.withdrawn(events(spark, sf)), eligible(spark, sf), KEY)


def reinstate_set(spark: SparkSession, sf: str) -> DataFrame:
    return delta.to_reinstate(state.withdrawn(events(spark, sf)), eligible(spark, sf), KEY)


def change_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = delta.change_lists(reinstate_set(spark, sf))
    return lists.select("organism", F.array_join("accession_versions", ",").alias("accession_versions"))


def unserved_group(spark: SparkSession, sf: str) -> DataFrame:
    return delta.unserved_groups(entries(spark, sf), read_table(spark, sf, "feed_lines"))


def visible_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are visible once the run's changes are applied: published or new, and eligible."""
    e, ev, el = entries(spark, sf), events(spark, sf), eligible(spark, sf)
    gone = state.withdrawn(ev)
    seen = e.select(*KEY).distinct().join(gone, KEY, "left_anti")
    back = delta.to_reinstate(gone, el, KEY).join(e.select(*KEY), KEY, "left_semi")
    return delta.apply_changes(seen, delta.new_entries(el, e, KEY), delta.to_withdraw(e, gone, el, KEY), back, KEY)


def feed_scan(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "feed_lines").select("line_id", "file_id", "line")
    return ingest.read_lines(feed_nonblank(lines)).select("line_id", "file_id", "accession", "version", "terms", "submitted_at")


def feed_nonblank(lines: DataFrame) -> DataFrame:
    return ingest.nonblank_lines(lines, "line")


def feed_shape(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "feed_lines")
    return lines.groupBy("mirror", F.coalesce(ingest.line_shape(F.col("line")), F.lit("right")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def line_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array_join(ingest.json_keys(F.col("line")), ",")
    return read_table(spark, sf, "feed_lines").groupBy("organism", keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def feed_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.incomplete(read_table(spark, sf, "feed_files"), read_table(spark, sf, "feed_lines"))


def feed_changed(spark: SparkSession, sf: str) -> DataFrame:
    return feed.changed_files(read_table(spark, sf, "feed_files")).select("file_id", "mirror", "organism", F.col("file_no").cast("bigint").alias("file_no"))


def feed_groups(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "feed_files").groupBy("organism").agg(F.count_distinct("mirror").alias("mirrors"), F.count(F.lit(1)).alias("files"))


def published_projection(spark: SparkSession, sf: str) -> DataFrame:
    kept = ingest.published_metadata(F.col("metadata"))
    return entries(spark, sf).select("batch", "ordinal", *KEY, F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("fields"))


def entry_validation(spark: SparkSession, sf: str) -> DataFrame:
    problem = ingest.entry_problem(F.col("organism"), F.col("accession"), F.col("version"), F.element_at("metadata", "accessionVersion"))
    return entries(spark, sf).groupBy("organism", F.coalesce(problem, F.lit("right")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


# ---- state of the log


def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return state.keep_first(entries(spark, sf).select("batch", "ordinal", *KEY))


def duplicate_entries(spark: SparkSession, sf: str) -> DataFrame:
    return state.duplicates(entries(spark, sf).select("batch", "ordinal", *KEY))


def tombstone_state(spark: SparkSession, sf: str) -> DataFrame:
    return state.tombstone_state(events(spark, sf))


def tombstone_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return state.tombstone_state(events(spark, sf), AS_OF)


def tombstone_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return state.conflicts(state.tombstone_events(read_table(spark, sf, "tombstones")))


def withdrawn_after_batches(spark: SparkSession, sf: str) -> DataFrame:
    return state.state_after_each_batch(events(spark, sf))


def ineffective_events(spark: SparkSession, sf: str) -> DataFrame:
    return state.ineffective(events(spark, sf)).select("batch", *KEY, "kind")


def visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    return state.visible(entries(spark, sf), events(spark, sf)).select("batch", "ordinal", *KEY)


def visible_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return state.visible(entries(spark, sf), events(spark, sf), AS_OF).select("batch", "ordinal", *KEY)


def visible_counts(spark: SparkSession, sf: str) -> DataFrame:
    return state.visible_counts(entries(spark, sf), events(spark, sf))


def version_status(spark: SparkSession, sf: str) -> DataFrame:
    return state.version_status(entries(spark, sf), F.element_at("metadata", "isRevocation") == "true")


def published_map(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array_join(F.transform("versions", lambda p: F.concat(p[0].cast("string"), F.lit(":"), p[1].cast("string"))), ",")
    return state.published_map(entries(spark, sf)).select("organism", "accession", pairs.alias("versions"))


def withdrawn_map(spark: SparkSession, sf: str) -> DataFrame:
    return state.withdrawn_map(events(spark, sf)).select("organism", "accession", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions"))


def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    schemas = manifest.schema_drift(e, manifest.entry_shape("metadata", "unalignednucleotidesequences", "alignedaminoacidsequences")).select("organism").distinct()
    tooling = spark.createDataFrame([("README.md",)], "path string")
    return state.canonical_order(schemas, tooling, events(spark, sf), state.keep_first(e)).select("section", "organism", "name", "version")


def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("organism").union(events(spark, sf).select("organism")).distinct()


def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(*KEY).intersect(events(spark, sf).select(*KEY))


def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(*KEY).exceptAll(events(spark, sf).select(*KEY)).distinct()


# ---- digests and manifests


def artifact_digest(spark: SparkSession, sf: str) -> DataFrame:
    e, ev = entries(spark, sf), events(spark, sf)
    lines = state.visible(e, ev).select(*KEY, payload().alias("line"))
    return digest.group_digests(lines, "organism", ["accession", "version"], "line", set_union(spark, sf))


def batch_digest(spark: SparkSession, sf: str) -> DataFrame:
    lines = state.keep_first(entries(spark, sf)).select("batch", *KEY, payload().alias("line"))
    return digest.group_digests(lines, "batch", KEY, "line")


def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    links = entries(spark, sf).select("batch", "ordinal", F.sha2(accession_version(), 256).alias("link"))
    return digest.chain_heads(links, "batch", ["ordinal", "link"], "link", manifest.ZEROS)


def chain_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.agg(F.count(F.lit(1)).alias("n"), digest.contiguous(F.col("event_id")).alias("contiguous"))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The entry of one key, read with the key's filter in the scan."""
    e = entries(spark, sf)
    key = e.agg(F.min(F.struct(*KEY)).alias("k")).first().k
    if key is None:
        return e.select("batch", "ordinal", *KEY).limit(0)
    return state.point_lookup(e, events(spark, sf), *key).select("batch", "ordinal", *KEY)


def _withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    return state.state_after_each_batch(events(spark, sf))


def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.batch_counts(state.keep_first(entries(spark, sf)).select("batch", *KEY), _withdrawals(spark, sf))


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    """What a manifest would state if duplicates were counted and one organism were left out."""
    return entries(spark, sf).filter("organism != 'mpox'").groupBy("organism").agg(F.count(F.lit(1)).alias("published"))


def manifest_compare(spark: SparkSession, sf: str) -> DataFrame:
    computed = visible_counts(spark, sf).select("organism", "published")
    return manifest.compare_manifest(_stated(spark, sf), computed, "organism", ["published"])


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    """batch, digest of its sorted keys, raw_bytes of its lines, n_blobs."""
    e = entries(spark, sf)
    keys = digest.group_digests(e.select("batch", F.concat_ws(".", "organism", accession_version()).alias("key")), "batch", ["key"], "key").select("batch", F.col("sha256").alias("digest"))
    sizes = e.groupBy("batch").agg(F.sum(F.octet_length(payload())).alias("raw_bytes"))
    return keys.join(sizes, "batch").withColumn("n_blobs", F.ceil(F.col("raw_bytes") / 1000))


def manifest_chain(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.link_manifests(_manifests(spark, sf))


def manifest_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Links as they look if every seventh batch had been written twice with another content."""
    linked = manifest.link_manifests(_manifests(spark, sf))
    forged = linked.withColumn("previous_digest", F.when(F.col("batch") % 7 == 6, F.sha2("previous_digest", 256)).otherwise(F.col("previous_digest")))
    return manifest.check_links(forged)


def index_placement(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.index_batches(_manifests(spark, sf), "raw_bytes", INDEX_BYTES)


def bytes_since_index(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.bytes_since_index(index_placement(spark, sf))


def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.schema_drift(entries(spark, sf), manifest.entry_shape("metadata", "unalignednucleotidesequences", "alignedaminoacidsequences"))


# ---- sources and pieces


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("block"), F.unix_timestamp("o_orderdate").alias("block_time"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    outcome = F.when(F.col("l_linestatus") == "O", "verified").when(F.col("l_tax") >= 0.06, "corrupt").otherwise("error")
    return li.select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("seq"), outcome.alias("outcome"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source")).distinct().withColumn("priority", F.ascii("source"))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return audit.availability(_sources(spark, sf), _refs(spark, sf), _found(spark, sf))


def _torn(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    return o.select(F.col("o_orderkey").alias("first_blob"), (F.col("o_orderkey") + F.pmod("o_custkey", F.lit(3))).alias("last_blob"))


def _last_complete(spark: SparkSession, sf: str) -> int:
    """The first piece of the last complete batch: a single number read from the log's structure."""
    return read_table(spark, sf, "orders").filter("o_orderstatus = 'O'").agg(F.max("o_orderkey").alias("m")).first().m or 0


def _dead(spark: SparkSession, sf: str) -> DataFrame:
    return audit.dead_pieces(_torn(spark, sf), _last_complete(spark, sf))


def source_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf)


def source_counters(spark: SparkSession, sf: str) -> DataFrame:
    with_time = _matrix(spark, sf).join(_refs(spark, sf).select("seq", "block_time"), "seq")
    return audit.source_counters(with_time, audit.in_retention(F.col("block_time"), 970_000_000))


def source_judgement(spark: SparkSession, sf: str) -> DataFrame:
    return audit.judge_sources(_matrix(spark, sf), _dead(spark, sf))


def source_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verdict(_matrix(spark, sf), _dead(spark, sf))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).withColumn("priority", F.ascii("source"))


def first_verified(spark: SparkSession, sf: str) -> DataFrame:
    return audit.first_verified(_candidates(spark, sf))


def source_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.attempts(_candidates(spark, sf), _refs(spark, sf), _sources(spark, sf))


def candidate_check(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidate pieces of their brands; wanted are the hashes of the names some large part carries."""
    p = read_table(spark, sf, "part")
    wanted = p.filter("p_size >= 25").select(F.sha2("p_name", 256).alias("hash"))
    return audit.verify_candidates(p.select(F.col("p_brand").alias("source"), "p_name"), wanted, F.sha2("p_name", 256))


def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    return audit.missing_report(_refs(spark, sf), _matrix(spark, sf))


def dead_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return _dead(spark, sf)


def torn_tail(spark: SparkSession, sf: str) -> DataFrame:
    return audit.torn_tail(_torn(spark, sf), _last_complete(spark, sf) - 100)


def needed_missing(spark: SparkSession, sf: str) -> DataFrame:
    lost = audit.missing_report(_refs(spark, sf), _matrix(spark, sf)).select("seq")
    return audit.needed_missing(lost, _dead(spark, sf))


def block_groups(spark: SparkSession, sf: str) -> DataFrame:
    return audit.block_groups(_refs(spark, sf))


def hash_batches(spark: SparkSession, sf: str) -> DataFrame:
    return audit.hash_batches(_refs(spark, sf))


def in_retention(spark: SparkSession, sf: str) -> DataFrame:
    return _refs(spark, sf).select("seq", audit.in_retention(F.col("block_time"), 970_000_000).alias("kept"))


def enriched_refs(spark: SparkSession, sf: str) -> DataFrame:
    listed = _refs(spark, sf).select("seq", "hash", F.when(F.pmod("block", F.lit(2)) == 0, F.col("block")).alias("block"))
    return audit.enrich_refs(listed, _refs(spark, sf).select("seq", F.when(F.pmod("seq", F.lit(5)) > 0, F.col("hash")).otherwise(F.lit("")).alias("hash"), "block"))


def lost_pins(spark: SparkSession, sf: str) -> DataFrame:
    pinned = _refs(spark, sf).join(_found(spark, sf).filter("source = 'R'").select("seq").distinct(), "seq", "left_semi")
    return audit.lost_pins(_refs(spark, sf).select("seq", "hash"), pinned.select("hash"))


def stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    batches = _manifests(spark, sf).select("batch", "raw_bytes", F.col("n_blobs").alias("compressed_bytes"))
    counts = manifest_counts(spark, sf).select("batch", F.col("published_total").alias("entries_total"), "withdrawn_total")
    return audit.stream_totals(batches, counts, _dead(spark, sf))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as pieces; the bytes of every seventh do not belong to the name they claim."""
    p = read_table(spark, sf, "part")
    text = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name")
    spoilt = F.pmod("p_partkey", F.lit(7)) == 0
    return p.select(F.col("p_partkey").alias("seq"), F.sha2(text, 256).alias("hash"), F.encode(F.when(spoilt, F.concat(text, F.lit("?"))).otherwise(text), "UTF-8").alias("data"))


def blob_store(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces appended to a store twice, written out as files and read back: what, and how many pieces."""
    path, pieces = _scratch(spark), _pieces(spark, sf)
    store, out = f"file://{path}/store", os.path.join(path, "files")
    counts = [("offered", pieces.count()), ("failing", blobs.failing(pieces).count()), ("stored", blobs.append_blobs(store, pieces)), ("stored again", blobs.append_blobs(store, pieces))]
    stored = spark.read.parquet(store) if counts[2][1] else pieces.limit(0)
    blobs.export_blobs(stored, out)
    back = blobs.read_folder(spark, f"file://{out}") if counts[2][1] else pieces.select("hash", "data").limit(0)
    highest = pieces.agg(F.max("seq")).first()[0] or 0
    counts += [("missing", blobs.missing_numbers(stored, highest + 1).count()), ("files", back.count()), ("files verified", blobs.verified(back).count())]
    return spark.createDataFrame(counts, "what string, n bigint")


# ---- scalar functions


def human_size(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return read_table(spark, sf, "documents").select("doc_id", scalars.human_size(n).alias("small"), scalars.human_size(n * 997).alias("middle"), scalars.human_size(n * n * 31).alias("large"))


def human_duration(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("value") * 97 - 40
    return read_table(spark, sf, "events").select("event_id", scalars.human_duration(s).alias("duration"), scalars.relative_age(F.when(F.col("event_type") != "view", s + 40)).alias("age"))


def split_key(spark: SparkSession, sf: str) -> DataFrame:
    av = read_table(spark, sf, "tombstones").select("tombstone_id", F.posexplode("accessionversions").alias("pos", "av"))
    return av.select("tombstone_id", F.col("pos").cast("bigint").alias("pos"), split_accession(F.col("av")).alias("accession"), split_version(F.col("av")).alias("version"))


def safe_dirname(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "submitted_names").select("name_id", scalars.safe_dirname(F.col("name")).alias("dirname"))


def public_url(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints made from repositories and paths, some with a user and a port, reduced to what may be shown."""
    d = read_table(spark, sf, "documents")
    port = F.when(F.col("n_cells") % 3 == 0, ":443").when(F.col("n_cells") % 3 == 1, ":8545").otherwise("")
    user = F.when(F.col("kernel").isNull(), "").otherwise("user:secret@")
    url = F.concat(F.lit("https://"), user, F.lit("Host-"), F.coalesce("lang", F.lit("xx")), F.lit(".example"), port, F.lit("/"), F.col("path"), F.lit("?key=1"))
    return d.select("doc_id", scalars.public_url(url).alias("url"), scalars.redact(F.concat(F.lit("at "), F.col("repo")), ["openlab/handbook"], ["openlab"]).alias("text"))


def slot(spark: SparkSession, sf: str) -> DataFrame:
    z, t = read_table(spark, sf, "zika_metadata"), F.col("submittedattimestamp")
    return z.select("row_id", scalars.slot_of(t, GENESIS).alias("slot"), scalars.iso_day(t).alias("day"), scalars.estimated_seconds(F.col("load_no")).cast("bigint").alias("seconds"))


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", scalars.sha256_hex(F.col("text")).alias("sha256"), scalars.to_hex(F.encode("path", "UTF-8")).alias("hex"), F.decode(scalars.from_hex(scalars.to_hex(F.encode("path", "UTF-8"))), "UTF-8").alias("back"))


def blob_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars") * 37
    blob, element = scalars.chunk_place(F.floor(n / scalars.CHUNK))
    return read_table(spark, sf, "documents").filter("n_chars > 0").select("doc_id", scalars.blobs_needed(n).alias("blobs"), scalars.last_chunk_count(n).alias("last_chunks"), blob.alias("blob"), element.alias("element"))


# ---- what SQL cannot express


def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    text = canonical.canonical_json_udf()(F.col("line"))
    return read_table(spark, sf, "feed_lines").select("line_id", text.alias("canonical")).select("line_id", "canonical", F.sha2("canonical", 256).alias("sha256"))


def cid(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", scalars.content_id_udf()(F.encode("text", "UTF-8")).alias("cid"))


def blob_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector document packed into blobs and unpacked again: number of blobs, and the digest of what comes back."""
    return read_table(spark, sf, "vector_docs").filter("doc != ''").mapInPandas(_pack_and_unpack, "file_id bigint, blobs bigint, sha256 string")


def _pack_and_unpack(batches):
    for b in batches:
        rows = []
        for file_id, doc in zip(b["file_id"], b["doc"], strict=True):
            data = doc.encode()
            packed = codec.pack_blobs(data)
            rows.append((file_id, len(packed), hashlib.sha256(b"".join(map(codec.unpack_blob, packed))[: len(data)]).hexdigest()))
        yield pd.DataFrame(rows, columns=["file_id", "blobs", "sha256"])


def canonical_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether lines are canonical as landed, and once made so."""
    made = read_table(spark, sf, "feed_lines").select("line_id", "line", canonical.canonical_json_udf()(F.col("line")).alias("made"))
    return made.select("line_id", canonical.is_canonical_udf()(F.col("line")).alias("landed"), canonical.is_canonical_udf()(F.col("made")).alias("made"))


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder as a plain path, removed when the driver ends; tasks write blobs there as plain files."""
    base = checkpoint_dir(spark)
    scheme, _, rest = base.partition(":") if "://" in base or base.startswith("file:") else ("file", "", base)
    if scheme != "file":
        raise ValueError(f"containers are written as plain files: spark.checkpoint.dir must be a shared mount, not {scheme}:")
    path = os.path.join("/" + rest.lstrip("/"), f"container-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, True)
    return path


def container_records(e: DataFrame, ev: DataFrame) -> DataFrame:
    """batch, kind, organism, accession, version, payload: a record per entry with all six fields, per batch, organism, kind and note of events, and per shape that is new; the first batch carries a tooling file."""
    pairs = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    own = F.create_map(F.lit("accession"), F.col("accession"), F.lit("version"), F.col("version").cast("string"))
    fields = [F.col(k.lower()).alias(k) for k in LINE_KEYS if k != "metadata"]
    meta = e.withColumn("metadata", F.map_concat(F.map_filter(pairs, lambda k, _: ~k.isin("accession", "version")), own))
    body = F.to_json(F.struct("organism", "metadata", *fields), {"ignoreNullFields": "false"})
    rows = meta.select("batch", F.lit("ENTRY").alias("kind"), "organism", "accession", "version", F.regexp_replace(body, '"version":"([0-9]+)"', '"version":$1').alias("text"))
    lists = ev.groupBy("batch", "organism", "kind", "note").agg(F.array_sort(F.collect_set(accession_version())).alias("accessionVersions"))
    gone = F.to_json(F.struct("organism", "accessionVersions", "note"), {"ignoreNullFields": "false"})
    tombs = lists.select("batch", "kind", "organism", F.lit(None).cast("string").alias("accession"), F.lit(None).cast("bigint").alias("version"), gone.alias("text"))
    shape = manifest.entry_shape("metadata", "unalignednucleotidesequences", "alignedaminoacidsequences")
    described = F.to_json(F.struct("organism", "shape"))
    schemas = manifest.schema_drift(e, shape).select("batch", F.lit("SCHEMA").alias("kind"), "organism", F.lit(None).cast("string").alias("accession"), F.lit(None).cast("bigint").alias("version"), described.alias("text"))
    texts = rows.unionByName(tombs).unionByName(schemas).withColumn("payload", F.encode(canonical.canonical_json_udf()("text"), "UTF-8")).drop("text")
    tool = e.sparkSession.createDataFrame([(0, "TOOLING", None, "README.md", None, b"Decode the batches in order.\n")], texts.select("batch", "kind", "organism", "accession", "version", "payload").schema)
    return texts.unionByName(tool)


def _index(e: DataFrame, ev: DataFrame, batch: int) -> dict:
    """The content of an index of a batch; as large as that record."""
    out: dict = {"batch": batch, "entries": {}, "withdrawn": {}}
    for part, keys in (("entries", state.published_map(e.filter(F.col("batch") <= batch))), ("withdrawn", state.withdrawn_map(ev.filter(F.col("batch") <= batch)))):
        for r in keys.toLocalIterator():
            out[part].setdefault(r.organism, {})[r.accession] = [list(v) if part == "entries" else v for v in r.versions]
    return out


def _payload_digests(records: DataFrame, side: str) -> DataFrame:
    """kind, organism, and of one side n, bytes and a digest of the payloads with their batches that does not depend on order."""
    h = records.select("kind", "organism", F.octet_length("payload").alias("bytes"), F.sha2(F.concat(F.encode(F.concat(F.col("batch").cast("string"), F.lit(":")), "UTF-8"), "payload"), 256).alias("h"))
    # hashes are added as four numbers of 64 bits
    sums = [F.sum(F.conv(F.substring("h", k, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in (1, 17, 33, 49)]
    return h.groupBy("kind", "organism").agg(F.count(F.lit(1)).alias(f"n_{side}"), F.sum("bytes").alias(f"bytes_{side}"), F.sha2(F.concat_ws(":", *sums), 256).alias(f"sha256_{side}"))


def container_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The first entry of every key and all sound events, batch by batch, written with zstd and read back: kind, organism, and n, bytes and digest of what was written and of what came back.

    Batches are numbered without gaps. Manifests state the counts of their batch; an index stands in the last
    batch and wherever the bytes since the one before could call for it. Kinds MANIFEST and INDEX compare these.
    Then the last batch is torn and written again behind the torn blob: TORN compares the number of torn ranges, RESUMED that
    of batches found.
    """
    e, ev = state.keep_first(entries(spark, sf)), events(spark, sf)
    numbers = sorted(r.batch for r in e.select("batch").union(ev.select("batch")).distinct().filter("batch is not null").collect())
    out = "kind string, organism string, n_written long, bytes_written long, sha256_written string, n_read long, bytes_read long, sha256_read string"
    if not numbers:
        return spark.createDataFrame([], out)
    number = spark.createDataFrame(list(zip(numbers, range(len(numbers)), strict=True)), "batch long, number long")
    numbered = lambda df: materialize(df.join(F.broadcast(number), "batch").drop("batch").withColumnRenamed("number", "batch"))
    e, ev = numbered(e), numbered(ev)
    records = materialize(container_records(e, ev))
    counts: dict[int, dict] = {}
    for r in manifest.batch_counts(e.select("batch", *KEY), state.state_after_each_batch(ev)).collect():
        counts.setdefault(r.batch, {})[r.organism] = {"entriesInBatch": r.entries_in_batch, "publishedTotal": r.published_total, "withdrawnInBatch": r.withdrawn_in_batch, "withdrawnTotal": r.withdrawn_total}
    sizes = {r.batch: r.n for r in records.groupBy("batch").agg(F.sum(F.octet_length("payload") + 16).alias("n")).collect()}
    path, at, stated, indexes = _scratch(spark), container.WriterState(), [], []
    for batch in range(len(numbers)):
        due = batch == len(numbers) - 1 or at.bytes_since_index + sizes[batch] >= manifest.INDEX_THRESHOLD
        index = _index(e, ev, batch) if due else None
        before = at
        said, at = container.write_batch(records.filter(F.col("batch") == batch).drop("batch"), counts[batch], at, path, index=index)
        stated.append(said)
        indexes += [index] if due else []
    back = container.decode(spark, path)
    stream = container.Stream(*container.folder_fetch(path))
    found = [container.read_index(stream.read(b.index_at, b.index_length)) for b in back.structure.batches if b.index_length]
    rows = []
    for kind, written, read in (("MANIFEST", stated, [b.manifest for b in back.structure.batches]), ("INDEX", indexes, found)):
        texts = ["\n".join(map(canonical.dumps, x)).encode() for x in (written, read)]
        rows.append((kind, None, *(v for x, t in zip((written, read), texts, strict=True) for v in (len(x), len(t), hashlib.sha256(t).hexdigest()))))
    one, other = _payload_digests(records, "written"), _payload_digests(back.records, "read")
    both = one.withColumnRenamed("kind", "k").withColumnRenamed("organism", "o").join(other, F.col("k").eqNullSafe(F.col("kind")) & F.col("o").eqNullSafe(F.col("organism")), "full_outer")
    compared = materialize(both.select(F.coalesce("kind", "k").alias("kind"), F.coalesce("organism", "o").alias("organism"), *(c.split()[0] for c in out.split(", ")[2:])))
    if len(numbers) == 1:  # blob 0 holds the header: without it nothing can be read, so a single batch is not torn
        return compared.unionByName(spark.createDataFrame(rows, out))
    # the upload of the last batch breaks off: what is left of it is no batch, and it is written once more
    for k in range(before.next_blob, at.next_blob):
        os.remove(os.path.join(path, f"{k:08d}.blob"))
    with open(os.path.join(path, f"{before.next_blob:08d}.blob"), "wb") as f:
        f.write(codec.pack_blobs(b"\x00")[0])
    cut = container.walk(*container.folder_fetch(path))
    again = replace(before, next_blob=before.next_blob + 1)
    container.write_batch(records.filter(F.col("batch") == len(numbers) - 1).drop("batch"), counts[len(numbers) - 1], again, path, index=indexes[-1])
    whole = container.walk(*container.folder_fetch(path))
    sound = cut.torn_tail is not None and whole.dead <= {before.next_blob} and whole.torn_tail is None
    rows += [("TORN", None, 1, 0, "", len(whole.torn) if sound else -1, 0, ""), ("RESUMED", None, len(numbers), 0, "", len(whole.batches), 0, "")]
    return compared.unionByName(spark.createDataFrame(rows, out))


def streaming_append(spark: SparkSession, sf: str) -> DataFrame:
    """The events appended to a log twice by a stream: the second run finds nothing new."""
    from strandlog.streaming.append import run_available

    path = _scratch(spark)
    schema = read_table(spark, sf, "events").schema
    landed = os.path.join(path, "landed")
    read_table(spark, sf, "events").write.parquet(landed)
    runs = [(k, run_available(spark, landed, schema, os.path.join(path, "log"), os.path.join(path, f"checkpoint-{c}"), ["event_id"])) for k, c in ((1, 0), (2, 0), (3, 1))]
    return materialize(spark.createDataFrame(runs, "run int, appended bigint"))


QUERIES = {
    f.__name__: f
    for f in (
        eligible_new, sync_stats, already_published, withdraw_set, reinstate_set, change_lists, unserved_group, visible_after_changes, feed_scan, feed_shape, line_keys, feed_incomplete, feed_changed, feed_groups,
        published_projection, entry_validation, keep_first, duplicate_entries, tombstone_state, tombstone_as_of, tombstone_conflicts, withdrawn_after_batches, ineffective_events, visible_rows, visible_as_of,
        visible_counts, version_status, published_map, withdrawn_map, canonical_order, set_union, set_intersect, set_except, artifact_digest, batch_digest, hash_chain, chain_contiguity, manifest_counts, point_lookup, blob_store,
        manifest_compare, manifest_chain, manifest_breaks, index_placement, bytes_since_index, schema_drift, source_matrix, source_counters, source_judgement, source_verdict, first_verified, source_attempts,
        candidate_check, missing_report, dead_blobs, torn_tail, needed_missing, block_groups, hash_batches, in_retention, enriched_refs, lost_pins, stream_totals, human_size, human_duration, split_key,
        safe_dirname, public_url, slot, hashes, blob_counts, canonical_json, canonical_check, cid, blob_pack, container_roundtrip, streaming_append,
    )
}
