"""Selection, changes, state, digests, manifests and audit of the versioned log."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from strandlog.operators import audit, delta, digest, ingest, manifest, state
from strandlog.schema import KEY, split_accession, split_version

K = "organism string, accession string, version long"
DAY = 86_400


def keys(spark, text, organism="zika"):
    rows = [(organism, a, int(v)) for a, v in (t.rsplit(".", 1) for t in text.split())]
    return spark.createDataFrame(rows, K)


def texts(df):
    return " ".join(sorted(f"{r.accession}.{r.version}" for r in df.collect()))


def line(**meta):
    six = {k: {} for k in ("unalignedNucleotideSequences", "alignedNucleotideSequences", "nucleotideInsertions", "alignedAminoAcidSequences", "aminoAcidInsertions")}
    return json.dumps({"metadata": {"accession": "PP_1", "version": 1, "accessionVersion": "PP_1.1", "dataUseTerms": "OPEN", **meta}, **six})


def test_line_shape(spark):
    cases = [(line(), None), (None, "keys"), ("{", "keys"), ('{"metadata":{}}', "keys"), (line(accessionVersion="PP_1.2"), "identity"), (line(version="1"), "identity"), (line(version=1.5), "identity"), (line().replace('"dataUseTerms"', '"other"'), "metadata")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, line string")
    got = [r.s for r in df.select("i", ingest.line_shape(F.col("line")).alias("s")).orderBy("i").collect()]
    assert got == [s for _, s in cases]
    assert ingest.read_lines(df).count() == 1 and ingest.nonblank_lines(spark.createDataFrame([("",), ("a",)], "value string")).count() == 1


def test_selection_counts(spark):
    rows = [("zika", "PP_1", 1, "OPEN", 5), ("zika", "PP_2", 1, "RESTRICTED", None), ("zika", "PP_3", 1, "OPEN", 5), ("zika", "PP_4", 1, "OPEN", 11), ("zika", "PP_5", 1, "open", None), ("zika", "PP_6", 1, None, None)]
    fd = spark.createDataFrame(rows, K + ", terms string, submitted_at long")
    got = ingest.sync_stats(ingest.classify(fd, keys(spark, "PP_1.1 PP_1.1"), KEY, 10), "organism").collect()[0]
    assert tuple(got) == ("zika", 6, 3, 3, 1, 1, 1)
    bad = spark.createDataFrame([("zika", "PP_1", 1, "OPEN", None)], fd.schema)
    with pytest.raises(Exception, match="no time of submission"):
        ingest.classify(bad, keys(spark, "PP_9.1"), KEY, 10).collect()


def test_completeness(spark):
    files = spark.createDataFrame([(1, 2), (2, None), (3, 0), (4, 1)], "file_id long, total long")
    ls = spark.createDataFrame([(1,), (1,), (4,), (4,)], "file_id long")
    bad = ingest.incomplete(files, ls)
    assert [tuple(r) for r in bad.collect()] == [(4, 1, 2)]
    with pytest.raises(ValueError, match="short"):
        ingest.require_empty(bad, "short feed")
    ingest.require_empty(bad.limit(0), "short feed")


def test_delta(spark):
    published, gone = keys(spark, "PP_1.1 PP_2.1 PP_3.1 PP_3.2 PP_4.1 PP_5.1"), keys(spark, "PP_3.2 PP_4.1 PP_5.1 PP_8.1")
    eligible = keys(spark, "PP_1.1 PP_3.2 PP_5.1 PP_7.1 PP_8.1")
    assert texts(delta.to_withdraw(published, gone, eligible, KEY)) == "PP_2.1 PP_3.1"
    assert texts(delta.to_reinstate(gone, eligible, KEY)) == "PP_3.2 PP_5.1 PP_8.1"  # PP_8.1 was withdrawn before it was ever published
    assert texts(delta.new_entries(eligible, published, KEY)) == "PP_7.1 PP_8.1"
    assert texts(delta.already_published(eligible, published, KEY)) == "PP_1.1 PP_3.2 PP_5.1"
    lists = delta.change_lists(keys(spark, "A.10 A.2 A.2")).collect()
    assert lists[0].accession_versions == ["A.10", "A.2"]


def test_alternating_copies(spark):
    """The visible set equals the copy after every step, and content never changes."""
    entries = spark.createDataFrame([], "batch long, ordinal long, " + K + ", payload string")
    events = spark.createDataFrame([], "batch long, " + K + ", kind string")
    log_e, log_t = [], []
    for b, (copy, n_new) in enumerate((("PP_1.1 PP_2.1", 2), ("PP_2.1", 0), ("PP_1.1 PP_2.1 PP_5.1", 1), ("PP_2.1", 0), ("PP_1.1 PP_2.1 PP_5.1", 0), ("PP_1.1 PP_2.1 PP_5.1", 0))):
        e, t = spark.createDataFrame(log_e, entries.schema), spark.createDataFrame(log_t, events.schema)
        el, gone = keys(spark, copy), state.withdrawn(t)
        new = delta.new_entries(el, e, KEY).collect()
        assert len(new) == n_new
        log_t += [(b, *r, "WITHDRAW") for r in delta.to_withdraw(e, gone, el, KEY).collect()] + [(b, *r, "REINSTATE") for r in delta.to_reinstate(gone, el, KEY).collect()]
        log_e += [(b, i, *r, f"copy {b}") for i, r in enumerate(new)]
        seen = state.visible(spark.createDataFrame(log_e, entries.schema), spark.createDataFrame(log_t, events.schema))
        assert texts(seen) == copy
    assert {r.payload for r in seen.filter("accession = 'PP_1'").collect()} == {"copy 0"}


def test_state_after_batches(spark):
    t = [(1, "zika", "A", 1, "WITHDRAW"), (1, "zika", "B", 1, "WITHDRAW"), (2, "zika", "A", 1, "REINSTATE"), (2, "mpox", "C", 1, "WITHDRAW"), (3, "zika", "B", 1, "WITHDRAW"), (3, "zika", "Z", 1, "REINSTATE")]
    ev = spark.createDataFrame(t, "batch long, " + K + ", kind string")
    got = {(r.organism, r.batch): (r.withdrawn_in_batch, r.withdrawn_total) for r in state.state_after_each_batch(ev).collect()}
    assert got == {("zika", 1): (2, 2), ("zika", 2): (0, 1), ("zika", 3): (1, 1), ("mpox", 2): (1, 1)}
    assert texts(state.withdrawn(ev, 1)) == "A.1 B.1" and texts(state.withdrawn(ev)) == "B.1 C.1"
    assert sorted((r.batch, r.accession) for r in state.ineffective(ev).collect()) == [(3, "B"), (3, "Z")]
    e = spark.createDataFrame([(0, 0, "zika", "A", 1), (0, 1, "zika", "B", 1), (1, 0, "zika", "A", 1)], "batch long, ordinal long, " + K)
    counts = {tuple(r) for r in state.visible_counts(e, ev).collect()}
    assert counts == {("zika", 2, 1, 1), ("mpox", 0, 0, 1)}
    assert [tuple(r) for r in state.duplicates(e).collect()] == [(1, 0, "zika", "A", 1)]
    assert state.point_lookup(e, ev, "zika", "B", 1).count() == 0 and state.point_lookup(e, ev, "zika", "A", 1).count() == 1


def test_conflicting_batch_counts_for_nothing(spark):
    rows = [(1, "zika", "WITHDRAW", ["A.1", "no key", "B.x"], None), (1, "zika", "REINSTATE", ["A.1"], "n"), (2, "zika", "WITHDRAW", ["C.10"], None), (3, "zika", "WITHDRAW", None, None)]
    ev = state.tombstone_events(spark.createDataFrame(rows, "batch long, organism string, kind string, accessionversions array<string>, note string"))
    assert [r.accession for r in state.conflicts(ev).collect()] == ["A"]
    assert texts(state.withdrawn(state.sound_events(ev))) == "C.10"


def test_split_key(spark):
    df = spark.createDataFrame([("A.b.3",), ("A.01",), ("A",), ("A.x",), (None,), ("A.",)], "t string")
    assert [tuple(r) for r in df.select(split_accession(F.col("t")), split_version(F.col("t"))).collect()] == [("A.b", 3), ("A", 1), (None, None), ("A", None), (None, None), ("A", None)]


def test_version_status(spark):
    e = spark.createDataFrame([(0, 0, "z", "A", 1, "true"), (0, 1, "z", "A", 2, None), (0, 2, "z", "B", 1, "true")], "batch long, ordinal long, " + K + ", r string")
    assert {(r.accession, r.version): r.status for r in state.version_status(e, F.col("r") == "true").collect()} == {("A", 1): "REVISED", ("A", 2): "LATEST", ("B", 1): "REVOKED_LATEST"}


def test_group_digests(spark):
    rows = [("a", "X", 10, "l10"), ("a", "X", 2, "l2"), ("b", "\U00010000", 1, "hi"), ("b", "￿", 1, "lo"), (None, "N", 1, None)] + [("big", f"{i:05d}", 1, "y" * 50) for i in range(25_000)]
    df = spark.createDataFrame(rows, "g string, accession string, version long, line string")
    listed = spark.createDataFrame([("a",), ("b",), ("none",), (None,), ("big",)], "g string")
    got = {r.g: (r.n_lines, r.sha256) for r in digest.group_digests(df, "g", ["accession", "version"], "line", listed).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"a": (2, sha("l2\nl10\n")), "b": (2, sha("lo\nhi\n")), "none": (0, sha("")), "": (1, sha("\n")), "big": (25_000, sha(("y" * 50 + "\n") * 25_000))}


def test_written_groups_are_ordered(spark, tmp_path):
    rows = [(g, f"A{i % 7}", i, f"A{i % 7}.{i:03d}") for i in range(200) for g in ("x", "y")]
    path = str(tmp_path / "out")
    digest.write_groups(spark.createDataFrame(rows, "g string, accession string, version long, line string"), "g", ["accession", "version"], "line", path)
    for g in ("x", "y"):
        files = [f for f in os.listdir(f"{path}/g={g}") if f.endswith(".txt")]
        assert len(files) == 1
        with open(f"{path}/g={g}/{files[0]}") as f:
            got = f.read().splitlines()
        assert got == sorted(got) and len(got) == 200


def test_chain(spark):
    df = spark.createDataFrame([(1, "b"), (0, "a")], "k long, x string")
    h = hashlib.sha256((hashlib.sha256(("00" + "a").encode()).hexdigest() + "b").encode()).hexdigest()
    assert df.agg(digest.contiguous(F.col("k")).alias("c")).first().c
    assert not df.filter("k = 1").agg(digest.contiguous(F.col("k"))).first()[0] and df.limit(0).agg(digest.contiguous(F.col("k"))).first()[0]
    two = df.withColumn("g", F.lit(7)).unionByName(spark.createDataFrame([(0, None, 8)], "k long, x string, g int"))
    got = {r.g: (r.n, r.head) for r in digest.chain_heads(two, "g", ["k"], "x", "00").collect()}
    assert got == {7: (2, h), 8: (1, hashlib.sha256(b"00").hexdigest())} and digest.chain_heads(two.limit(0), "g", ["k"], "x", "").count() == 0


def test_large_group_is_streamed(spark):
    """A batch's lines pass a task in Arrow batches: of 200,000 lines no aggregate holds more than one such batch."""
    df = spark.range(200_000).select(F.lit(0).alias("batch"), F.lpad(F.col("id").cast("string"), 9, "0").alias("line"))
    plan = digest.group_digests(df, "batch", ["line"], "line")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "MapInPandas" in plan
    want = hashlib.sha256("".join(f"{k:09d}\n" for k in range(200_000)).encode()).hexdigest()
    assert [tuple(r) for r in digest.group_digests(df, "batch", ["line"], "line").collect()] == [(0, 200_000, want)]


def test_index_places_and_shapes_of_many_batches(spark):
    rows = spark.range(20_000).select(F.col("id").alias("batch"), F.lit(3).alias("n"))
    placed = manifest.index_batches(rows, "n", 10)
    assert placed.filter("has_index").count() == 5000 and placed.agg(F.max("since_index")).first()[0] == 12
    assert manifest.index_batches(rows.limit(0), "n").count() == 0


def test_index_placement(spark):
    b = spark.createDataFrame([(i, s) for i, s in enumerate([40, 70, 10, 80, 20])], "batch long, size long")
    placed = manifest.index_batches(b, "size", 100)
    assert [(r.batch, r.since_index, r.has_index) for r in placed.orderBy("batch").collect()] == [(0, 40, False), (1, 110, True), (2, 10, False), (3, 90, False), (4, 110, True)]
    assert [r.bytes for r in manifest.bytes_since_index(placed).orderBy("batch").collect()] == [40, 110, 10, 90, 110]


def test_schema_drift_within_and_across_batches(spark):
    rows = [("z", 0, 0, "s1"), ("z", 0, 1, "s2"), ("z", 0, 2, "s1"), ("z", 1, 0, "s1"), ("z", 2, 0, "s3"), ("z", 2, 1, "s1"), ("z", 3, 0, "s3"), ("y", 5, 0, "t")]
    df = spark.createDataFrame(rows, "organism string, batch long, ordinal long, shape string")
    got = sorted(map(tuple, manifest.schema_drift(df, F.col("shape")).collect()))
    assert got == [("y", 5, "t"), ("z", 0, "s1"), ("z", 2, "s3")]


def test_manifest_links(spark):
    m = spark.createDataFrame([(0, "d0", 2), (1, "d1", 3), (2, "d2", 1)], "batch long, digest string, n_blobs long")
    linked = manifest.link_manifests(m)
    assert [(r.first_blob, r.blob_count_after, r.previous_digest[:2]) for r in linked.orderBy("batch").collect()] == [(0, 2, "00"), (2, 5, "d0"), (5, 6, "d1")]
    assert manifest.check_links(linked).count() == 0
    assert [r.problem for r in manifest.check_links(linked.filter("batch != 1")).collect()] == ["number"]


def test_audit(spark):
    refs = spark.createDataFrame([(i, i // 2, 100 * i) for i in range(4)], "seq long, block long, block_time long")
    sources = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "source string, priority int")
    rows = [("a", 0, "verified"), ("a", 1, "verified"), ("b", 0, "verified"), ("b", 2, "corrupt"), ("b", 2, "verified"), ("b", 3, "error"), ("c", 3, "corrupt")]
    found = spark.createDataFrame(rows, "source string, seq long, outcome string")
    m = audit.availability(sources, refs, found)
    got = {r.source: tuple(r)[1:6] for r in audit.source_counters(m).collect()}
    assert got == {"a": (4, 2, 2, 0, 0), "b": (4, 2, 1, 0, 1), "c": (4, 0, 3, 1, 0)}
    cand = found.join(sources, "source")
    assert {tuple(r) for r in audit.first_verified(cand).collect()} == {(0, "a"), (1, "a"), (2, "b")}
    assert sorted(map(tuple, audit.attempts(cand, refs, sources).collect())) == [("a", 4, 2, "partial"), ("b", 2, 1, "partial"), ("c", 1, 0, "nothing")]
    none = spark.createDataFrame([], "seq long")
    assert tuple(audit.verdict(m, none).first()) == (4, 3, 1, "broken")
    torn = spark.createDataFrame([(3, 3), (0, 0)], "first_blob long, last_blob long")
    dead = audit.dead_pieces(torn, 4)
    assert [r.seq for r in dead.collect()] == [3]
    assert tuple(audit.verdict(m, dead).first()) == (3, 3, 0, "degraded")
    assert tuple(audit.torn_tail(torn, 3).first()) == (3, 3) and audit.torn_tail(torn, 4).count() == 0
    assert [tuple(r) for r in audit.missing_report(refs, m).collect()] == [(3, "a:missing,b:error,c:corrupt")]
    assert [r.seqs for r in audit.block_groups(refs).orderBy("first_seq").collect()] == ["0", "1", "2", "3"]
