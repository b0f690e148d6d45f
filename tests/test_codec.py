"""Bytes: integers, canonical JSON, records, blobs, and the container written and read with Spark."""

import hashlib
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog import schema
from strandlog.functions import canonical, codec, scalars
from strandlog.sources import container
from strandlog.sources.container import WriterState


@given(st.integers(0, 2**64 - 1))
def test_uvarint_round_trip(n):
    assert codec.read_uvarint(codec.uvarint(n)) == (n, len(codec.uvarint(n)))


@pytest.mark.parametrize("bad", ["8000", "ff00", "80", "ffff", "ffffffffffffffffff02", "80808080808080808002", "8080808080808080808000", "ffffffffffffffffffff7f"])
def test_uvarint_refuses(bad):
    with pytest.raises(codec.Malformed):
        codec.read_uvarint(bytes.fromhex(bad))


def test_known_integers():
    assert [codec.uvarint(n).hex() for n in (0, 127, 128, 300, 2**64 - 1)] == ["00", "7f", "8001", "ac02", "ffffffffffffffffff01"]


@pytest.mark.parametrize(
    ("value", "text"),
    [
        ([1.0, 1e21, 0.000001, -0.0, 10], "[1,1e+21,0.000001,0,10]"), ({"é": "ü", "a": None, "b": True}, '{"a":null,"b":true,"é":"ü"}'), (1e-7, "1e-7"), (123456789012345680000.0, None), (0.1, "0.1"), (1.5e300, "1.5e+300"),
        (-2.5, "-2.5"), (1e15, "1000000000000000"), ("\u0007\"\\\n ", '"\\u0007\\"\\\\\\n "'), ({"\U00010000": 1, "": 2}, '{"\U00010000":1,"":2}'), (2**53 - 1, "9007199254740991"), (2**53, None), (float("nan"), None),
    ],
)
def test_canonical_json(value, text):
    if text is None:
        with pytest.raises(ValueError):
            canonical.dumps(value)
    else:
        assert canonical.dumps(value) == text and canonical.is_canonical(text)


scalar = st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(-1e15, 1e15) | st.text(max_size=20)


@settings(max_examples=150, deadline=None)
@given(st.recursive(scalar, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12))
def test_canonical_json_round_trip(value):
    text = canonical.dumps(value)
    assert json.loads(text) == value and canonical.dumps(json.loads(text)) == text


@given(st.binary(min_size=1, max_size=400_000))
@settings(max_examples=15, deadline=None)
def test_blobs_round_trip(data):
    blobs = codec.pack_blobs(data)
    back = b"".join(map(codec.unpack_blob, blobs))
    assert back[: len(data)] == data and not any(back[len(data) :]) and all(len(b) == codec.BLOB_SIZE and not any(b[::32]) for b in blobs)


def test_blobs_refuse():
    with pytest.raises(ValueError):
        codec.pack_blobs(b"")
    for bad in (b"x", b"\x01" + bytes(codec.BLOB_SIZE - 1)):
        with pytest.raises(codec.Malformed):
            codec.unpack_blob(bad)


def test_records_and_codecs():
    data = codec.record(16, b"abc") + codec.record(17, b"")
    assert list(codec.read_records(data)) == [(16, b"abc"), (17, b"")]
    for bad in (data[:-1], b"\x00"):
        with pytest.raises(codec.Malformed):
            list(codec.read_records(bad))
    z = codec.compress(b"q" * 1000, codec.ZSTD)
    assert codec.decompress(z, codec.ZSTD, 1000) == b"q" * 1000
    for args in ((z, codec.ZSTD, 999), (z, codec.ZSTD, 1001), (z[:-3], codec.ZSTD, 1000), (z, 7, 1000), (b"ab", codec.RAW, 3)):
        with pytest.raises(codec.Malformed):
            codec.decompress(*args)
    assert codec.unpack_tooling(codec.pack_tooling("a/é.md", b"x")) == ("a/é.md", b"x")
    f = codec.Format(schema_id="é", chain_id=7, contract=b"\x11" * 20, minor=3)
    assert codec.Format().read_header(f.header()) == f
    for bad in (b"X" + f.header()[1:], f.header()[:20], f.header() + b"x", f.header().replace(b"BATCH\x01", b"BATCH\x02")):
        with pytest.raises(codec.Malformed):
            codec.Format().read_header(bad)


def test_content_identifier():
    import hashlib

    cid = scalars.content_id(hashlib.sha256(b"hello world").digest())
    assert cid == "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5e"
    assert scalars.b32_decode(scalars.b32_lower(b"\x00\xff\x10")) == b"\x00\xff\x10"


def entry(acc, version, size=20, organism="zika"):
    e = {"organism": organism, "metadata": {"accession": acc, "version": version}, "unalignedNucleotideSequences": {"main": "ACGT" * size}}
    return ("ENTRY", organism, acc, version, canonical.dumps(e).encode())


def tomb(kind, keys, organism="zika"):
    return (kind, organism, None, None, canonical.dumps({"organism": organism, "accessionVersions": keys, "note": None}).encode())


COLUMNS = "kind string, organism string, accession string, version long, payload binary"


def write(spark, path, batches, codec_id=codec.ZSTD, index_at=()):
    os.makedirs(path, exist_ok=True)
    state = WriterState()
    for b in batches:
        _, state = container.write_batch(spark.createDataFrame(b, COLUMNS), {}, state, path, codec_id=codec_id, index={"batch": state.batch} if state.batch in index_at else None)
    return state


BATCHES = [
    [entry("B", 10), entry("B", 2), entry("A", 1), ("TOOLING", None, "doc/x.md", None, b"text"), ("SCHEMA", "zika", None, None, b'{"organism":"zika"}')],
    [entry("C", 1, 40_000), tomb("WITHDRAW", ["A.1"])],
    [tomb("REINSTATE", ["A.1"])],
]


@pytest.mark.parametrize("codec_id", [codec.RAW, codec.ZSTD])
def test_container_round_trip(spark, tmp_path, codec_id):
    path = str(tmp_path / "log")
    state = write(spark, path, BATCHES, codec_id, index_at=(1,))
    container.register(spark)
    got = spark.read.format("strandlog").load(path).orderBy("batch", "ordinal").collect()
    assert [(r.batch, r.kind, r.accession, r.version) for r in got][:5] == [(0, "SCHEMA", None, None), (0, "TOOLING", "doc/x.md", None), (0, "ENTRY", "A", 1), (0, "ENTRY", "B", 2), (0, "ENTRY", "B", 10)]
    assert {bytes(r.payload) for r in got if r.kind == "ENTRY"} == {e[4] for b in BATCHES for e in b if e[0] == "ENTRY"}
    shape = spark.read.format("strandlog").option("mode", "structure").load(path).orderBy("batch").collect()
    assert [(r.batch, r.has_index) for r in shape] == [(0, False), (1, True), (2, False)] and shape[-1].blob_count_after == state.next_blob
    back = container.decode(spark, path)
    assert back.records.count() == len(got) and not back.structure.torn
    s = container.Stream(*container.folder_fetch(path))
    b = back.structure.batches[1]
    assert container.read_index(s.read(b.index_at, b.index_length)) == {"batch": 1}


def blob(path, k):
    return os.path.join(path, f"{k:08d}.blob")


def test_torn_batches_and_resumption(spark, tmp_path):
    path = str(tmp_path / "log")
    state = write(spark, path, BATCHES[:2], codec.RAW)
    last = state.next_blob - 1
    # an interrupted attempt: only the first blob of batch 1 stays, then the batch is written again
    for k in range(2, last + 1):
        os.remove(blob(path, k))
    again = WriterState(1, 2, container.walk(*container.folder_fetch(path)).batches[0].manifest_digest)
    container.write_batch(spark.createDataFrame(BATCHES[1], COLUMNS), {}, again, path, codec_id=codec.RAW)
    st_ = container.decode(spark, path).structure
    assert [b.begin.batch for b in st_.batches] == [0, 1] and [(t.expected_batch, t.first_blob, t.last_blob) for t in st_.torn] == [(1, 1, 1)]
    assert st_.dead == {1} and st_.torn_tail is None
    # the torn blob is not needed
    os.remove(blob(path, 1))
    assert [b.begin.batch for b in container.decode(spark, path).structure.batches] == [0, 1]
    # a missing blob of the last batch is a torn tail, not dead
    os.remove(blob(path, 2))
    cut = container.decode(spark, path).structure
    assert len(cut.batches) == 1 and cut.torn_tail.first_blob == 1 and cut.dead == set()
    # without blob 0 nothing can be read
    os.remove(blob(path, 0))
    assert not container.decode(spark, path).structure.batches


def test_lost_batch_makes_later_ones_unreadable(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [[entry("A", 1)], [entry("B", 1)], [entry("C", 1)]])
    os.remove(blob(path, 1))
    s = container.decode(spark, path).structure
    assert len(s.batches) == 1 and [(t.first_blob, t.last_blob) for t in s.torn] == [(1, 2)]


def test_bad_bodies_are_struck_out(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [[entry("A", 1)], [tomb("WITHDRAW", ["A.1"]), tomb("REINSTATE", ["A.1"])], [entry("C", 1)]])
    s = container.decode(spark, path)
    assert len(s.structure.batches) == 1 and s.records.count() == 1
    with open(blob(path, 0), "r+b") as f:  # a changed byte of the body
        f.seek(400)
        f.write(b"\x00\xee")
    assert not container.decode(spark, path).structure.batches


def test_writer_refuses(spark, tmp_path):
    path = str(tmp_path / "log")
    os.makedirs(path)
    with pytest.raises(Exception, match="not written"):
        container.write_batch(spark.createDataFrame([("TOOLING", None, "x", None, b"t")], COLUMNS), {}, WriterState(), path)
    assert not [f for f in os.listdir(path) if f.endswith(".blob")]
    write(spark, path, BATCHES[:1])
    with pytest.raises(FileExistsError):
        container.write_batch(spark.createDataFrame(BATCHES[1], COLUMNS), {}, WriterState(), path)


def test_hostile_length():
    data = codec.record(codec.HEADER, codec.Format().header()) + codec.uvarint(2**62) + b"\x02"
    blobs = codec.pack_blobs(data)
    s = container.walk(lambda k: blobs[k], 1)
    assert not s.batches and len(s.torn) == 1
    assert container.walk(lambda k: None, 0).batches == []


def test_registered_round_trip_is_whole(spark, tmp_path):
    from strandlog.plans import log_queries

    e = {"organism": "zika", "accession": "A", "metadata": {"country": None}, "unalignednucleotidesequences": {"main": "AC"}, "alignednucleotidesequences": {"main": "NAC"}, "nucleotideinsertions": {"main": ["3:T"]}, "alignedaminoacidsequences": {"E": None}, "aminoacidinsertions": {"E": ["2:K"]}}
    rows = [e | {"batch": 0, "ordinal": 0, "version": 1}, e | {"batch": 3, "ordinal": 0, "version": 2}, e | {"batch": 3, "ordinal": 1, "version": 1}]
    entries = spark.createDataFrame(rows, schema.ENTRIES)
    entries.write.parquet(str(tmp_path / "entries.parquet"))
    tombs = [(3, "zika", "WITHDRAW", ["A.1"], "gone"), (5, "zika", "REINSTATE", ["A.1"], None), (6, "zika", "WITHDRAW", ["A.2"], None), (6, "zika", "REINSTATE", ["A.2"], None)]
    spark.createDataFrame(tombs, schema.TOMBSTONES).write.parquet(str(tmp_path / "tombstones.parquet"))
    got = {(r.kind, r.organism): r for r in log_queries.container_roundtrip(spark, str(tmp_path)).collect()}
    assert {k: r.n_read for k, r in got.items()} == {("ENTRY", "zika"): 2, ("WITHDRAW", "zika"): 1, ("REINSTATE", "zika"): 1, ("MANIFEST", None): 3, ("INDEX", None): 1, ("SCHEMA", "zika"): 1, ("TOOLING", None): 1, ("TORN", None): 1, ("RESUMED", None): 3}
    assert all((r.n_written, r.bytes_written, r.sha256_written) == (r.n_read, r.bytes_read, r.sha256_read) for r in got.values())
    made = log_queries.container_records(entries.filter("batch = 0"), log_queries.events(spark, str(tmp_path))).collect()
    assert set(json.loads(next(r.payload for r in made if r.kind == "ENTRY"))) == {"organism", *schema.LINE_KEYS}
    assert {json.loads(r.payload)["note"] for r in made if r.kind in ("WITHDRAW", "REINSTATE")} == {"gone", None}
    altered = [log_queries._payload_digests(spark.createDataFrame([(0, "ENTRY", "zika", t)], "batch long, kind string, organism string, payload binary"), "read").first().sha256_read for t in (b"ab", b"ba")]
    assert altered[0] != altered[1]


def test_keccak():
    from strandlog.functions.keccak import keccak256

    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    for n in (0, 1, 135, 136, 137, 500):
        data = bytes(k % 251 for k in range(n))
        assert keccak256(data, 0x06) == hashlib.sha3_256(data).digest()
