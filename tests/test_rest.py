"""Scalars, sources, settings, reports, the stream, and every query against its SQL."""

import glob
import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from strandlog import config
from strandlog.functions import scalars
from strandlog.sources import blobs, container, feed, reports
from strandlog.sources.files import Folder
from strandlog.streaming.append import Conflict, append_new, run_available


def evaluate(spark, kind, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_human_texts(spark):
    assert evaluate(spark, "long", [0, 1, 999, 1000, 999_499, 999_500, 1_500_000, 999_500_000, 1_250_000_000], scalars.human_size) == ["0 bytes", "1 byte", "999 bytes", "1 kB", "999 kB", "1 MB", "2 MB", "1.0 GB", "1.3 GB"]
    assert evaluate(spark, "double", [-5.0, 119.4, 119.5, 7169.0, 7200.0, 9000.0], scalars.human_duration) == ["0 s", "119 s", "2 min", "119 min", "2 h 0 min", "2 h 30 min"]
    assert evaluate(spark, "double", [None, 89.0, 90.0, 5400.0, 172_800.0], scalars.relative_age) == ["–", "89 s", "2 min", "2 h", "2 days"]


def test_names_and_urls(spark):
    assert evaluate(spark, "string", ["zika", "", ".", "..", "-a", "a/b", "é", "日本", "a b", None], scalars.safe_dirname) == ["zika", "_", "_.", "_..", "_-a", "a%2Fb", "%E9", "%65E5%672C", "a%20b", None]
    urls = ["https://u:p@Host.example:8443/v1?key=s", "https://h.example:443/x", "http://h.example:80", "http://h.example:8080", "none", None]
    assert evaluate(spark, "string", urls, scalars.public_url) == ["https://host.example:8443", "https://h.example", "http://h.example", "http://h.example:8080", None, None]
    assert evaluate(spark, "string", ["x https://a/b/c y https://a/b"], lambda c: scalars.redact(c, ["https://a/b", "https://a/b/c"], ["A", "C"])) == ["x C y A"]


def test_numbers(spark):
    assert evaluate(spark, "long", [None, 1_606_824_023, 1_606_824_022, 1_606_824_036], lambda c: scalars.slot_of(c, 1_606_824_023)) == [None, 0, -1, 1]
    assert evaluate(spark, "long", [0, -1, 86_399, 1_800_000_000], scalars.iso_day) == ["1970-01-01", "1969-12-31", "1970-01-01", "2027-01-15"]
    assert evaluate(spark, "long", [1, 126_976, 126_977], scalars.blobs_needed) == [1, 1, 2]
    assert evaluate(spark, "long", [1, 31, 32, 126_976, 126_977, 153_600], scalars.last_chunk_count) == [1, 1, 2, 4096, 1, 859]
    with pytest.raises(Exception, match="empty stream"):
        evaluate(spark, "long", [0], scalars.blobs_needed)


def test_feed_sources(spark, tmp_path):
    (tmp_path / "a.ndjson").write_bytes(b'{"a":1}\n\n{"a":2}')
    df = feed.read_lines(spark, str(tmp_path))
    assert df.count() == 2 and feed.check_complete(df, 2) == 2 and feed.check_complete(df, None) == 2
    with pytest.raises(ValueError):
        feed.check_complete(df, 3)
    files = spark.createDataFrame([("m", "z", 1, "e"), ("m", "z", 2, "e"), ("m", "z", 3, None), ("m", "z", 4, "e"), ("m", "y", 1, "e")], "mirror string, organism string, file_no int, etag string")
    assert sorted((r.organism, r.file_no) for r in feed.changed_files(files).collect()) == [("y", 1), ("z", 1), ("z", 3), ("z", 4)]
    assert feed.groups(files) == ["y", "z"]
    for bad in (files.limit(0), files.withColumn("organism", F.lit(" "))):
        with pytest.raises(ValueError):
            feed.groups(bad)
    (tmp_path / "m.json").write_text(json.dumps({"blobs": [{"seq": 0, "hash": "h", "block": None}]}))
    assert [tuple(r) for r in feed.manifest_blobs(spark, str(tmp_path / "m.json")).collect()] == [(0, "h", None, None)]
    assert feed.tooling(spark, str(tmp_path), "*.json").count() == 1 and feed.log_pages(0, 10, 4) == [(0, 3), (4, 7), (8, 10)]


def test_landing_what_changed(spark, tmp_path):
    """A file is fetched once per entity tag; a failed answer or a half-landed file changes nothing for good."""
    from strandlog.sources.responses import Failed, Response

    asked, folder = [], Folder(spark, str(tmp_path / "landed")).make()
    lines = zstandard.ZstdCompressor().compress(b'{"a":1}\n\n{"a":2}')

    def get(url, headers):
        asked.append(dict(headers))
        return Response(304) if headers.get("If-None-Match") == "e1" else Response(200, lines, {"ETag": "e1", "X-Total-Records": "2"})

    assert feed.land(get, "u", folder, "zika.ndjson.zst") == (True, 2) and feed.land(get, "u", folder, "zika.ndjson.zst") == (False, 2)
    df = feed.read_lines(spark, folder.at("zika.ndjson.zst"))
    assert feed.check_complete(df, 2) == 2 and sorted(r.value for r in df.collect()) == ['{"a":1}', '{"a":2}']
    with pytest.raises(Failed):
        feed.land(lambda u, h: Response(500), "u", folder, "zika.ndjson.zst")
    assert folder.read("zika.ndjson.zst") == lines
    feed.forget(folder, "zika.ndjson.zst")
    assert feed.land(get, "u", folder, "zika.ndjson.zst") == (True, 2) and asked == [{}, {"If-None-Match": "e1"}, {}]


def test_blob_sources(spark, tmp_path):
    pieces = [bytes([k]) * 50 for k in range(4)]
    names = [blobs.sha256_name(p) for p in pieces]
    for folder, have in (("a", [0, 1]), ("b", [1, 2])):
        os.makedirs(tmp_path / folder)
        for k in have:
            (tmp_path / folder / f"{names[k]}.blob").write_bytes(pieces[k] if (folder, k) != ("a", 1) else b"corrupt")

    class Down:
        name = "down"

        def fetch(self, wanted):
            raise OSError("offline")

    got, log = blobs.gather([Down(), blobs.FolderSource("a", str(tmp_path / "a")), blobs.FolderSource("b", str(tmp_path / "b"))], names)
    assert set(got) == set(names[:3]) and [(x["source"], x["outcome"], x["verified"], x["rejected"]) for x in log] == [("down", "error", 0, 0), ("a", "partial", 1, 1), ("b", "partial", 2, 0)]
    df = blobs.read_folder(spark, str(tmp_path / "a"))
    assert df.count() == 2 and blobs.verified(df).count() == 1
    store = str(tmp_path / "store")
    table = spark.createDataFrame([(k, names[k], pieces[k]) for k in range(3)] + [(3, names[3], b"wrong")], "seq long, hash string, data binary")
    assert blobs.append_blobs(store, table) == 3 and blobs.append_blobs(store, table) == 0
    with pytest.raises(ValueError):
        blobs.append_blobs(store, spark.createDataFrame([(0, names[3], pieces[3])], table.schema))
    stored = spark.read.parquet(store)
    assert [r.seq for r in blobs.missing_numbers(stored, 5).orderBy("seq").collect()] == [3, 4] and blobs.missing_numbers(stored, 0).count() == 0
    assert [r.seq for r in blobs.failing(table).collect()] == [3]
    blobs.export_blobs(stored, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"{n}.blob" for n in names[:3])


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("KEY", "k1")
    p = tmp_path / "s.toml"
    p.write_text('store = "/x/${KEY}"\nsources = ["${KEY}"]\nminimum_age_days = 3\n')
    s = config.load(str(p))
    assert (s.store, s.sources, s.minimum_age_days) == ("/x/k1", ["k1"], 3)
    for text in ("other = 1", 'store = "${ABSENT_NAME}"', 'minimum_age_days = "3"'):
        p.write_text(text)
        with pytest.raises(ValueError):
            config.load(str(p))
    assert config.first_not_given(["a", "b"], ["b"]) == ["a"]


def test_reports(spark, tmp_path):
    compared = spark.createDataFrame([("z", "match"), ("y", "differs")], "organism string, status string")
    none = spark.createDataFrame([], "seq long")
    tooling = spark.createDataFrame([("README.md", 3, "ab")], "path string, size long, sha256 string")
    structure = container.Structure(None, [], [container.Torn(0, 0, 2, "cut")])
    r = reports.recovery_report(structure, compared, none, none, tooling)
    assert not r["allMatch"] and r["missing"] == 0 and r["torn"][0]["reason"] == "cut" and r["tooling"][0]["path"] == "README.md"
    Folder(spark, str(tmp_path)).put("r.json", reports.to_json(r))
    assert json.loads((tmp_path / "r.json").read_text()) == r and [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["r.json"]


def test_stream_appends_once(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    df.write.parquet(src)
    args = (spark, src, df.schema, log, str(tmp_path / "cp"), ["k"])
    assert run_available(*args) == 2 and run_available(*args) == 0
    assert run_available(spark, src, df.schema, log, str(tmp_path / "cp2"), ["k"]) == 0
    spark.createDataFrame([(3, "d"), (2, "other")], df.schema).write.mode("append").parquet(src)
    assert run_available(*args) == 1
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(log).select("k", "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Conflict):
        append_new(df, log, ["k"], expected=1)


SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    for name in sorted(sql):
        df = queries[name](spark, SF)
        cur = con.execute(sql[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns), name
        want = sorted((tuple(plain(x[columns.index(c)]) for c in sorted(columns)) for x in cur.fetchall()), key=str)
        got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=str)
        assert got == want, name
    assert e.entry(spark).count() > 0


def test_commitment(spark, tmp_path):
    from strandlog.sources import commitment as c

    path = str(tmp_path / "c")
    with pytest.raises(c.Refused):
        c.CommitmentLog(spark, path, "")
    log = c.CommitmentLog(spark, path, "ann")
    assert log.read() == c.State("ann")
    s = log.apply(c.publish("ann", 0, ["aa", "bb"], 7, True, "p1"))
    assert s.piece_count == 2 and s.pointer == "p1" and s.head == c.extend(c.extend(c.ZEROS, ["aa"]), ["bb"]) and log.read() == s
    for refused in (
        c.publish("ann", 0, ["cc"], 7, False), c.publish("ann", 2, [], 7, False), c.publish("ann", 2, ["cc"], 0, False), c.publish("ann", 2, ["cc"], 4097, True), c.publish("bob", 2, ["cc"], 1, False),
        c.set_pointer("bob", "x"), c.set_successor("bob", "x"), c.set_successor("ann", ""), c.set_publisher("bob", "bob"), c.set_publisher("ann", ""),
    ):
        with pytest.raises(c.Refused):
            log.apply(refused)
    assert log.read() == s and log.versions() == [0, 1]
    # within a batch the pointer is left alone; the end of a batch sets it, also to nothing
    assert log.apply(c.publish("ann", 2, ["cc"], 4096, False, "ignored")).pointer == "p1"
    assert log.apply(c.set_pointer("ann", "p2")).pointer == "p2"
    assert log.apply(c.publish("ann", 3, ["dd"], 1, True)).pointer == ""
    assert log.apply(c.set_successor("ann", "next")).successor == "next"
    with pytest.raises(c.Refused):
        log.apply(c.set_successor("ann", "other"))
    assert log.apply(c.set_publisher("ann", "bob")).publisher == "bob"
    with pytest.raises(c.Refused):
        log.apply(c.set_pointer("ann", "x"))
    assert log.read(1) == s and log.read(0).piece_count == 0
    got = log.events()
    assert [r.hash for r in got.filter("event = 'piece_published'").orderBy("seq").collect()] == ["aa", "bb", "cc", "dd"]
    assert [(r.first_seq, r.last_seq, r.last_chunks, r.pointer) for r in got.filter("event = 'batch_committed'").orderBy("version").collect()] == [(0, 1, 7, "p1"), (3, 3, 1, "")]
    with pytest.raises(c.Refused):  # another writer was first
        log._write(3, s, [])


def test_files(spark, tmp_path):
    from strandlog.sources.files import Folder

    f = Folder(spark, f"file://{tmp_path}/new")
    assert f.names() == [] and f.make().read("a") is None
    f.put("a", b"one")
    f.put("a", bytes(range(256)))
    assert f.read("a") == bytes(range(256)) and f.names() == ["a"] and f.move("a", "b") and f.names() == ["b"]
    f.remove("b")
    assert f.names() == []


def test_paged_scan(spark):
    from strandlog.sources.commitment import event_source, scan_pages

    asked = []

    def fetch(a, b):
        asked.append((a, b))
        if b - a > 3:
            raise OSError("too many")
        return [{"block": k, "seq": 100 - k, "hash": f"h{k}"} for k in range(a, b + 1)]

    assert [e["block"] for e in scan_pages(fetch, 0, 20, 16)] == list(range(21)) and asked[0] == (0, 15) and max(b - a for a, b in asked) <= 15
    with pytest.raises(OSError):
        list(scan_pages(lambda a, b: (_ for _ in ()).throw(OSError("down")), 0, 5))
    spark.dataSource.register(event_source(lambda a, b: [{"block": k, "seq": k, "hash": f"h{k}"} for k in range(a, b + 1)]))
    df = spark.read.format("strandlog-events").option("first", 3).option("last", 40).option("page", 4).option("span", 10).load()
    assert df.rdd.getNumPartitions() == 4 and [tuple(r) for r in df.orderBy("seq").collect()] == [(k, k, f"h{k}") for k in range(3, 41)]
    assert spark.read.format("strandlog-events").option("first", 3).option("last", 2).load().count() == 0


def test_answers_of_archives():
    from email.utils import formatdate

    from strandlog.sources import responses as r

    assert r.throttle_wait({"Retry-After": "3"}, 0) == 3.0 and r.throttle_wait({"retry-after": formatdate(1_000_000_003, usegmt=True)}, 1_000_000_000.0) == 3.0
    assert r.throttle_wait({"x-ratelimit-reset": "32063"}, 0) == 32.063 and r.throttle_wait({"retry-after": "900"}, 0) == 60.0
    assert r.throttle_wait({}, 0) == 5.0 and r.throttle_wait({"retry-after": "soon"}, 0) == 5.0
    pages = {"a/eth/v1/beacon/blobs/7": r.Response(500), "b/eth/v1/beacon/blobs/7": r.Response(200, b'{"data": ["0x0102", {"blob": "0x03"}]}')}
    assert r.SlotSource("s", lambda u: pages.get(u, r.Response(404)), ["a/", "b"], 7).candidates() == [b"\x01\x02", b"\x03"]
    assert r.SlotSource("s", lambda u: r.Response(404), ["a"], 7).candidates() == []
    with pytest.raises(r.Failed):
        r.SlotSource("s", lambda u: pages[u], ["a"], 7).candidates()
    with pytest.raises(r.Failed):
        r.listed_pieces(b'{"data": 3}')
    bodies = {"x": r.Response(200, b'{"result": {"data": "0x0a"}}'), "empty": r.Response(200, b'{"result": {"data": "0x"}}'), "pending": r.Response(200, b'{"result": {"data": null}}'), "down": r.Response(500), "odd": r.Response(200, b"[]")}
    waits = []
    make = lambda get: r.NamedSource("n", get, lambda n: None if n == "foreign" else n, r.record_reader("result", "data"), waits.append, lambda: 0.0)
    s = make(lambda u: bodies.get(u, r.Response(404)))
    assert s.fetch(["x", "empty", "pending", "absent", "down", "odd", "foreign"]) == {"x": b"\n"} and set(s.errors) == {"down", "odd"}
    with pytest.raises(r.Failed):
        s.fetch(["down"])
    answers = iter([r.Response(429, headers={"x-ratelimit-reset": "1500"}), bodies["x"], r.Response(429), r.Response(429)])
    t = make(lambda u: next(answers))
    assert t.fetch(["x", "y", "z"]) == {"x": b"\n"} and waits == [1.5, 5.0] and t.errors == {"y": "throttled", "z": "throttled"}
    assert r.snapshot_names(b'{"blobs": [{"versionedHash": "0xab", "cid": "c"}, {"versionedHash": "0xcd", "cid": null}]}') == {"ab": "c"} and r.raw_reader(b"") is None


def test_progress_and_canonical_column(spark):
    from strandlog.functions.canonical import is_canonical_udf
    from strandlog.operators import ingest

    df, watch = ingest.observed(spark.createDataFrame([("new",), ("held_back",), ("new",)], "class string"))
    assert df.count() == 3 and watch.get == {"total": 3, "new": 2, "held_back": 1}
    assert evaluate(spark, "string", ['{"a":1}', '{"a": 1}', "{", None], lambda c: is_canonical_udf()(c)) == [True, False, False, None]


def test_snapshot(spark, tmp_path):
    from strandlog.operators import digest

    df = spark.createDataFrame([("z", 1, "l1"), ("z", 0, "l0"), ("y", 0, "m")], "g string, k long, line string")
    listed = reports.snapshot(df, "g", ["k"], "line", str(tmp_path / "snap"), digest.group_digests(df, "g", ["k"], "line"))
    assert listed["z"]["lines"] == 2 and json.loads((tmp_path / "snap" / "manifest.json").read_text())["groups"] == listed
    back = spark.read.text(str(tmp_path / "snap" / "groups" / "g=z"))
    assert [r.value for r in back.collect()] == ["l0", "l1"]
