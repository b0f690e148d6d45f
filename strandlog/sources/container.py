"""The batch container: a stream of records packed into fixed-size blobs, read and written with Spark.

Reading is split in two. The structure is walked on the driver from a few kilobytes per batch (begin
record, index length, manifest), as each batch is judged by the one before it; bodies are then decoded in
parallel, one task per batch. A body that turns out bad is struck out and the walk repeated, so that it resumes where a
reader going batch by batch would have.

``spark.read.format("strandlog")`` reads a folder of ``00000000.blob``... files: ``mode`` records (default)
or structure, which never opens a body.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlog.functions import canonical, codec
from strandlog.functions.codec import BatchBegin, Format, Malformed

Fetch = Callable[[int], bytes | None]


class Missing(Malformed):
    """A blob that the read needs is not there."""


class Stream:
    """Random access to the bytes of a sequence of blobs, some of which may be missing."""

    def __init__(self, fetch: Fetch, count: int) -> None:
        self.fetch, self.count = fetch, count
        self._kept: dict[int, bytes] = {}

    def blob(self, seq: int) -> bytes:
        if seq not in self._kept:
            raw = self.fetch(seq) if 0 <= seq < self.count else None
            if raw is None:
                raise Missing(f"blob {seq} is missing")
            if len(self._kept) >= 8:
                self._kept.pop(next(iter(self._kept)))
            self._kept[seq] = codec.unpack_blob(raw)
        return self._kept[seq]

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from a stream position; a declared length beyond the stream is refused before anything is kept."""
        if at + n > self.count * codec.BLOB_DATA:
            raise codec.Truncated("the stream ends too early")
        out = []
        while n:
            seq, inner = divmod(at, codec.BLOB_DATA)
            part = self.blob(seq)[inner : inner + n]
            out.append(part)
            at, n = at + len(part), n - len(part)
        return b"".join(out)

    def record_head(self, at: int) -> tuple[int, int, int]:
        """(type, place of the payload, its length) of the record at a position."""
        room = self.count * codec.BLOB_DATA - at
        n, used = codec.read_uvarint(self.read(at, min(10, max(room, 0))))
        if n < 1:
            raise Malformed("a record has no type")
        return self.read(at + used, 1)[0], at + used + 1, n - 1


@dataclass
class Batch:
    """Where a complete batch lies, and what its begin record and manifest say."""

    begin: BatchBegin
    body_at: int
    index_at: int
    index_length: int
    manifest: dict
    manifest_digest: bytes
    blob_count_after: int


@dataclass
class Torn:
    expected_batch: int
    first_blob: int
    last_blob: int
    reason: str


@dataclass
class Structure:
    header: Format | None = None
    batches: list[Batch] = field(default_factory=list)
    torn: list[Torn] = field(default_factory=list)

    @property
    def dead(self) -> set[int]:
        """Blobs of torn ranges that a complete batch follows; blob 0 holds the header and is always needed."""
        if not self.batches:
            return set()
        last = self.batches[-1].begin.first_blob
        return {s for t in self.torn if t.last_blob < last for s in range(t.first_blob, t.last_blob + 1)} - {0}

    @property
    def torn_tail(self) -> Torn | None:
        """The torn range at the end of the stream, if there is one."""
        end = self.batches[-1].blob_count_after if self.batches else 0
        return self.torn[-1] if self.torn and self.torn[-1].first_blob >= end else None


def _read_batch(s: Stream, at: int, number: int, previous: bytes, first: int) -> Batch:
    kind, where, n = s.record_head(at)
    if kind != codec.BATCH_BEGIN:
        raise Malformed("no batch begins here")
    if n > 1024:
        raise Malformed("a batch begins with a record of another size")
    begin = BatchBegin.unpack(s.read(where, n))
    if begin.batch != number or begin.previous != previous:
        raise Malformed("the batch does not follow the one before")
    if begin.first_blob != first:
        raise Malformed("the batch states another first blob")
    kind, body_at, n = s.record_head(where + n)
    if kind != codec.BODY or n != begin.body_length:
        raise Malformed("the body has another length")
    kind, where, size = s.record_head(body_at + n)
    index_at, index_length = 0, 0
    if kind == codec.INDEX:
        index_at, index_length = where, size
        kind, where, size = s.record_head(where + size)
    if kind != codec.MANIFEST:
        raise Malformed(f"a record of type {kind} stands where the manifest should")
    if size > codec.MAX_MANIFEST:
        raise Malformed("the manifest is too long")
    payload = s.read(where, size)
    try:
        m = json.loads(payload)
        stated = (m["batch"], m["firstBlobSeq"], m["previousManifestDigest"], m["bodyDigest"], m["blobCountAfter"], m["hasIndex"])
    except (ValueError, KeyError, TypeError):
        raise Malformed("the manifest cannot be read") from None
    end = where + size
    after = -(-end // codec.BLOB_DATA)
    if stated != (number, first, previous.hex(), begin.body_digest.hex(), after, bool(index_length)):
        raise Malformed("the manifest contradicts the batch")
    if any(s.read(end, after * codec.BLOB_DATA - end)):
        raise Malformed("the rest of the last blob is not zero")
    return Batch(begin, body_at, index_at, index_length, m, codec.digest(payload), after)


def walk(fetch: Fetch, count: int, form: Format | None = None, rejected: frozenset[int] = frozenset()) -> Structure:
    """The structure of a stream of ``count`` blobs; batches that begin in a rejected blob count as torn.

    After a torn batch every later blob is tried for the expected number with the expected predecessor.
    Without blob 0, or with another header, nothing can be read.
    """
    out, s = Structure(), Stream(fetch, count)
    if not count:
        return out
    form = form or Format()
    try:
        kind, where, n = s.record_head(0)
        if kind != codec.HEADER or n > 1 << 16:
            raise Malformed("the stream does not begin with a header")
        out.header = form.read_header(s.read(where, n))
    except Malformed as e:
        out.torn.append(Torn(0, 0, count - 1, str(e)))
        return out
    at, first, previous = where + n, 0, bytes(32)
    since: int | None = None
    reason = ""
    while first < count:
        try:
            if first in rejected:
                raise Malformed("the body was refused")
            b = _read_batch(s, at if first == 0 else first * codec.BLOB_DATA, len(out.batches), previous, first)
        except Malformed as e:
            since, reason = (first, str(e)) if since is None else (since, reason)
            first += 1
            continue
        if since is not None:
            out.torn.append(Torn(len(out.batches), since, first - 1, reason))
            since = None
        out.batches.append(b)
        previous, first = b.manifest_digest, b.blob_count_after
    if since is not None:
        out.torn.append(Torn(len(out.batches), since, count - 1, reason))
    return out


def decode_body(data: bytes, begin: BatchBegin) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of a body's records after its digest and lengths are checked. Outer types inside a body are refused."""
    if codec.digest(data) != begin.body_digest:
        raise Malformed("the body has another digest")
    for kind, payload in codec.read_records(codec.decompress(data, begin.codec, begin.raw_length)):
        if kind < 0x10 or kind > 0x7F:
            raise Malformed(f"a record of type {kind} stands in a body")
        yield kind, payload


_KINDS = {codec.ENTRY: "ENTRY", codec.SCHEMA: "SCHEMA", codec.TOOLING: "TOOLING", codec.WITHDRAW: "WITHDRAW", codec.REINSTATE: "REINSTATE"}
RECORDS = "batch bigint, ordinal bigint, kind string, organism string, accession string, version bigint, payload binary"
STRUCTURE = "batch bigint, first_blob bigint, blob_count_after bigint, compressed_bytes bigint, raw_bytes bigint, has_index boolean, manifest string, manifest_digest string"


def record_rows(batch: int, records: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    """Rows of ``RECORDS``; records of unknown inner types come out with kind UNKNOWN."""
    for k, (kind, payload) in enumerate(records):
        organism = accession = version = None
        if kind in (codec.ENTRY, codec.SCHEMA, codec.WITHDRAW, codec.REINSTATE):
            try:
                p = json.loads(payload)
                organism = p["organism"]
                if kind == codec.ENTRY:
                    accession, version = p["metadata"]["accession"], p["metadata"]["version"]
            except (ValueError, KeyError, TypeError):
                raise Malformed("a record is no such object") from None
        elif kind == codec.TOOLING:
            accession, payload = codec.unpack_tooling(payload)
        yield batch, k, _KINDS.get(kind, "UNKNOWN"), organism, accession, version, payload


def folder_fetch(path: str) -> tuple[Fetch, int]:
    """Access to ``<number>.blob`` files; the count is one more than the highest number."""
    numbers = {int(f[:-5]): f for f in os.listdir(path) if f.endswith(".blob") and f[:-5].isdigit()}

    def fetch(seq: int) -> bytes | None:
        if seq not in numbers:
            return None
        with open(os.path.join(path, numbers[seq]), "rb") as f:
            return f.read()

    return fetch, max(numbers, default=-1) + 1


class _BatchPart(InputPartition):
    def __init__(self, batch: Batch) -> None:
        self.batch = batch


class ContainerReader(DataSourceReader):
    """One partition per batch; a column that is not asked for costs nothing in structure mode, as bodies stay closed."""

    def __init__(self, options: dict) -> None:
        self.path, self.structure = options["path"], options.get("mode", "records") == "structure"
        self.form = Format(magic=options["magic"].encode()) if "magic" in options else Format()

    def partitions(self) -> list[InputPartition]:
        fetch, count = folder_fetch(self.path)
        found = walk(fetch, count, self.form).batches
        return [_BatchPart(b) for b in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, _BatchPart):
            return
        b = partition.batch
        if self.structure:
            yield b.begin.batch, b.begin.first_blob, b.blob_count_after, b.begin.body_length, b.begin.raw_length, bool(b.index_length), canonical.dumps(b.manifest), b.manifest_digest.hex()
            return
        fetch, count = folder_fetch(self.path)
        data = Stream(fetch, count).read(b.body_at, b.begin.body_length)
        yield from record_rows(b.begin.batch, decode_body(data, b.begin))


class ContainerSource(DataSource):
    """``spark.read.format("strandlog").option("mode", "records" | "structure").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "strandlog"

    def schema(self) -> str:
        return STRUCTURE if self.options.get("mode", "records") == "structure" else RECORDS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ContainerReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ContainerSource)


def read_index(data: bytes) -> dict:
    """The content of an index record."""
    if not data:
        raise codec.Truncated("an index is empty")
    try:
        return json.loads(codec.decompress(data[1:], data[0], limit=codec.MAX_MANIFEST))
    except ValueError as e:
        raise Malformed(f"the index cannot be read: {e}") from None


@dataclass
class Decoded:
    """What a stream holds: its structure and its records as a DataFrame of ``RECORDS``."""

    structure: Structure
    records: DataFrame


def decode(spark: SparkSession, path: str, form: Format | None = None) -> Decoded:
    """Structure and records of a folder of blobs, bad bodies struck out (see the module's head).

    Bodies are checked in parallel; normally the first round finds all of them good. After a refusal only the
    batches that the repeated walk places at or behind it are checked again.
    """
    fetch, count = folder_fetch(path)
    rejected: set[int] = set()
    sound = 0  # batches that begin before this blob are known to be good
    while True:
        structure = walk(fetch, count, form, frozenset(rejected))
        parts = [(b.begin.first_blob, b.body_at, b.begin) for b in structure.batches]
        open_parts = [p for p in parts if p[0] >= sound]

        def check(batches, parts=open_parts):
            import pandas as pd

            get, n = folder_fetch(path)
            for rows in batches:
                bad = []
                for i in rows["i"]:
                    first, at, begin = parts[i]
                    try:
                        named: dict[tuple, str] = {}
                        for _, _, kind, organism, _, _, payload in record_rows(begin.batch, decode_body(Stream(get, n).read(at, begin.body_length), begin)):
                            for av in json.loads(payload)["accessionVersions"] if kind in ("WITHDRAW", "REINSTATE") else ():
                                if named.setdefault((organism, av), kind) != kind:
                                    raise Malformed("a key is withdrawn and reinstated by one batch")
                    except Malformed:
                        bad.append(first)
                yield pd.DataFrame({"bad": pd.Series(bad, dtype="int64")})

        refused = {r.bad for r in spark.range(len(open_parts)).withColumnRenamed("id", "i").repartition(max(1, len(open_parts)), "i").mapInPandas(check, "bad bigint").collect()} if open_parts else set()
        if not refused:
            break
        sound = min(refused)
        rejected.add(sound)  # a later refusal may only follow from this one

    def rows(batches):
        import pandas as pd

        get, n = folder_fetch(path)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for ids in batches:
            for i in ids["i"]:
                _, at, begin = parts[i]
                found = list(record_rows(begin.batch, decode_body(Stream(get, n).read(at, begin.body_length), begin)))
                yield pd.DataFrame(found, columns=names).astype({"version": "Int64"})

    ids = spark.range(len(parts)).withColumnRenamed("id", "i").repartition(max(1, len(parts)), "i")
    return Decoded(structure, ids.mapInPandas(rows, RECORDS))


@dataclass
class WriterState:
    """What a writer must know to append; all of it can be had from the log."""

    batch: int = 0
    next_blob: int = 0
    previous: bytes = bytes(32)
    bytes_since_index: int = 0


def encode_batch(body: Iterator[tuple[int, bytes]], organisms: dict[str, dict], state: WriterState, form: Format, codec_id: int = codec.ZSTD, index: dict | None = None) -> tuple[list[bytes], dict, WriterState]:
    """Blobs, manifest and next state of a batch from its records in canonical order.

    Only the compressed body is kept in memory. The manifest states the blob count after the batch, which its own
    length may change; it is written again until that settles. The given state is not changed.
    """
    parts: list[bytes] = []
    raw = 0
    squeeze = codec.zstandard.ZstdCompressor(level=codec.ZSTD_LEVEL).compressobj() if codec_id == codec.ZSTD else None
    changes = 0
    for kind, payload in body:
        r = codec.record(kind, payload)
        raw += len(r)
        parts.append(squeeze.compress(r) if squeeze else r)
        changes += kind in (codec.ENTRY, codec.WITHDRAW, codec.REINSTATE)
    if not changes:
        raise ValueError("a batch without entries, withdrawals or reinstatements is not written")
    if squeeze:
        parts.append(squeeze.flush())
    data = b"".join(parts)
    begin = BatchBegin(state.batch, state.next_blob, state.previous, codec_id, raw, len(data), codec.digest(data))
    head = codec.record(codec.HEADER, form.header()) if state.batch == 0 else b""
    stream = head + codec.record(codec.BATCH_BEGIN, begin.pack()) + codec.record(codec.BODY, data)
    if index is not None:
        stream += codec.record(codec.INDEX, bytes([codec_id]) + codec.compress(canonical.dumps(index).encode(), codec_id))
    n = 1
    for _ in range(8):
        manifest = {
            "batch": state.batch, "firstBlobSeq": state.next_blob, "blobCountAfter": state.next_blob + n, "previousManifestDigest": state.previous.hex(),
            "bodyDigest": begin.body_digest.hex(), "hasIndex": index is not None, "organisms": organisms,
        }
        payload = canonical.dumps(manifest).encode()
        whole = stream + codec.record(codec.MANIFEST, payload)
        need = -(-len(whole) // codec.BLOB_DATA)
        if need == n:
            break
        n = need
    else:
        raise ValueError("the manifest does not settle")
    after = WriterState(state.batch + 1, state.next_blob + n, codec.digest(payload), 0 if index is not None else state.bytes_since_index + len(data))
    return codec.pack_blobs(whole), manifest, after


_SECTION = {"SCHEMA": 0, "TOOLING": 1, "WITHDRAW": 2, "REINSTATE": 3, "ENTRY": 4}
_TYPE = {"SCHEMA": codec.SCHEMA, "TOOLING": codec.TOOLING, "WITHDRAW": codec.WITHDRAW, "REINSTATE": codec.REINSTATE, "ENTRY": codec.ENTRY}


def write_batch(records: DataFrame, organisms: dict[str, dict], state: WriterState, path: str, form: Format | None = None, codec_id: int = codec.ZSTD, index: dict | None = None) -> tuple[dict, WriterState]:
    """Sort the records (kind, organism, accession, version, payload; of tooling, accession is the path) and append them as a batch.

    The cluster sorts; one task streams the sorted records through the compressor, as a body is one compressed run,
    and writes the blobs to a staging folder beside ``path``. They are moved into place last, so a failed or repeated
    task leaves nothing half-written. ``path`` must be a folder all executors see.
    """
    form = form or Format()
    section = F.create_map(*(x for k, v in _SECTION.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    ordered = records.withColumn("__s", section).select("__s", "kind", F.coalesce("organism", F.lit("")).alias("organism"), F.coalesce("accession", F.lit("")).alias("accession"), F.coalesce("version", F.lit(0)).alias("version"), "payload")
    ordered = ordered.repartition(1).sortWithinPartitions("__s", "organism", "accession", "version")
    staging = os.path.join(path, f"_staging-{state.batch}")

    def run(batches):
        import pandas as pd

        def body():
            for b in batches:
                for kind, accession, payload in zip(b["kind"], b["accession"], b["payload"], strict=True):
                    yield _TYPE[kind], codec.pack_tooling(accession, payload) if kind == "TOOLING" else payload

        blobs, manifest, after = encode_batch(body(), organisms, state, form, codec_id, index)
        os.makedirs(staging, exist_ok=True)
        for k, blob in enumerate(blobs):
            with open(os.path.join(staging, f"{state.next_blob + k:08d}.blob"), "wb") as f:
                f.write(blob)
                f.flush()
                os.fsync(f.fileno())
        yield pd.DataFrame({"manifest": [canonical.dumps(manifest)], "n": [len(blobs)], "digest": [after.previous], "since": [after.bytes_since_index]})

    done = ordered.mapInPandas(run, "manifest string, n bigint, digest binary, since bigint").collect()
    if not done:
        raise ValueError("a batch without entries, withdrawals or reinstatements is not written")
    done = done[0]
    for k in range(done.n):
        name = f"{state.next_blob + k:08d}.blob"
        if os.path.exists(os.path.join(path, name)):
            raise FileExistsError(f"{name}: another writer was first")
    for k in range(done.n):
        name = f"{state.next_blob + k:08d}.blob"
        os.replace(os.path.join(staging, name), os.path.join(path, name))
    os.rmdir(staging)
    return json.loads(done.manifest), WriterState(state.batch + 1, state.next_blob + done.n, bytes(done.digest), done.since)
