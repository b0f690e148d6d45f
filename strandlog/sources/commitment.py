"""The one-row commitment to a log: its publisher, how many pieces it has, the head of their hash chain, pointer and successor.

It is the guard of every append: a writer states where it believes the log ends, and is refused if that
is no longer so. Only the publisher changes anything. Every change is one new file, numbered, with the events
it caused and the state after it; creating a number that exists fails, so of two writers one is refused,
and the state can be read as of any change.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlog.functions.keccak import keccak256
from strandlog.sources.files import Folder

ELEMENTS = 4096
ZEROS = "0" * 64


class Refused(ValueError):
    """The change does not fit the state; nothing was changed."""


@dataclass(frozen=True)
class State:
    publisher: str
    piece_count: int = 0
    head: str = ZEROS
    pointer: str = ""
    successor: str = ""


#: a change takes a state and gives the next one with what happened
Change = Callable[[State], tuple[State, list[dict]]]


def extend(head: str, hashes: Iterable[str], link: Callable[[bytes], bytes] = keccak256) -> str:
    """The head (hex) after the pieces' hashes (hex) are chained on: the hash of head and piece hash, bytes after bytes."""
    for h in hashes:
        head = link(bytes.fromhex(head) + bytes.fromhex(h)).hex()
    return head


def _named(name: str, role: str) -> str:
    if not name:
        raise Refused(f"a {role} needs a name")
    return name


def opened(publisher: str) -> tuple[State, list[dict]]:
    """A new, empty commitment."""
    return State(_named(publisher, "publisher")), [{"event": "publisher_changed", "previous": "", "current": publisher}]


def _by_publisher(sender: str, change: Change) -> Change:
    def guarded(state: State) -> tuple[State, list[dict]]:
        if sender != state.publisher:
            raise Refused(f"{sender or 'nobody'} is not the publisher")
        return change(state)

    return guarded


def publish(sender: str, expected_first: int, hashes: list[str], last_chunks: int, batch_end: bool, pointer: str = "") -> Change:
    """Record pieces behind the ones there are; at the end of a batch the pointer becomes the given one, also if that is empty."""

    def change(state: State) -> tuple[State, list[dict]]:
        if not 1 <= last_chunks <= ELEMENTS:
            raise Refused("the last piece holds 1 to 4096 elements")
        first = state.piece_count
        if expected_first != first:
            raise Refused(f"the log has {first} pieces, not {expected_first}")
        if not hashes:
            raise Refused("no pieces")
        events: list[dict] = [{"event": "piece_published", "seq": first + k, "hash": h} for k, h in enumerate(hashes)]
        after = replace(state, piece_count=first + len(hashes), head=extend(state.head, hashes))
        if batch_end:
            after = replace(after, pointer=pointer)
            events.append({"event": "batch_committed", "first_seq": first, "last_seq": after.piece_count - 1, "last_chunks": last_chunks, "pointer": pointer})
        return after, events

    return _by_publisher(sender, change)


def set_pointer(sender: str, pointer: str) -> Change:
    """Point elsewhere without publishing anything; the last writer wins."""
    return _by_publisher(sender, lambda s: (replace(s, pointer=pointer), [{"event": "pointer_set", "pointer": pointer}]))


def set_successor(sender: str, successor: str) -> Change:
    """Write once, and not empty."""

    def change(state: State) -> tuple[State, list[dict]]:
        _named(successor, "successor")
        if state.successor:
            raise Refused("the successor is set already")
        return replace(state, successor=successor), [{"event": "successor_set", "successor": successor}]

    return _by_publisher(sender, change)


def set_publisher(sender: str, publisher: str) -> Change:
    """Hand the role to another."""
    return _by_publisher(sender, lambda s: (replace(s, publisher=_named(publisher, "publisher")), [{"event": "publisher_changed", "previous": s.publisher, "current": publisher}]))


_EVENTS = "event string, seq long, hash string, first_seq long, last_seq long, last_chunks long, pointer string, successor string, previous string, current string"


class CommitmentLog:
    """The numbered changes in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, publisher: str | None = None) -> None:
        self.spark, self.folder = spark, Folder(spark, path).make()
        if publisher is not None and not self.versions():
            self._write(0, *opened(publisher))

    def versions(self) -> list[int]:
        return [int(n[7:15]) for n in self.folder.names() if n.startswith("change-")]

    def read(self, version: int | None = None) -> State:
        """The state now, or as it was after a change."""
        have = self.versions()
        at = have[-1] if version is None and have else version
        data = None if at is None else self.folder.read(f"change-{at:08d}.json")
        if data is None:
            raise ValueError("there is no such state")
        return State(**json.loads(data)["state"])

    def apply(self, change: Change) -> State:
        """Make a change; a refused one leaves everything as it was."""
        have = self.versions()
        if not have:
            raise ValueError("the commitment has no publisher yet")
        after, events = change(self.read(have[-1]))
        self._write(have[-1] + 1, after, events)
        return after

    def _write(self, version: int, state: State, events: list[dict]) -> None:
        name = f"change-{version:08d}.json"
        # written under another name first: whoever renames it into place made the change
        self.folder.put(f"_{name}", json.dumps({"version": version, "state": asdict(state), "events": events}, sort_keys=True).encode())
        if name in self.folder.names() or not self.folder.move(f"_{name}", name):
            raise Refused(f"another writer made change {version}")

    def events(self) -> DataFrame:
        """version and the fields of each event, in no particular order."""
        read = self.spark.read.schema(f"version long, events array<struct<{_EVENTS.replace(' ', ':').replace(',:', ',')}>>").json(self.folder.at("change-*.json"))
        return read.select("version", F.inline("events"))


def scan_pages(fetch: Callable[[int, int], list[dict]], first: int, last: int, size: int = 1024) -> Iterator[dict]:
    """Events of the blocks first to last, page by page: the page is halved when a request fails and grows back, up to ``size``, when one works.

    A single block that fails raises.
    """
    page, at = size, first
    while at <= last:
        end = min(at + page - 1, last)
        try:
            found = fetch(at, end)
        except Exception:  # noqa: BLE001 - whatever the endpoint raises, a smaller page may do
            if end == at:
                raise
            page = max(1, (end - at + 1) // 2)
            continue
        yield from found
        at, page = end + 1, min(size, page * 2)


class _Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def event_source(fetch: Callable[[int, int], list[dict]], name: str = "strandlog-events") -> type[DataSource]:
    """A data source over a paged endpoint; ``fetch`` (first block, last block) gives dicts with block, seq and hash.

    ``spark.dataSource.register(event_source(fetch))``, then ``spark.read.format("strandlog-events")`` with options
    ``first``, ``last``, ``page`` (blocks a request, 1024) and ``span`` (blocks a task, 65536).
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.first, self.last = int(options["first"]), int(options["last"])
            self.page, self.span = int(options.get("page", 1024)), int(options.get("span", 65_536))

        def partitions(self) -> list[InputPartition]:
            return [_Pages(a, min(a + self.span - 1, self.last)) for a in range(self.first, self.last + 1, self.span)] or [_Pages(0, -1)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for e in scan_pages(fetch, partition.first, partition.last, self.page):
                yield e["block"], e["seq"], e["hash"]

    class Events(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "block bigint, seq bigint, hash string"

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader(dict(self.options))

    return Events
